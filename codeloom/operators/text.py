"""Lexical retrieval over postings: TF-IDF, cosine, BM25, hybrid scores, similarity joins, chunking.

The index is relational: postings (id, term, tf), vocabulary (term, df, idf), document norms and lengths. Queries join
their few terms with the postings, so a query reads the postings of its terms and aggregates by document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.text import camel_words, space_tokens, term_tokens
from codeloom.storage import numbered, stored

CORPUS_TYPES = ("function", "class", "module", "service_contract", "rpc_contract")
K1, B, EPSILON = 1.5, 0.75, 0.25
CHUNK, STRIDE = 512, 448


def corpus(nodes: DataFrame, workspace: bool = False) -> DataFrame:
    """(id, ord, text, docstring) of the nodes that are indexed: name, its alphanumeric parts, doc, and 150 characters of
    code. In a workspace camelCase names are also split, and texts of three characters or fewer are left out."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = F.array_join(camel_words(e("name")) if workspace else F.regexp_extract_all(e("name"), F.lit("([A-Za-z0-9]+)"), F.lit(1)), " ")
    text = F.trim(F.concat_ws(" ", e("name"), words, e("docstring"), F.substring(e("code"), 1, 150)))
    rows = nodes.filter(F.col("type").isin(*CORPUS_TYPES)).select("id", "ord", text.alias("text"), e("docstring").alias("docstring"))
    return rows.filter(F.length("text") > (3 if workspace else 0))


def stop_words(spark: SparkSession) -> list[str]:
    """The English stop words that Spark ships."""
    return StopWordsRemover.loadDefaultStopWords("english")


def ngrams(tokens: Column, upto: int) -> Column:
    """Tokens, and if upto is 2 also pairs of neighbours."""
    if upto == 1:
        return tokens
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))


def terms(text: Column, stop: Sequence[str] = (), upto: int = 1) -> Column:
    tokens = term_tokens(text)
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop))
    return ngrams(tokens, upto)


def postings(docs: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """(id, term, tf)"""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(posts: DataFrame, n_docs: Column | int, smooth: bool = True, max_features: int | None = None) -> DataFrame:
    """(term, df, idf): ln((1 + n) / (1 + df)) + 1, or ln(n / df) unsmoothed. With max_features the most frequent terms
    are kept, ties by term."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    vocab = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if max_features:
        vocab = vocab.orderBy(F.desc("total"), "term").limit(max_features)
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1 if smooth else F.log(n / F.col("df"))
    return vocab.select("term", "df", idf.alias("idf"))


def norms(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, norm): the length of each document's vector of tf times idf."""
    w = F.col("tf") * F.col("idf")
    return posts.join(vocab, "term").groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def weights(posts: DataFrame, vocab: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(id, term, w): tf times idf, each document of length 1. lengths: norms() of all postings, where posts are some."""
    raw = posts.join(vocab, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = norms(posts, vocab) if lengths is None else lengths
    return raw.join(lengths, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


#: Terms, each of at most 64 characters, whose weights tasks are sent; the rest are joined. Rows that are weighed at once.
COMMON, COMMON_LENGTH, WEIGHED = 1 << 17, 64, 500


def document_frequencies(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (id, t: tokens), a row for each id: (term, df), stored, and the number of ids with a term. Counted in the rows, so that
    a term is moved once for each task that met it."""
    terms = F.array_distinct("t")
    each = rows.select(F.explode(F.when(F.col("id").isNotNull(), F.array_append(terms, F.lit(None))).otherwise(terms)).alias("term"))
    found = stored(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n = found.filter("term is null").first()
    return found.filter("term is not null"), n.df if n else 0


def common_terms(vocab: DataFrame, most: int) -> DataFrame:
    """The terms of the highest document frequencies, at most `most`, without part of those that share a frequency."""
    short = vocab.filter(F.length("term") <= COMMON_LENGTH)
    total, least = 0, None
    for df, terms in sorted(short.groupBy("df").count().collect(), reverse=True):  # n frequencies take n * (n + 1) / 2 postings
        total += terms
        if total > most:
            break
        least = df
    return short.filter(F.lit(False) if least is None else F.col("df") >= least)


def heaviest_terms(docs: DataFrame, tokens: Column, k: int, id_col: str = "id", digits: int = 4, common: int = COMMON) -> DataFrame:
    """(id, term, w, k): the k terms of each document with the largest weights (tf times idf, documents of length 1), rounded, ties by
    term.

    Tasks know the idf of the most frequent terms, and of these put out the ones that can be among the k: no more than a
    rounding below the k-th, by a bound of the document's length. Only rarer terms are joined with the vocabulary. Rows
    with equal ids are one document; without an id there is none, though its terms count in df.
    """
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("t")).filter(F.size("t") > 0)
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        rows = stored(rows.groupBy("id").agg(F.flatten(F.collect_list("t")).alias("t")), "merged")
    found, n = document_frequencies(rows)
    vocab = found.select("term", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    known = docs.sparkSession.sparkContext.broadcast(common_terms(vocab, common).select("term", "idf").toArrow().combine_chunks())
    highest = math.log((n + 1) / 2) + 1 + 1e-9
    slack = 1.01 * 10.0**-digits
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("term string, tf long, w double, s double")])
    arrow = to_arrow_schema(schema)

    def weighed(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        words, row = lists.flatten().dictionary_encode(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        size = len(words.dictionary)
        place, tf = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
        row, word = place // size, place % size
        at = pc.fill_null(pc.index_in(words.dictionary, value_set=known.value.column("term")), -1).to_numpy(zero_copy_only=False)[word]
        rare = at < 0
        idf = np.append(known.value.column("idf").to_numpy(), highest)  # the last one is for -1
        w = tf * idf[at]
        squares = lambda rows: np.bincount(row[rows], w[rows] ** 2, len(lists))
        s = squares(~rare)
        order = np.lexsort((-w, row))[~rare[np.lexsort((-w, row))]]
        first = np.searchsorted(row[order], np.arange(len(lists)))
        nth = order[np.arange(len(order)) - first[row[order]] == k - 1]
        least = np.full(len(lists), -np.inf)
        least[row[nth]] = w[nth]
        kept = rare | (w >= (least - slack * np.sqrt(s + squares(rare)))[row])
        row, rare = row[kept], rare[kept]
        cols = [batch.column(0).take(pa.array(row)), words.dictionary.take(pa.array(word[kept])), pa.array(tf[kept]), pa.array(w[kept], mask=rare), pa.array(s[row])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, WEIGHED):
                yield weighed(batch.slice(start, WEIGHED))

    made = stored(rows.filter("id is not null").mapInArrow(run, schema), "weighed")
    rare = made.filter("w is null").drop("w").join(vocab, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"), "s", F.lit(True).alias("rare"))
    every = made.filter("w is not null").select("id", "term", "w", "s", F.lit(False).alias("rare")).unionByName(rare)
    own = Window.partitionBy("id")
    norm = F.sqrt(F.max("s").over(own) + F.sum(F.when(F.col("rare"), F.col("w") * F.col("w")).otherwise(0.0)).over(own))
    every = every.withColumn("w", F.round(F.col("w") / norm, digits))
    return every.withColumn("k", F.row_number().over(own.orderBy(F.desc("w"), "term"))).filter(F.col("k") <= k).select("id", "term", "w", "k")


def query_terms(spark: SparkSession, tokens: Sequence[str]) -> DataFrame:
    counts: dict[str, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    return spark.createDataFrame(list(counts.items()), "term string, qtf long")


def cosine(doc_weights: DataFrame, vocab: DataFrame, query: DataFrame) -> DataFrame:
    """(id, score) of documents that share a term with the query."""
    q = query.join(vocab, "term").select("term", (F.col("qtf") * F.col("idf")).alias("q"))
    norm = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    hits = doc_weights.join(F.broadcast(q), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    return hits.crossJoin(F.broadcast(norm)).select("id", (F.col("dot") / F.col("qnorm")).alias("score"))  # norm is one row


def bm25(posts: DataFrame, query: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(id, score) by Okapi BM25; a negative idf is replaced by epsilon times the mean idf of all terms."""
    lengths = posts.groupBy("id").agg(F.sum("tf").alias("dl"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    q = idf.join(F.broadcast(query), "term").crossJoin(F.broadcast(mean)).select("term", "qtf", F.when(F.col("idf") < 0, F.col("mean") * epsilon).otherwise(F.col("idf")).alias("idf"))
    hits = posts.join(F.broadcast(q), "term").join(lengths, "id").crossJoin(F.broadcast(totals))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("id").agg(F.sum(part).alias("score"))


def hybrid(tfidf: DataFrame, bm: DataFrame, weight: float = 0.5) -> DataFrame:
    """weight times cosine plus the rest times BM25 over its maximum (1 if that is not positive)."""
    top = bm.agg(F.max("score").alias("top"))
    scaled = bm.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("b"))
    both = tfidf.withColumnRenamed("score", "t").join(scaled, "id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("id", (zero("t") * weight + zero("b") * (1 - weight)).alias("score"))


def top_k(scores: DataFrame, k: int = 5, digits: int = 4, tie: Sequence[Column | str] = ("id",)) -> DataFrame:
    """The k best positive scores, rounded, ties by the given columns."""
    return scores.filter("score > 0").withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), *tie).limit(k)


#: Prefix postings of one term that a task joins with as many.
HEAVY = 2000


def prefixes(doc_weights: DataFrame, threshold: float) -> DataFrame:
    """(id, term, w, rest): the terms of each document by which a partner must be met, and the length of its vector after
    each.

    A document's terms stand in the order of their document frequency, rarest first. A term is in the prefix while the vector
    from it on can still reach the threshold: its length, and its product with the largest weight of each term in any
    document, bound what it adds. Two documents whose common terms begin after either prefix are below the threshold, so
    partners share a prefix term.
    """
    stats = doc_weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("most"))
    rows = doc_weights.join(stats, "term")
    from_here = Window.partitionBy("id").orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"length": F.sqrt(F.sum(F.col("w") * F.col("w")).over(from_here)), "most": F.sum(F.col("w") * F.col("most")).over(from_here)})
    after = F.coalesce(F.lead("length").over(Window.partitionBy("id").orderBy("df", "term")), F.lit(0.0))
    slack = threshold - 1e-9
    return rows.withColumn("rest", after).filter((F.col("df") > 1) & (F.col("length") >= slack) & (F.col("most") >= slack)).select("id", "term", "w", "rest")


def candidate_pairs(doc_weights: DataFrame, threshold: float, heavy: int = HEAVY) -> DataFrame:
    """Distinct (a, b), a < b, that share a prefix term and, were it the first term they share, could reach the threshold:
    the product there and those of the vectors after it. The first common term of a pair passes this, so no pair is lost.
    Terms with many prefix postings are dealt to parts, and every two parts meet in a key of their own."""
    rows = prefixes(doc_weights, threshold)
    parts = rows.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / heavy).alias("parts"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(parts.select("term", "parts"), "term").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    a = rows.select("term", F.col("own").alias("i"), each.alias("j"), F.col("id").alias("a"), F.col("w").alias("wa"), F.col("rest").alias("ra"))
    b = rows.select("term", each.alias("i"), F.col("own").alias("j"), F.col("id").alias("b"), F.col("w").alias("wb"), F.col("rest").alias("rb"))
    met = a.join(b, ["term", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.col("wa") * F.col("wb") + F.col("ra") * F.col("rb") >= threshold - 1e-9))
    return met.select("a", "b").distinct()


def similar_classes(doc_weights: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (rep, id) of the classes of equal vectors, and (a, b, score), a < b or a = b, of class representatives with cosine at
    least threshold: candidate pairs, then exact products."""
    vectors = doc_weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("vector"))
    reps = vectors.groupBy("vector").agg(F.min("id").alias("rep"))
    members = stored(vectors.join(reps, "vector").select("rep", "id"), "members")
    some = stored(doc_weights.join(members.filter("rep = id").select("id"), "id", "left_semi"), "classes")
    pairs = candidate_pairs(some, threshold)
    wa = some.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"))
    wb = some.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    scored = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
    alike = some.groupBy(F.col("id").alias("a")).agg(F.sum(F.col("w") * F.col("w")).alias("score")).select("a", F.col("a").alias("b"), "score")
    return members, scored.unionByName(alike).filter(F.col("score") >= threshold)


#: Pairs that a task puts out, about, and tasks that pairs are dealt to at most.
MADE, DEALT = 1 << 23, 10_000


def similar_pairs(doc_weights: DataFrame, threshold: float, heavy: int = HEAVY, digits: int | None = None) -> DataFrame:
    """(a, b, score), a < b, of documents with cosine at least threshold, which must be positive. doc_weights: (id, term, w) of
    vectors of length 1 without negative weights; with `digits`, scores are rounded.

    Classes of equal vectors are compared once, and pairs of their members made from that. The ids of a class are lists of
    about `heavy`. Every two lists of similar classes have a number, by which the ids of one and the list of the other are dealt
    to tasks; each id then meets the other list in a row of its own, so a task makes a list's worth of pairs at a time, and
    pairs are not moved again.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    members, scored = similar_classes(doc_weights, threshold)
    parts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / heavy).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    lists = stored(members.join(parts, "rep").groupBy("rep", part.alias("part")).agg(F.collect_list("id").alias("ids")), "lists")
    side = lambda r, p, n: lists.select(F.col("rep").alias(r), F.col("part").alias(p), F.size("ids").cast("double").alias(n))
    met = scored.withColumnsRenamed({"a": "ra", "b": "rb"}).join(side("ra", "pa", "na"), "ra").join(side("rb", "pb", "nb"), "rb")
    met = met.filter((F.col("ra") != F.col("rb")) | (F.col("pa") <= F.col("pb")))
    score = F.col("score") if digits is None else F.round("score", digits)
    met = stored(met.withColumns({"score": score, "pair": F.monotonically_increasing_id()}), "met")
    total = met.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0
    tasks = min(DEALT, max(4 * doc_weights.sparkSession.sparkContext.defaultParallelism, math.ceil(total / MADE)))
    one = met.join(lists.select(F.col("rep").alias("ra"), F.col("part").alias("pa"), "ids"), ["ra", "pa"]).select("pair", F.explode("ids").alias("x"))
    twice = (F.col("ra") == F.col("rb")) & (F.col("pa") == F.col("pb"))  # a list with itself has each pair in both orders
    other = met.join(lists.select(F.col("rep").alias("rb"), F.col("part").alias("pb"), "ids"), ["rb", "pb"]).select("pair", "score", twice.alias("twice"), "ids")
    each = one.repartition(tasks, "pair").join(other.repartition(tasks, "pair"), "pair").select("score", "twice", "x", F.explode("ids").alias("y"))
    each = each.filter(~F.col("twice") | (F.col("x") < F.col("y")))
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def band_pairs(rows: DataFrame, width: int, ord_col: str = "ord") -> DataFrame:
    """Pairs (left.*, right.*) with 0 < right.ord - left.ord < width, as an equi-join: each row meets its own bucket of
    `width` ordinals and the next one."""
    bucket = F.floor(F.col(ord_col) / width)
    left = rows.select(F.struct("*").alias("l"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    right = rows.select(F.struct("*").alias("r"), bucket.alias("bucket"))
    gap = F.col(f"r.{ord_col}") - F.col(f"l.{ord_col}")
    return left.join(right, "bucket").filter((gap > 0) & (gap < width)).select("l", "r")


def semantic_edges(doc_weights: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Both directions of similar pairs as SEMANTIC_SIMILAR edges."""
    pairs = similar_pairs(doc_weights, threshold)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "score"))
    return both.select("src", "dst", F.lit("SEMANTIC_SIMILAR").alias("relation"), F.lit("Lsem").alias("layer"), F.col("score").alias("c_type"), F.lit("corpus").alias("id_ctx"))


def semantic_band_edges(docs: DataFrame, doc_weights: DataFrame, threshold: float = 0.60, width: int = 30) -> DataFrame:
    """One direction of pairs whose dense positions are less than `width` apart and whose cosine reaches the threshold."""
    dense = numbered(docs.select("id", "ord"), ["ord"], "pos", first=0)
    pairs = band_pairs(dense, width, "pos").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    wa = doc_weights.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"))
    wb = doc_weights.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    scored = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")).filter(F.col("score") >= threshold)
    return scored.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SEMANTIC_SIMILAR").alias("relation"), F.lit("Lsem").alias("layer"), F.col("score").alias("c_type"), F.lit("workspace_semantic").alias("id_ctx"))


def chunks(docs: DataFrame, text: Column, id_col: str = "id", size: int = CHUNK, step: int = STRIDE) -> DataFrame:
    """(id, start, tokens): windows of white-space tokens; short last windows stay, empty texts have none."""
    t = docs.select(F.col(id_col).alias("id"), space_tokens(text).alias("t")).filter(F.size("t") > 0)
    return t.select("id", F.explode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(step))).alias("start"), "t").select("id", "start", F.slice("t", F.col("start") + 1, size).alias("tokens"))


def chunk_scores(docs: DataFrame, text: Column, query: Sequence[str], id_col: str = "id", size: int = CHUNK, step: int = STRIDE) -> DataFrame:
    """(id, start, overlap, score) of the chunks() that hold a query token: query tokens found (repeats count) over the square root of
    the chunk's length. Inside a row only the places of query tokens are kept, and all chunks are scored from them, so
    neither chunks nor texts are copied."""
    times: dict[str, int] = {}
    for t in query:
        times[t] = times.get(t, 0) + 1
    tokens = space_tokens(text)
    marked = F.transform(tokens, lambda t, i: F.when(t.isin(*times), F.struct(t.alias("t"), i.alias("i"))))
    rows = docs.select(F.col(id_col).alias("id"), F.size(tokens).alias("n"), F.array_compact(marked).alias("hits")).filter(F.size("hits") > 0)

    def scored(start: Column) -> Column:
        mine = F.filter("hits", lambda h: (h["i"] >= start) & (h["i"] < start + size))
        known = F.array_distinct(F.transform(mine, lambda h: h["t"]))
        found = F.aggregate(known, F.lit(0).cast("long"), lambda s, t: s + F.element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), t))
        return F.struct(start.alias("start"), found.alias("overlap"), F.least(F.lit(size), F.col("n") - start).alias("length"))

    each = rows.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), scored)).alias("c")).select("id", "c.*")
    return each.filter("overlap > 0").select("id", "start", "overlap", (F.col("overlap") / (F.sqrt("length") + 1e-5)).alias("score"))


def containment(rows: DataFrame, text: Column, query: Sequence[str]) -> DataFrame:
    """Number of query tokens that each row's text contains."""
    low = F.lower(text)
    return rows.withColumn("hits", sum((F.contains(low, F.lit(t.lower())).cast("long") for t in query), F.lit(0)))


def softmax(rows: DataFrame, score: str, partition: Sequence[str], tau: float = 0.2, digits: int = 4) -> DataFrame:
    """rows with a confidence: softmax of score / tau within each partition."""
    w = Window.partitionBy(*partition)
    scaled = F.col(score) / max(tau, 1e-4)
    e = F.exp(scaled - F.max(scaled).over(w))
    return rows.withColumn("confidence", F.round(e / F.sum(e).over(w), digits))


def group_cosine(groups: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """Cosine of each candidate with its caller, with TF-IDF fitted inside each group.

    groups: (g, id, is_caller, text). Returns (g, id, score) of candidates; groups whose texts have no term give 1.0.
    """
    posts = groups.select("g", "id", "is_caller", F.explode(terms(F.col("text"), stop)).alias("term")).groupBy("g", "id", "is_caller", "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    df = posts.groupBy("g", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, "g")
    idf = df.select("g", "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = posts.join(idf, ["g", "term"]).select("g", "id", "is_caller", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("g", "id", "is_caller").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = raw.join(norm, ["g", "id", "is_caller"]).select("g", "id", "is_caller", "term", (F.col("w") / F.col("norm")).alias("w"))
    caller = unit.filter("is_caller").select("g", "term", F.col("w").alias("c"))
    dots = unit.filter("not is_caller").join(caller, ["g", "term"]).groupBy("g", "id").agg(F.sum(F.col("w") * F.col("c")).alias("score"))
    any_term = posts.select("g").distinct().withColumn("known", F.lit(True))
    cands = groups.filter("not is_caller").select("g", "id")
    return cands.join(dots, ["g", "id"], "left").join(any_term, "g", "left").select("g", "id", F.when(F.col("known"), F.coalesce("score", F.lit(0.0))).otherwise(1.0).alias("score"))


def driver_tokens(text: str, pattern: str = r"[a-z0-9]+") -> list[str]:
    """Tokens of a query text on the driver."""
    return re.findall(pattern, text.lower())
