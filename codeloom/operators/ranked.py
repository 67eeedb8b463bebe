"""Ranked retrieval from a stored index (T3, T7, T8): blocks of postings by term with the most that any of them can score.

Documents are numbered by length and dealt to ranges of RANGE numbers; the postings of a term in a range are one row, and the
ranges are the same for all terms. Rows are stored in the order of term and range, so a query reads the row groups of
its terms. The maxima of a range, summed over the query's terms, bound what a document in it can score. The most
promising ranges are scored first, and after that only ranges whose bound reaches the k-th best score found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.operators.text import B, COMMON, EPSILON, K1, WEIGHED, common_terms, norms, top_k, vocabulary
from codeloom.storage import clustered, numbered, stored

#: keep(name, make): the table that make() gives, stored once for its inputs.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]

#: Documents of one range, ranges that are scored before any is ruled out, and ranges that a filter names one by one.
RANGE, SEEDS, NAMED = 256, 8, 1000


@dataclass(frozen=True)
class Query:
    """Weights of the terms of a query for tf-idf and for BM25, and the length of its tf-idf vector."""

    cosine: dict[str, float]
    bm25: dict[str, float]
    norm: float


def weight_of(term: Column, weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), term)


@dataclass(frozen=True)
class Index:
    """blocks: (term, range, top_cosine, top_bm25, entries of (id, cosine, bm25)); terms: (term, df, idf, bm25_idf). Entries hold
    a term's share of a score but for the query's weight of it."""

    blocks: DataFrame
    terms: DataFrame

    @staticmethod
    def tables(posts: DataFrame, size: int = RANGE, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
        """Blocks and terms of postings (id, term, tf), to be stored by store()."""
        lengths = stored(posts.groupBy("id").agg(F.sum("tf").alias("dl")), "lengths")
        n, mean_length = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
        vocab = vocabulary(posts, n)
        terms = stored(vocab.withColumn("raw", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))), "terms")
        mean = terms.agg(F.avg("raw")).first()[0] or 0.0
        terms = terms.select("term", "df", "idf", F.when(F.col("raw") < 0, F.lit(mean * epsilon)).otherwise(F.col("raw")).alias("bm25_idf"))
        placed = numbered(lengths, ["dl", "id"], "number", 0).select("id", "dl", F.floor(F.col("number") / size).cast("int").alias("range"))
        rows = posts.join(terms.select("term", "idf"), "term").join(placed.join(norms(posts, terms.select("term", "idf")), "id"), "id")
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (mean_length or 1.0)))
        rows = rows.select("term", "range", "id", (F.col("tf") * F.col("idf") / F.col("norm")).alias("cosine"), part.alias("bm25"))
        blocks = rows.groupBy("term", "range").agg(F.max("cosine").alias("top_cosine"), F.max("bm25").alias("top_bm25"), F.collect_list(F.struct("id", "cosine", "bm25")).alias("entries"))
        return blocks, terms

    @staticmethod
    def store_blocks(blocks: DataFrame, name: str = "blocks") -> DataFrame:
        return clustered(blocks, name, "term", "range")

    @staticmethod
    def store_terms(terms: DataFrame, name: str = "index-terms") -> DataFrame:
        return clustered(terms, name, "term")

    @staticmethod
    def of(posts: DataFrame, size: int = RANGE) -> Index:
        blocks, terms = Index.tables(posts, size)
        return Index(Index.store_blocks(blocks), Index.store_terms(terms))

    def query(self, tokens: Sequence[str]) -> Query:
        """The terms of a query that the index has."""
        times: dict[str, int] = {}
        for t in tokens:
            times[t] = times.get(t, 0) + 1
        found = self.terms.filter(F.col("term").isin(*times)).select("term", "idf", "bm25_idf").collect() if times else []
        cosine = {r.term: times[r.term] * r.idf for r in found}
        return Query(cosine, {r.term: times[r.term] * r.bm25_idf for r in found}, sum(w * w for w in cosine.values()) ** 0.5)

    def _ranked(self, q: Query, share: Callable[[Column, Column, Column], Column], k: int, digits: int) -> DataFrame:
        """The k best by the sum of share(term, cosine, bm25) over a document's terms; share must grow with both or fall with
        neither, as bounds are shares of the maxima."""
        spark: SparkSession = self.blocks.sparkSession
        if not q.cosine:
            return spark.createDataFrame([], self.blocks.select(F.col("entries")[0]["id"].alias("id"), F.lit(0.0).alias("score")).schema)
        mine = self.blocks.filter(F.col("term").isin(*q.cosine))
        most = F.greatest(share(F.col("term"), F.col("top_cosine"), F.col("top_bm25")), F.lit(0.0))
        bounds = mine.groupBy("range").agg(F.sum(most).alias("bound"))

        def scored(blocks: DataFrame) -> DataFrame:
            e = blocks.select("term", F.explode("entries").alias("e"))
            return e.groupBy(F.col("e.id").alias("id")).agg(F.sum(share(F.col("term"), F.col("e.cosine"), F.col("e.bm25"))).alias("score"))

        seeds = [r[0] for r in bounds.orderBy(F.desc("bound"), "range").limit(SEEDS).collect()]
        first = stored(top_k(scored(mine.filter(F.col("range").isin(*seeds))), k, digits), "seeds")
        floor = first.agg(F.count(F.lit(1)), F.min("score")).first()
        rest = bounds.filter(~F.col("range").isin(*seeds))
        if floor[0] == k:  # a document of a range with a lower bound cannot round up to the k-th score
            rest = rest.filter(F.col("bound") > floor[1] - 10.0**-digits)
        named = [r[0] for r in rest.select("range").limit(NAMED + 1).collect()]
        if not named:
            return top_k(first, k, digits)
        left = mine.filter(F.col("range").isin(*named)) if len(named) <= NAMED else mine.join(rest.select("range"), "range", "left_semi")
        return top_k(first.unionByName(scored(left)), k, digits)

    def cosine(self, tokens: Sequence[str], k: int = 5, digits: int = 4) -> DataFrame:
        """(id, score) of the k documents with the best positive cosine, rounded, ties by id."""
        q = self.query(tokens)
        return self._ranked(q, lambda t, c, b: weight_of(t, q.cosine) * c / (q.norm or 1.0), k, digits)

    def bm25(self, tokens: Sequence[str], k: int = 5, digits: int = 4) -> DataFrame:
        q = self.query(tokens)
        return self._ranked(q, lambda t, c, b: weight_of(t, q.bm25) * b, k, digits)

    def hybrid(self, tokens: Sequence[str], k: int = 5, weight: float = 0.5, digits: int = 4) -> DataFrame:
        """weight times cosine plus the rest times BM25 over its maximum (1 if that is not positive)."""
        q = self.query(tokens)
        best = self._ranked(q, lambda t, c, b: weight_of(t, q.bm25) * b, 1, 15).first()
        top = best.score if best else 1.0
        return self._ranked(q, lambda t, c, b: weight_of(t, q.cosine) * c * (weight / (q.norm or 1.0)) + weight_of(t, q.bm25) * b * ((1 - weight) / top), k, digits)


def times_in(term: str) -> Column:
    """How often the list t has a term."""
    return F.size(F.filter("t", lambda x: x == term))


@dataclass(frozen=True)
class Scan:
    """The same answers for texts that are asked seldom: a query reads the texts, and no posting is stored or moved.

    rows: (id, t: tokens), a row for each id; counts: (term, df, ids, total), with a row of term null that has the number of
    rows, of those with an id, and of tokens; keep stores what queries share: counts, and the norms when first asked for.
    """

    rows: DataFrame
    counts: DataFrame
    keep: Keep

    @staticmethod
    def of(docs: DataFrame, tokens: Column, id_col: str, keep: Keep) -> Scan:
        """Rows with equal ids are one document. One without an id is in the counts, but is never found."""
        rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(tokens)).alias("t")).filter(F.size("t") > 0)  # or filters would repeat the tokens' expression
        if not keep("repeated", lambda: docs.groupBy(F.col(id_col).alias("id")).count().filter("count > 1")).isEmpty():
            merged = rows.groupBy("id").agg(F.flatten(F.collect_list("t")).alias("t"))
            rows = keep("merged", lambda: merged)
        each = rows.select(F.explode(F.array_append(F.array_distinct("t"), F.lit(None))).alias("term"), F.col("id").isNotNull().cast("long").alias("own"), F.size("t").alias("size"))
        whole = lambda c: F.sum(F.when(F.col("term").isNull(), F.col(c)))
        return Scan(rows, keep("counts", lambda: each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), whole("own").alias("ids"), whole("size").alias("total"))), keep)

    def sizes(self) -> tuple[int, int, int]:
        """Rows, rows with an id, tokens."""
        r = self.counts.filter("term is null").first()
        return (r.df, r.ids, r.total) if r else (0, 0, 0)

    def vocabulary(self) -> DataFrame:
        n = self.sizes()[1]
        return self.counts.filter("term is not null").select("term", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def norms(self, common: int = COMMON) -> DataFrame:
        """(id, norm), the length of each document's vector of tf times idf, stored. Tasks know the idf of the most frequent terms and
        sum their squares; only rarer terms are moved to meet the vocabulary."""
        return self.keep("norms", lambda: self._norms(common))

    def _norms(self, common: int) -> DataFrame:
        vocab = self.vocabulary()
        known = self.rows.sparkSession.sparkContext.broadcast(common_terms(vocab, common).select("term", "idf").toArrow().combine_chunks())
        schema = T.StructType([self.rows.schema["id"], *T.StructType.fromDDL("s double, rare array<string>, times array<bigint>")])
        arrow = to_arrow_schema(schema)

        def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            words, row = lists.flatten().dictionary_encode(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            size = len(words.dictionary)
            place, tf = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
            row, word = place // size, place % size
            at = pc.fill_null(pc.index_in(words.dictionary, value_set=known.value.column("term")), -1).to_numpy(zero_copy_only=False)[word]
            rare = at < 0
            w = tf[~rare] * known.value.column("idf").to_numpy()[at[~rare]]
            ends = pa.array(np.searchsorted(row[rare], np.arange(len(lists) + 1)), pa.int32())
            terms, times = words.dictionary.take(pa.array(word[rare])), pa.array(tf[rare])
            cols = [batch.column(0), pa.array(np.bincount(row[~rare], w**2, len(lists))), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, times)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, WEIGHED):
                    yield summed(batch.slice(start, WEIGHED))

        made = stored(self.rows.filter("id is not null").mapInArrow(run, schema), "summed")
        rare = made.select("id", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("id", F.col("r.rare").alias("term"), F.col("r.times").alias("tf"))
        squares = rare.join(vocab, "term").select("id", (F.col("tf") * F.col("idf")).alias("w")).select("id", (F.col("w") * F.col("w")).alias("s"))
        return made.select("id", "s").unionByName(squares).groupBy("id").agg(F.sqrt(F.sum("s")).alias("norm"))

    def _asked(self, tokens: Sequence[str]) -> tuple[list[tuple[str, int, float, float]], DataFrame]:
        """(term, times, idf, idf for BM25) of a query's terms that some document has, and (id, dl, tf: times of these terms) of the
        documents that have any of them."""
        times: dict[str, int] = {}
        for t in tokens:
            times[t] = times.get(t, 0) + 1
        n = self.sizes()[0]
        raw = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        found = self.vocabulary().withColumn("raw", raw).filter(F.col("term").isin(*times)).select("term", "idf", "raw").collect() if times else []
        low = (self.vocabulary().agg(F.avg(raw)).first()[0] or 0.0) * EPSILON if any(r.raw < 0 for r in found) else 0.0
        terms = sorted((r.term, times[r.term], r.idf, low if r.raw < 0 else r.raw) for r in found)
        names = [t[0] for t in terms]
        mine = self.rows.filter("id is not null").select("id", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(*names)).alias("t")).filter(F.size("t") > 0)
        return terms, mine.select("id", "dl", F.array(*map(times_in, names)).alias("tf"))

    def _none(self) -> DataFrame:
        return self.rows.limit(0).select("id", F.lit(0.0).alias("score"))

    def _bm25(self, terms: list[tuple[str, int, float, float]], k1: float = K1, b: float = B) -> Column:
        n, _, total = self.sizes()
        long = k1 * (1 - b + b * F.col("dl") / (total / n))
        return sum((times * idf * F.col("tf")[i] * (k1 + 1) / (F.col("tf")[i] + long) for i, (_, times, _, idf) in enumerate(terms)), F.lit(0.0))

    def _cosine(self, terms: list[tuple[str, int, float, float]]) -> Column:
        length = sum((times * idf) ** 2 for _, times, idf, _ in terms) ** 0.5
        return sum((F.col("tf")[i] * idf / F.col("norm") * (times * idf) for i, (_, times, idf, _) in enumerate(terms)), F.lit(0.0)) / length

    def cosine(self, tokens: Sequence[str], k: int = 5, digits: int = 4) -> DataFrame:
        """(id, score) of the k documents with the best positive cosine, rounded, ties by id."""
        terms, hits = self._asked(tokens)
        return top_k(hits.join(self.norms(), "id").select("id", self._cosine(terms).alias("score")), k, digits) if terms else self._none()

    def bm25(self, tokens: Sequence[str], k: int = 5, digits: int = 4) -> DataFrame:
        terms, hits = self._asked(tokens)
        return top_k(hits.select("id", self._bm25(terms).alias("score")), k, digits) if terms else self._none()

    def hybrid(self, tokens: Sequence[str], k: int = 5, weight: float = 0.5, digits: int = 4) -> DataFrame:
        """weight times cosine plus the rest times BM25 over its maximum (1 if that is not positive)."""
        terms, hits = self._asked(tokens)
        if not terms:
            return self._none()
        hits = stored(hits, "hits")
        top = hits.agg(F.max(self._bm25(terms))).first()[0] or 0.0
        score = self._cosine(terms) * weight + self._bm25(terms) / (top if top > 0 else 1.0) * (1 - weight)
        return top_k(hits.join(self.norms(), "id").select("id", score.alias("score")), k, digits)
