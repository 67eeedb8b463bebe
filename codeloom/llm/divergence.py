"""Operator 11: how far the word use of each source is from that of the others, by term-block dense matrices.

Texts become (lang, source, term) counts, summed in each task before the one shuffle. The kept terms of a language are
dealt to blocks by hash; a block with the sources of the language is one dense int64 matrix, sources by terms. Its task
broadcasts all pairs of sources against one another and gives a partial matrix of pair sums, and the ten strongest terms
of each source as a heap. Partial sums are added, heaps merged. A language with more than GROUPS sources deals those to
chunks too, and a task takes the sources of two chunks, so a matrix stays bounded however many sources and terms there are.

Shares are whole numbers: p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), by long division in steps of 1000, so that no
step leaves 64 bits while N + 2 * V is below 9.2 * 10^15.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import join_on_hot_key, read_table, stored

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 10
#: Ranks of the terms of a group.
TOP = 10
#: Terms of one block and sources of one chunk, on average.
TERMS, GROUPS = 4096, 256
#: Entries that a task counts before it sends them on.
ENTRIES = 400_000
#: Cells of one broadcast step.
CELLS = 2_000_000
SCALE = 1_000_000_000
#: A-Z to a-z, and every byte outside `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` (letters and all beyond ASCII) to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact."""
    whole = total + 2 * terms
    if whole.size and int(whole.max()) > np.iinfo(np.int64).max // 1000:
        raise OverflowError("more than 9.2 * 10^15 occurrences of kept terms in one group")
    out, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each (lang, source); a row with a null term for each group."""
    seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in seen.items():
            terms = [None, *n]
            cols = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary())]
            cols += [pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs[lang, source].__getitem__, n)], pa.int64())]
            yield from pa.Table.from_arrays(cols, ["lang", "source", "term", "n", "docs"]).to_batches(50_000)
        seen.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.translate(LETTERS).split()
            n = seen[lang, source]
            before = len(n)
            n.update(words)
            docs[lang, source].update(set(words))
            held += len(n) - before
            if held > ENTRIES:
                yield from out()
                held = 0
    yield from out()


TILES = "lang string, source binary, part string, item binary, value long"


def _tile(table: pa.Table) -> pa.Table:
    """Pair sums and strongest terms of one block of terms for the sources of chunks a and b. Rows without a term are the
    groups, rows without a source the terms of the block that chunks of other sources may have alone."""
    c = {k: table.column(k).to_pylist() for k in ("lang", "a", "b", "chunk", "source", "term", "n", "total", "group_n", "lang_n", "v")}
    lang, a, b, v, lang_n = (c[k][0] for k in ("lang", "a", "b", "v", "lang_n"))
    groups = sorted({(chunk, s, g) for chunk, s, t, g in zip(c["chunk"], c["source"], c["term"], c["group_n"]) if t is None})
    totals = {t: w for t, w in zip(c["term"], c["total"]) if t is not None}
    row, col = {s: i for i, (_, s, _) in enumerate(groups)}, {t: j for j, t in enumerate(totals)}
    count = np.zeros((len(groups), len(totals)), np.int64)
    for s, t, n in zip(c["source"], c["term"], c["n"]):
        if s is not None and t is not None:
            count[row[s], col[t]] = n
    out: list[tuple] = []
    names, chunk = [s for _, s, _ in groups], np.array([g[0] for g in groups])
    pairs = np.zeros((len(groups), len(groups)), np.int64)
    left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    if totals:
        p = shares(count, np.array([g[2] for g in groups], np.int64)[:, None], v)
        step = max(1, CELLS // max(1, len(left) * len(right)))
        for at in range(0, len(totals), step):
            part = p[:, at : at + step]
            pairs[np.ix_(left, right)] += apart(part[left][:, None, :], part[right][None, :, :]).sum(axis=2)
        if a == b:
            terms = list(totals)
            q = shares(np.array(list(totals.values()), np.int64), np.array([lang_n], np.int64), v)
            force = apart(p, q)
            for i, s in enumerate(names):
                strong = np.flatnonzero((count[i] > 0) & (p[i] > q))
                best = heapq.nsmallest(TOP, ((-int(force[i, j]), terms[j]) for j in strong))
                out += [(lang, s, "term", t, -f) for f, t in best]
    for i in left.tolist():
        out += [(lang, names[i], "pair", names[j], int(pairs[i, j])) for j in right.tolist() if a != b or i < j]
    cols = list(zip(*out)) if out else [()] * 5
    kinds = (pa.string(), pa.binary(), pa.string(), pa.binary(), pa.int64())
    return pa.table([pa.array(x, k) for x, k in zip(cols, kinds)], ["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part `pair`: every other source of the language with the divergence from
    it, all ranks. Part `term`: the terms that a group uses more than its language, ten at most.

    Null languages, sources and texts count as empty strings, and an empty string is a language or source like any other.
    Repeated rows count each time. A group without kept terms has pairs and no terms; where a language keeps no term, all
    its values are 0. Ties go by the item's UTF-8 bytes. A language with one source has no pairs. An empty table gives no
    rows; further columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    sent = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    # One shuffle by (lang, term) serves both the sums of groups and those of languages.
    dealt = sent.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    known = dealt.withColumns({"total": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term), "first": F.min("source").over(of_term)})
    kept = known.filter(F.col("term").isNull() | (F.col("in_docs") >= min_docs))
    counts = stored(kept.select("lang", F.col("source").cast("binary").alias("source"), "term", "n", "total", (F.col("source") == F.col("first")).alias("lead")), "terms")

    langs = counts.groupBy("lang").agg(
        F.count_if(F.col("lead") & F.col("term").isNotNull()).alias("v"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("term").isNull()).alias("groups")
    )
    langs = langs.select("lang", "v", "lang_n", "rows", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("long").alias("blocks"), F.ceil(F.col("groups") / GROUPS).cast("long").alias("chunks"))
    langs = stored(langs, "langs")
    total = max(1, counts.count())
    with_lang = lambda df: join_on_hot_key(df, langs, "lang", "rows", total)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    chunk, block = F.pmod(F.xxhash64("source"), F.col("chunks")), F.pmod(F.xxhash64("term"), F.col("blocks"))
    cols = ["lang", "block", "a", "b", "chunk", "source", "term", "n", "total", "group_n", "lang_n", "v"]

    def in_pairs(df: DataFrame) -> DataFrame:
        """Each row in all pairs of chunks that its source's chunk is in."""
        met = df.withColumn("other", F.explode(upto(F.col("chunks"))))
        return met.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).select(*cols)

    null = lambda kind: F.lit(None).cast(kind)
    used = with_lang(counts.filter("term is not null").drop("lead")).withColumns({"chunk": chunk, "block": block, "group_n": null("long")})
    groups = with_lang(counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))).withColumns({"chunk": chunk, "block": F.explode(upto(F.col("blocks"))), "term": null("binary"), "n": null("long"), "total": null("long")})
    alone = with_lang(counts.filter("lead and term is not null").select("lang", "term", "total")).filter("chunks > 1")
    alone = alone.withColumns({"block": block, "source": null("binary"), "n": null("long"), "group_n": null("long"), "chunk": null("long"), "a": F.explode(upto(F.col("chunks")))})
    alone = alone.withColumn("b", F.explode(F.sequence("a", F.col("chunks") - 1))).select(*cols)
    tiles = in_pairs(used).unionByName(in_pairs(groups)).unionByName(alone).groupBy("lang", "block", "a", "b").applyInArrow(_tile, TILES)
    tiles = stored(tiles, "tiles")

    sums = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    there = sums.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    ranked = sums.unionByName(there).unionByName(tiles.filter("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))
    return ranked.select("lang", F.col("source").cast("string").alias("source"), "part", F.col("item").cast("string").alias("item"), "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS group_n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // (s.group_n + 2 * v.v) AS HUGEINT) AS p,
      CAST(1 + (1000000000 * CAST(k.total + 2 AS HUGEINT)) // (v.lang_n + 2 * v.v) AS HUGEINT) AS q
      FROM s JOIN k ON s.lang = k.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
