"""Similarity joins of word-shingle sets on Jaccard similarity, whatever the way in which a task searches (see Search).

A document's set holds its distinct word shingles, made from keyed 128-bit digests of its words: 64 bits in the sets,
64 more to tell whether sets are equal. Two sets can only reach the threshold t if each has at least t * size elements
that occur in another document, so
1. all documents send their shingles to hash buckets as packed arrays and learn which are repeated (repeats.py);
2. documents with too few repeated shingles have no partner; of the rest, equal sets fold into their smallest id;
3. sets are linked to the smallest id at each token that the search names; tokens are such that linked sets share one, so
   the components of those links hold all true pairs;
4. inside a component each set is searched for its partners.
In components above CLUSTER sets, rounds over all machines first gather stars (see _star_rounds); then only sets outside
stars, and sets near another star's centre, search further (see _between_stars and _by_token).

Links are pairs of sets that really met the threshold, and few: a search puts out no link between sets that its own links
connect already. Each is compared again on the words of the two texts (see _false_links). As no two shingles of one text
share their 64 bits, which is checked too, equal bits can only add links, so results are exact once all links hold. If one
does not, or two shingles of a text do collide, everything is done again under another key, which a clash of 64 random
bits does not survive.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import NULL_ID, blocks_of, join_on_hot_key, mix, release, rows_of, stored, unpack
from codeloom.llm.components import components
from codeloom.llm.repeats import bucket_bits, look_up, ranges, repeated_keys, with_repeated
from codeloom.llm.wordhash import WORDS, WordDigests

N_WORDS = 5
#: Odd multipliers of the two columns of a shingle.
ODD = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
#: Sets of one component that a single search task takes.
CLUSTER = 3000
#: Keys under which a join is tried before it gives up.
TRIES = 5


class Index(Protocol):
    def search(self, payload: bytes, size: int) -> np.ndarray:
        """Numbers of the sets of the index that a set with this payload and size links with."""


class Search(Protocol):
    """How sets are searched: percent of similarity that links, and what a set carries for it."""

    percent: int

    def carried(self, keys: np.ndarray, repeated: np.ndarray, least: int) -> tuple[bytes, np.ndarray]:
        """What a set of all these keys carries, and its int64 tokens; its repeated keys come by rising number of documents, and
        the first `least` of them include one that any partner has. Linked sets share a token."""

    def index(self, payloads: list[bytes], sizes: np.ndarray) -> Index: ...

    def shared(self, one: bytes, n: int, other: bytes, m: int, percent: int) -> int:
        """Elements that two sets share; any smaller number if their similarity is below percent."""


def new_key() -> bytes:
    return uuid.uuid4().bytes


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


class Shingles:
    """Distinct shingles of texts under a key."""

    def __init__(self, n: int, digests: WordDigests):
        self.n, self.digests = n, digests

    def sets(self, starts: np.ndarray, raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """For each document of a block the first 64 bits of its shingles, ascending, their others in any order, and whether
        the first 64 bits tell its shingles apart. Fewer words than n make one shingle, none no set."""
        n, texts = self.n, raw.tobytes().translate(WORDS)
        each = [texts[a:b].split() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        digests = self.digests.halves([w for words in each for w in words])
        # Digests look random, so a sum weighted by place needs no mixing on the way.
        columns, many = [], max(sum(map(len, each)) - n + 1, 0)
        for w, odd in zip(digests, ODD):
            full = w[:many].copy()
            for i in range(1, n):
                full *= odd
                full += w[i : many + i]
            columns.append(mix(full))
        out, at = [], 0
        for k in map(len, each):
            if k >= n:
                a, b = (c[at : at + k - n + 1] for c in columns)
                ranked, clear = np.sort(a), True
                if (ranked[1:] == ranked[:-1]).any():
                    order = np.argsort(a, kind="stable")
                    same, b = ranked[1:] == ranked[:-1], b[order]
                    clear = bool((b[1:][same] == b[:-1][same]).all())
                    first = np.r_[True, ~same]
                    ranked, b = ranked[first], b[first]
                out.append((ranked, b, clear))
            elif k:
                h = [np.full(1, k, np.uint64)] * 2
                for i in range(at, at + k):
                    h = [x * odd + w[i] for x, odd, w in zip(h, ODD, digests)]
                out.append((mix(h[0]), mix(h[1]), True))
            else:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64), True))
            at += k
        return out


def group_links(payloads: list[bytes], sizes: np.ndarray, how: Search) -> list[tuple[int, int]]:
    """Linked pairs of numbers that connect just the sets that links connect, one fewer than sets in each component.

    Stars first: each set that no star has reached yet searches the index. Then every set outside the largest component
    searches it; a link between components has at least one such end, so none is lost, and copies of one text in
    thousands of variants cost one search for each star, not one for each pair.
    """
    index = how.index(payloads, sizes)
    parent, out = np.arange(len(payloads)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    searched, reached = np.zeros(len(payloads), bool), np.zeros(len(payloads), bool)

    def look(i: int) -> None:
        found = index.search(payloads[i], int(sizes[i]))
        searched[i] = reached[i] = True
        reached[found] = True
        for y in found.tolist():
            a, b = root(i), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, y))

    for i in range(len(payloads)):
        if not reached[i]:
            look(i)
    labels = np.array([root(i) for i in range(len(payloads))])
    largest = np.bincount(labels).argmax() if len(labels) else 0
    for i in np.flatnonzero((labels != largest) & ~searched):
        look(int(i))
    return out


SETS = "id long, n long, clear boolean, sig binary, keys binary, tokens array<long>, text binary"


def _sets(blocks: DataFrame, bits: int, n_words: int, how: Search, digests: Callable[[], WordDigests]) -> DataFrame:
    """A row for each document: id, set size, whether its shingles' bits are clear, and for those that may have a partner:
    signature, payload, tokens and the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, pack = Shingles(n_words, digests()), zstandard.ZstdCompressor(level=1).compress
        for _, ids, ends, text, found in rows_of(batches):
            ids, starts, raw = unpack(ids, ends, text)
            known, counts = ranges(found)
            out = []
            for i, (s, other, clear), a, b in zip(ids.tolist(), shingles.sets(starts, raw), starts.tolist(), starts[1:].tolist()):
                df = look_up(s, bits, known, counts)
                rep = df > 1
                least = least_overlap(len(s), how.percent)
                if not len(s) or rep.sum() < least:
                    out.append((i, len(s), clear, None, None, None, None))
                    continue
                keys = s[rep]
                order = np.argsort(df[rep], kind="stable")  # hash order among equals
                # A set too small to reach the threshold with one more element has no partner but its equals.
                alone = 100 * len(s) < how.percent * (len(s) + 1)
                payload, tokens = how.carried(s, keys[order], len(s) - least + 1 - (len(s) - len(keys)))
                halves = int(mix(s).sum(dtype=np.uint64)), int(mix(other).sum(dtype=np.uint64)), len(s)
                out.append((i, len(s), clear, b"".join(x.to_bytes(8, "big") for x in halves), payload, tokens[:0] if alone else tokens, pack(raw[a:b].tobytes())))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            for at in range(0, len(out), 128):
                cols = zip(*out[at : at + 128])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in SETS.split(", ")])

    return blocks.mapInArrow(run, SETS)


def _star_rounds(members: DataFrame, how: Search, total: int) -> DataFrame:
    """Finds stars in components above CLUSTER sets. members: (id, n, keys, cluster, size).

    In each round the smallest id of a component that no star has reached is compared with all others of the component,
    wherever they are; those that link form its star. Rounds end when every component has at most CLUSTER sets that no
    star reached, or when a round reached fewer than one in eight of the sets left. Returns the members with two more
    columns: star, the first centre that reached them, or null; and near, all centres that are so close that a set of
    their star may link with this one. Jaccard distance is a metric, so that is twice the distance of a link.
    """
    percent = how.percent
    bound, reached = 2 * percent - 100, None
    rest = members.withColumns({"star": F.lit(None).cast("long"), "near": F.array().cast("array<long>")})
    for _ in range(24):
        left = rest.filter("star is null").groupBy("cluster").agg(F.count(F.lit(1)).alias("open"), F.min("id").alias("centre"))
        large = left.filter(F.col("open") > CLUSTER)
        n = large.agg(F.sum("open")).first()[0]
        if not n or (reached is not None and n > 0.875 * reached):
            break
        reached = n
        centre = rest.select(F.col("id").alias("cid"), F.col("n").alias("cn"), F.col("keys").alias("ck")).join(large.withColumnRenamed("centre", "cid"), "cid").withColumn("weight", F.col("open"))
        centre = stored(centre.drop("open").dropDuplicates(["cluster"]), "centres")  # ids may repeat
        done = rest.join(centre.select("cluster"), "cluster", "left_anti")
        tried = join_on_hot_key(rest.join(centre.select("cluster"), "cluster", "left_semi"), centre, "cluster", "weight", total)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = {k: batch.column(k).to_pylist() for k in ("id", "n", "keys", "star", "near", "cid", "cn", "ck")}
                star, near = [], []
                for i, n, keys, s, close, cid, cn, ck in zip(*c.values()):
                    shared = n if i == cid else how.shared(keys, n, ck, cn, bound)
                    star.append(s if s is not None or 100 * shared < percent * (n + cn - shared) else cid)
                    near.append(close + [cid] if 100 * shared >= bound * (n + cn - shared) else close)
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in MEMBERS[:5]] + [pa.array(star, pa.int64()), pa.array(near, pa.list_(pa.int64()))], MEMBERS)

        tried = tried.select(*MEMBERS, "cid", "cn", "ck").mapInArrow(compare, "id long, n long, keys binary, cluster long, size long, star long, near array<long>")
        rest = stored(done.select(*MEMBERS).unionByName(tried), "stars")
    return rest


MEMBERS = ["id", "n", "keys", "cluster", "size", "star", "near"]
LINKS = "u long, v long"


def _linked(how: Search, *group: str):
    """Links that connect the sets of each group."""

    def one(table: pa.Table) -> pa.Table:
        ids, sizes, keys = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("keys").to_pylist()
        of = [table.column(g).to_numpy() for g in group]
        u, v = [], []
        order = np.lexsort((ids, *of))
        new = np.any([np.diff(g[order]) != 0 for g in of], axis=0) if of else np.zeros(max(len(order) - 1, 0), bool)
        for part in np.split(order, np.flatnonzero(new) + 1):
            for i, j in group_links([keys[i] for i in part], sizes[part], how):
                u.append(int(ids[part[i]]))
                v.append(int(ids[part[j]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return one


def _small(members: DataFrame, how: Search) -> DataFrame:
    """Links inside components of at most CLUSTER sets (id, n, keys, cluster), some of which share a task."""
    bins = max(1, -(-members.count() // CLUSTER))
    return members.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins))).groupBy("bin").applyInArrow(_linked(how, "cluster"), LINKS)


def _by_token(sets: DataFrame, how: Search, total: int) -> DataFrame:
    """Links of sets (id, n, keys, tokens) that no star gathers: linked sets share a token, so the sets of
    each token search one another. The sets of a token are dealt to blocks of about CLUSTER, and every two blocks meet."""
    rows = stored(sets.select("id", "n", "keys", F.explode("tokens").alias("token")), "tokens")
    count = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    blocks = F.ceil(F.col("k") / CLUSTER).cast("long")
    rows = join_on_hot_key(rows, count, "token", "k", max(1, rows.count())).withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.select("id", "n", "keys", "token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).groupBy("token", "a", "b").applyInArrow(_linked(how), LINKS)


def _probe(how: Search):
    """One link at most of each query of a group to the sets of a part of a star."""

    def probe(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        ids, sizes, keys = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("keys").to_pylist()
        own = np.flatnonzero(~query)
        index = how.index([keys[i] for i in own], sizes[own])
        u, v = [], []
        for q in np.flatnonzero(query):
            found = ids[own[index.search(keys[q], int(sizes[q]))]]
            if len(found):
                u.append(int(ids[q]))
                v.append(int(found.min()))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return probe


def _between_stars(members: DataFrame, how: Search, total: int) -> DataFrame:
    """Links (u, v) that connect stars, and sets outside all stars, with other stars.

    A set visits a star only if the star's centre is near enough for a link, and only one of two stars visits the other.
    A star's sets are dealt to parts of about CLUSTER and its visitors to blocks as large, so that a group is bounded.
    Every visitor first goes to one part; then those go to all parts whose own star is not connected with the star yet.
    """
    visits = stored(members.select("id", "n", "keys", F.col("star").alias("home"), F.explode("near").alias("star")).filter("home is null or star < home"), "visits")
    sizes = members.filter("star is not null").groupBy("star").agg(F.count(F.lit(1)).alias("k"))
    sizes = stored(visits.groupBy("star").agg(F.count(F.lit(1)).alias("guests")).join(sizes, "star"), "sizes")
    parts, blocks = F.ceil(F.col("k") / CLUSTER).cast("long"), F.ceil(F.col("guests") / CLUSTER).cast("long")
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    hosts = join_on_hot_key(members.filter("star is not null").select("id", "n", "keys", "star"), sizes, "star", "k", total)
    hosts = hosts.withColumn("part", deal(parts, 1)).withColumn("block", each(blocks)).withColumn("query", F.lit(False))
    guests = join_on_hot_key(visits, sizes, "star", "guests", max(1, visits.count())).withColumn("block", deal(blocks, 2)).withColumn("query", F.lit(True))
    cols = ["id", "n", "keys", "star", "part", "block", "query"]
    search = lambda asked: asked.select(*cols).unionByName(hosts.select(*cols)).groupBy("star", "part", "block").applyInArrow(_probe(how), LINKS)
    links = stored(search(guests.withColumn("part", deal(parts, 3))), "links")
    tied = links.join(members.select(F.col("id").alias("u"), "star"), "u").withColumnRenamed("star", "a").join(members.select(F.col("id").alias("v"), F.col("star").alias("b")), "v")
    met = stored(tied.select(F.col("u").alias("id"), F.col("b").alias("star")).distinct(), "met")
    group = stored(components(tied.filter("a is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")
    pair = F.concat_ws(":", "home", "star")
    pairs = visits.filter("home is not null").groupBy("home", "star").agg(F.count(F.lit(1)).alias("times")).withColumn("pair", pair)
    for c in ("home", "star"):  # a star has few neighbours, so neither join has a hot key
        pairs = pairs.join(group.select(F.col("id").alias(c), F.col("component").alias(f"{c}_group")), c, "left")
    pairs = stored(pairs.filter("home_group = star_group").select("pair", "times"), "pairs").withColumn("met", F.lit(True))
    open_ = guests.filter(F.col("k") > CLUSTER).withColumn("pair", F.when(F.col("home").isNotNull(), pair))
    open_ = join_on_hot_key(open_, pairs, "pair", "times", max(1, visits.count()), "left").filter("met is null").join(met, ["id", "star"], "left_anti")
    return links.unionByName(search(open_.withColumn("part", each(parts))))


def _links(members: DataFrame, reps: DataFrame, how: Search, total: int) -> DataFrame:
    """Links (u, v) that connect just the sets that links of the threshold connect. members: (id, n, keys, cluster, size)."""
    members = _star_rounds(members, how, total)
    big = members.filter(F.col("size") > CLUSTER)
    links = _small(members.filter(F.col("size") <= CLUSTER), how)
    if not big.limit(1).count():
        return links
    links = links.unionByName(big.filter("star is not null and star <> id").select(F.col("id").alias("u"), F.col("star").alias("v")))
    links = links.unionByName(_between_stars(big, how, total))
    open_ = big.filter("star is null")
    left = open_.groupBy("cluster").agg(F.count(F.lit(1)).alias("open"))
    open_ = stored(join_on_hot_key(open_.select("id", "n", "keys", "cluster"), left, "cluster", "open", total), "open")
    links = links.unionByName(_small(open_.filter(F.col("open") <= CLUSTER), how))
    many = open_.filter(F.col("open") > CLUSTER)
    if many.limit(1).count():
        links = links.unionByName(_by_token(many.join(reps.select("id", "tokens"), "id"), how, total))
    return links


def false_pairs(pairs: Iterator[tuple[bytes, bytes]], n_words: int, percent: int) -> Iterator[bool]:
    """Whether the words of two texts do not reach the threshold; texts that come again and again are cut up once."""
    known: dict[bytes, set] = {}

    def cut(text: bytes) -> set:
        words = text.translate(WORDS).split()
        return set(zip(*(words[i:] for i in range(n_words)))) if len(words) >= n_words else {tuple(words)} if words else set()

    for one, other in pairs:
        if other not in known:
            known.clear()
            known[other] = cut(other)
        a, b = cut(one), known[other]
        both = len(a & b)
        yield not both or 100 * both < percent * (len(a) + len(b) - both)


def _false_links(links: DataFrame, reps: DataFrame, sets: DataFrame, how: Search, n_words: int, total: int) -> int:
    """Links (u, v) whose words do not reach the threshold. Where rows share an id, the link cannot name the row and is left
    out; the row's keyed digest is the proof then."""
    single = reps.groupBy("id").agg(F.count(F.lit(1)).alias("own"), F.first("sig").alias("sig")).filter("own = 1").select("id", "sig")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    named = links.join(single.toDF("u", "su"), "u").join(single.toDF("v", "sv"), "v")
    named = stored(named, "named")
    degree = named.groupBy("sv").agg(F.count(F.lit(1)).alias("degree"))
    ends = named.select(F.col("u").alias("id")).union(named.select("v")).distinct()
    texts = sets.filter("sig is not null").select("id", "sig", "text").join(ends, "id", "left_semi")
    texts = stored(texts.groupBy("sig").agg(F.any_value("text").alias("text")), "texts")
    mine = named.join(texts.toDF("su", "tu"), "su").select("sv", "tu")
    theirs = texts.toDF("sv", "tv").join(degree, "sv")
    both = join_on_hot_key(mine, theirs, "sv", "degree", total).select("tu", "tv")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            pairs = ((unpacked(a), unpacked(b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([sum(false_pairs(pairs, n_words, how.percent))], pa.int64())], ["n"])

    return both.mapInArrow(check, "n long").agg(F.sum("n")).first()[0] or 0


def similar_components(docs: DataFrame, how: Search, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, digests: Callable[[bytes], WordDigests] = WordDigests) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach, itself included).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Documents without words have no set and link with
    nothing; one with fewer words than a shingle has the whole sequence as its one element. Rows that share
    an id are one node and have one component. So have null ids, which sort after all others; a component of them alone
    is null. An empty table gives no rows; further columns are not read.
    """
    for _ in range(TRIES):
        found = _tried(docs, how, id_col, text_col, n_words, partial(digests, new_key()))
        if found is not None:
            return found
    raise RuntimeError(f"digests of shingles collided under {TRIES} keys")


def _tried(docs: DataFrame, how: Search, id_col: str, text_col: str, n_words: int, digests: Callable[[], WordDigests]) -> DataFrame | None:
    """similar_components under one key; None if digests collided."""
    blocks = blocks_of(docs, id_col, text_col)

    def keys_of(ids: np.ndarray, starts: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = [x for x, _, _ in Shingles(n_words, digests()).sets(starts, raw)]
        return np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    # A shingle for about six bytes of text; the figure only sets the number of buckets.
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = bucket_bits(size // 6)
    sets = stored(_sets(with_repeated(blocks, repeated_keys(blocks, keys_of, bits)), bits, n_words, how, digests), "sets")
    total, clear = sets.agg(F.count(F.lit(1)), F.coalesce(F.bool_and("clear"), F.lit(True))).first()
    total = max(1, total)
    release(docs.sparkSession, blocks)
    if not clear:
        return None

    maybe = sets.filter("sig is not null")
    reps = stored(maybe.groupBy("sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("n", "keys", "tokens"), "id").alias("s")).select("sig", "id", "copies", "s.n", "s.keys", "s.tokens"), "reps")
    tokens = reps.select("id", F.explode("tokens").alias("token"))
    least = tokens.groupBy("token").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    edges = join_on_hot_key(tokens, least, "token", "times", total).filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    cluster = stored(components(edges).withColumnRenamed("component", "cluster"), "clusters")
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    members = join_on_hot_key(cluster, sizes, "cluster", "size", total)
    members = stored(reps.select("id", "n", "keys").join(members, "id"), "members")
    links = stored(_links(members, reps, how, total), "links")
    if _false_links(links, reps, sets, how, n_words, total):
        return None
    repeated = sets.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = repeated.limit(1).count() > 0
    if shared:  # rows with one id are one node: each is tied to the set that stands for its own
        repeated = stored(repeated, "repeated")
        own = join_on_hot_key(maybe.select("id", "sig"), repeated, "id", "rows", total).select("id", "sig").distinct()
        links = links.unionByName(own.join(reps.select("sig", F.col("id").alias("v")), "sig").select(F.col("id").alias("u"), "v"))
    linked = components(links)
    named = reps.select("sig", "id", "copies").join(linked, "id", "left").select("sig", "copies", F.coalesce("component", "id").alias("component"))
    with_class = join_on_hot_key(maybe.select("id", "n", "sig"), stored(named, "named"), "sig", "copies", total)
    alone = sets.filter("sig is null").select("id", "n", F.col("id").alias("component"))
    rows = with_class.select("id", "n", "component").unionByName(alone)
    if shared:
        of_node = stored(repeated.join(linked.withColumnRenamed("component", "whole"), "id"), "nodes")
        rows = join_on_hot_key(rows, of_node, "id", "rows", total, "left").select("id", "n", F.coalesce("whole", "component").alias("component"))
    null_back = lambda c: F.when(F.col(c) == NULL_ID, F.lit(None).cast("long")).otherwise(F.col(c))
    return rows.select(null_back("id").alias(id_col), F.col("n").alias("n_shingles"), null_back("component").alias("component_id"))
