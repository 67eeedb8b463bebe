"""Substring look-ups (J16, J17, T12) from stored trigrams: the rarest grams of the needle give candidates, which are verified.

Texts are lower-cased and padded, so a needle of any length lies in grams. A look-up reads the row groups of a few
grams, not the texts; candidates are then compared with the needle itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.storage import clustered

N = 3
#: Grams of a needle whose postings are read: the rarest.
READ = 3
PAD = "\x02\x03"


def grams_of(text: Column) -> Column:
    """Distinct trigrams of a lower-cased text with two pad characters before and behind it."""
    padded = F.concat(F.lit(PAD[0] * 2), F.lower(text), F.lit(PAD[1] * 2))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - N + 1), lambda i: F.substring(padded, i, F.lit(N))))


@dataclass(frozen=True)
class GramIndex:
    """postings: (gram, id); counts: (gram, n); texts: (id, text); each in the order of its first column."""

    postings: DataFrame
    counts: DataFrame
    texts: DataFrame

    @staticmethod
    def of(rows: DataFrame, id_col: str, text: Column) -> GramIndex:
        """rows must have distinct ids. Null texts are empty."""
        texts = clustered(rows.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")), "gram-texts", "id")
        postings = clustered(texts.select(F.explode(grams_of(F.col("text"))).alias("gram"), "id"), "grams", "gram", "id")
        return GramIndex(postings, clustered(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts", "gram"), texts)

    def candidates(self, needle: str) -> DataFrame | None:
        """Ids of texts that may hold the needle in any case; None for an empty one, which all hold."""
        low = needle.lower()
        if not low:
            return None
        if len(low) < N:  # grams that hold the needle, told from the table of grams
            some = self.counts.filter(F.contains("gram", F.lit(low))).select("gram")
            return self.postings.join(some, "gram", "left_semi").select("id").distinct()
        mine = {low[i : i + N] for i in range(len(low) - N + 1)}
        known = {r.gram: r.n for r in self.counts.filter(F.col("gram").isin(*mine)).collect()}
        if len(known) < len(mine):
            return self.postings.limit(0).select("id")
        rare = sorted(known, key=lambda g: (known[g], g))[:READ]
        hits = self.postings.filter(F.col("gram").isin(*rare))
        return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("id")

    def contains(self, needle: str, ignore_case: bool = True) -> DataFrame:
        """(id, text) of the texts that hold the needle."""
        found = self.candidates(needle)
        rows = self.texts if found is None else self.texts.join(found, "id", "left_semi")
        return rows.filter(F.contains(F.lower("text"), F.lit(needle.lower()))) if ignore_case else rows.filter(F.contains("text", F.lit(needle)))

    def hits(self, needles: list[str]) -> DataFrame:
        """(id, hits): how many of the needles each text holds in any case, for texts that hold any."""
        found = None
        for i, needle in enumerate(needles):
            one = self.contains(needle).select("id", F.lit(i).alias("needle"))
            found = one if found is None else found.unionByName(one)
        if found is None:
            raise ValueError("no needles")
        return found.groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
