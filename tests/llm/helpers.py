"""Tables with nulls, ties, repeats, long texts and clashing column names."""

from __future__ import annotations

import random

#: Column names that operators use inside.
CLASHES = {"n_words": 6, "n_hit": 7, "items": "i", "_n_words": 1, "_spans": "q", "ids": "z", "decoded": "d", "_lang": "l", "_lang_pred": "l", "lang_pred": "l", "_file": "f", "_row": 4, "_key": 2, "_number": 3, "component_id": 8, "predicted": 1, "digest": "x", "id": 5, "block": 1, "n": 2, "score": 0.5, "sig": "s", "text_crc32": 3, "bucket": 4, "kept": False, "spans": "p", "row": 9, "ord": 8}


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [words(rng, rng.randint(20, 90)) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].replace(" ", "  \t")), (22, base[1].upper()), (23, base[2] + " tail one two three"), (24, "lead " + base[2])]
    rows += [(30, None), (31, ""), (32, " \n\t"), (33, "one"), (34, "one two three"), (35, "ONE two\nthree"), (36, "a" * 400), (37, "b" + "a" * 300), (38, "naïve café 漢字 😀 " * 9)]
    rows += [(40, words(rng, 6000)), (41, "x" * 20_000), (None, base[3]), (None, "no id at all here"), (5, base[5]), (5, base[5])]
    return rows


def table(spark, rows, clash: bool = True, name: str = "text"):
    """documents-like rows; with clash, further columns named like the operators' own."""
    data = [(i, t, "en", "s", *(CLASHES.values() if clash else ())) for i, t in rows]
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = f"doc_id long, {name} string, lang string, source string" + ("".join(f", `{c}` {kinds[type(v)]}" for c, v in CLASHES.items()) if clash else "")
    return spark.createDataFrame(data, schema)


def empty(spark):
    return table(spark, [], clash=False)
