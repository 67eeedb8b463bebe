"""String functions without a built-in equivalent, as Arrow-backed pandas UDFs."""

from __future__ import annotations

import ast
import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Matching-blocks similarity of two lower-cased names; one that begins with the other scores 0.85 at least."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    la, lb = F.lower(a), F.lower(b)
    prefix = (F.length(la) > 0) & (F.length(lb) > 0) & (F.startswith(la, lb) | F.startswith(lb, la))
    return F.when(prefix, F.greatest(_ratio(a, b), F.lit(0.85))).otherwise(_ratio(a, b))


@F.pandas_udf(T.StringType())
def _diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    def one(p, a, b):
        return "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}"))

    return pd.Series([one(p, a, b) for p, a, b in zip(path, old, new)], dtype="object")


def unified_diff(path: Column | str, old: Column | str, new: Column | str) -> Column:
    return _diff(path, old, new)


@F.pandas_udf(T.BooleanType())
def python_parses(code: pd.Series) -> pd.Series:
    """Whether a text is valid Python."""

    def ok(text):
        try:
            ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return False
        return True

    return pd.Series([ok(t) for t in code], dtype="bool")
