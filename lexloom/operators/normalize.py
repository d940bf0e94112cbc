"""One stable form of a document's text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions import rules as R
from lexloom.functions import text as T


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for part in parts:
        yield part.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def spaced(text: Column) -> Column:
    """Line ends, words broken at line ends, runs of white space and of empty lines."""
    # Cheap looks first: most texts hold nothing that a step would change.
    step = lambda c, may, use: T.let(c, lambda x: F.when(may(x), use(x)).otherwise(x))
    out = step(text, lambda x: x.contains("\r"), lambda x: F.regexp_replace(x, "\r\n?", "\n"))
    out = step(out, lambda x: x.contains("-\n"), lambda x: F.regexp_replace(x, "([a-z])-\n([a-z])", "$1$2"))
    blank = T.space(R.WS_NO_LF)
    held = lambda x: functools.reduce(Column.__or__, (x.contains(c) for c in ("  ", "\t", "\x0b", "\f", "\r")), ~T.ascii_only(x))
    out = step(out, held, lambda x: F.regexp_replace(x, f"[[^!-~ ]&&[{R.WS_NO_LF}]]{blank}*| {blank}+", " "))
    out = step(out, lambda x: x.contains(" \n") | x.contains("\n "), lambda x: F.regexp_replace(x, "(?: +\n| *\n +) *", "\n"))
    out = step(out, lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, "\n{3,}", "\n\n"))
    return T.trim(out)


def normalized(text: Column) -> Column:
    """Only texts beyond ASCII pass through Python, for the one step that SQL functions lack."""
    return spaced(F.when(T.ascii_only(text), text).otherwise(nfkc(F.when(~T.ascii_only(text), text))))
