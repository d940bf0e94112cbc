"""Text columns with the semantics of the rules; positions and lengths are code points."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import rules as R

_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: What a word edge stands before, or after, in patterns where one side is always a word character.
_BEFORE = re.compile(r"\\b(?=\(?\\d|\((?:\?:)?[A-Za-z]|\[A-Z\]|\[6-9\]|[A-Za-z])")
_AFTER = re.compile(r"(?<=[a-z)}\]])\\b")


def _edges(pattern: str) -> str:
    """ASCII word edges, one look-around each where the other side is known."""
    out = _BEFORE.sub(r"(?<![A-Za-z0-9_])", pattern)
    return (out if "@" in pattern else _AFTER.sub(r"(?![A-Za-z0-9_])", out)).replace(r"\b", _EDGE)


def java(pattern: str) -> str:
    """A rule's pattern for Java: ASCII word edges, the rules' white space, LF as the only line end."""
    flags, _, rest = pattern.partition(")") if pattern.startswith("(?") and pattern[2] in "im" else ("", "", pattern)
    flags = flags and flags + ("d)" if "m" in flags else ")")
    return flags + _edges(rest).replace(r"[\s-]", f"[{R.WS}-]").replace(r"\s", f"[{R.WS}]")


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that filters are not pushed below; else what they are made of would be evaluated again for the filter."""
    rows = rows.withColumn("_made", F.explode_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
    return rows.select("*", *(F.col("_made")[name].alias(name) for name in columns)).drop("_made")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(R.WS_CHARS))


def space(chars: str) -> str:
    """A class of white space that visible ASCII fails at the first test."""
    return f"[[^!-~]&&[{chars}]]"


#: White space that is not a single blank already.
_RUNS = f"[[^!-~ ]&&[{R.WS}]]{space(R.WS)}*| {space(R.WS)}+"


def one_spaced(c: Column) -> Column:
    # Plain looks first: most texts hold nothing that the pattern could match.
    held = lambda x: functools.reduce(Column.__or__, (x.contains(w) for w in ("  ", "\n", "\t", "\x0b", "\f", "\r")), ~ascii_only(x))
    return let(c, lambda x: trim(F.when(held(x), F.regexp_replace(x, _RUNS, " ")).otherwise(x)))


def capped(c: Column, n: int) -> Column:
    """Trimmed and cut to n characters; nulls are empty."""
    return F.coalesce(F.substring(trim(c), 1, n), F.lit(""))


def folded(c: Column) -> Column:
    """Lower case, one-spaced, with straight quotes and plain dashes."""
    # Lower case is made once; named three times in a condition, it was made three times.
    return let(F.lower(one_spaced(c)), lambda low: F.when(ascii_only(low), low).otherwise(F.translate(low, "‘’ʼ“”–—−", "'''\"\"---")))


def canonical(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def dedupe_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", ""), " +", " "))


def tokens(c: Column) -> Column:
    """Words of two letters or digits on, stop words left out."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*R.STOPWORDS))


def singular(c: Column) -> Column:
    cut = F.substring(c, F.lit(1), F.length(c) - 1)
    return (
        F.when(c.endswith("ies") & (F.length(c) > 4), F.concat(F.substring(c, F.lit(1), F.length(c) - 3), F.lit("y")))
        .when(c.rlike("(?:ss|sh|ch|x|z)es$"), F.substring(c, F.lit(1), F.length(c) - 2))
        .when(c.endswith("s") & ~c.endswith("ss") & ~c.endswith("us") & (F.length(c) >= 4), cut)
        .otherwise(c)
    )


SUFFIX = f"^(.{{{R.MIN_STEM},}}?)(?:{'|'.join(R.SUFFIXES)})$"


def stem(c: Column) -> Column:
    """Singular, then one suffix after another, the longest that leaves a stem first."""
    one = singular(c)
    # Most words have no suffix and need one look.
    return F.when(one.rlike(SUFFIX), functools.reduce(lambda x, _: F.regexp_replace(x, SUFFIX, "$1"), R.SUFFIXES, one)).otherwise(one)


def stem_word(word: str) -> str:
    """The same rules for a word of a constant table."""
    if word.endswith("ies") and len(word) > 4:
        word = word[:-3] + "y"
    elif re.search("(?:ss|sh|ch|x|z)es$", word):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith(("ss", "us")) and len(word) >= 4:
        word = word[:-1]
    for _ in R.SUFFIXES:
        word = re.sub(SUFFIX, r"\1", word)
    return word


_STEMS: dict[str, str] = {}
_STOP = frozenset(R.STOPWORDS)
_TOKEN = re.compile("[a-z0-9]{2,}")


def stems(low: str) -> list[str]:
    """``stem`` of the ``tokens`` of a text in lower case, in their order; words met before are looked up."""
    if len(_STEMS) > 500_000:
        _STEMS.clear()
    out = []
    for token in _TOKEN.findall(low):
        if token not in _STOP:
            found = _STEMS.get(token)
            if found is None:
                found = _STEMS[token] = stem_word(token)
            out.append(found)
    return out


@functools.lru_cache(200_000)
def rounded(x: float) -> float:
    """Nine decimals, halves away from zero, as the SQL function rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def content_key(*parts: Column) -> Column:
    """SHA-256 over parts parted by NUL."""
    joined = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.sha2(joined, 256)


def number(c: Column) -> Column:
    """Value of digits with commas or of a number word, else null."""
    plain = F.regexp_replace(F.lower(trim(c)), ",", "")
    table = F.create_map(*(F.lit(x) for kv in R.NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))))
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.cast("double")).otherwise(F.try_element_at(table, plain))


def verhoeff(digits: Column) -> Column:
    """Whether twelve digits pass the checksum."""
    d = F.array(*(F.array(*(F.lit(int(x)) for x in row)) for row in R.VERHOEFF_D))
    p = F.array(*(F.array(*(F.lit(int(x)) for x in row)) for row in R.VERHOEFF_P))
    step = lambda c, i: F.get(F.get(d, c), F.get(F.get(p, i % 8), F.substring(digits, F.lit(12) - i, F.lit(1)).cast("int")))
    return F.coalesce(digits.rlike(r"^\d{12}$") & (F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step) == 0), F.lit(False))
