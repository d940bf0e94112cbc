"""Verbatim verification of quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T

_ELLIPSIS = f"[{R.WS}]*(?:\\.\\.\\.|…)[{R.WS}]*"


def fragments(quote: Column) -> Column:
    parts = F.transform(F.split(quote, _ELLIPSIS, -1), T.trim)
    return F.transform(F.filter(parts, lambda x: x != ""), T.folded)


def verified(quote: Column, source: Column, folded: Column | None = None) -> Column:
    """Whether the quote's fragments stand in the source, one after the other; short ones count only alone.

    ``folded`` is the folded source, where it is at hand.
    """
    folded = T.folded(source) if folded is None else folded
    zero = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"), F.lit(0).alias("n"))

    def step(a: Column, x: Column, parts: Column, text: Column) -> Column:
        place = F.position(x, text, a["at"])
        skip = (F.length(x) < R.MIN_FRAGMENT) & (F.size(parts) > 1)
        hit = (place > 0) & (F.length(x) > 0)
        return F.when(skip | ~a["ok"], a).otherwise(F.struct(F.when(hit, place + F.length(x)).otherwise(a["at"]).alias("at"), hit.alias("ok"), (a["n"] + hit.cast("int")).alias("n")))

    def held(parts: Column, text: Column) -> Column:
        return F.aggregate(parts, zero, lambda a, x: step(a, x, parts, text), lambda a: a["ok"] & (a["n"] > 0))

    # Most quotes are one fragment, which needs a plain look only.
    one = T.let(T.folded(quote), lambda q: (q != "") & folded.contains(q))
    several = T.let(folded, lambda text: T.let(fragments(quote), lambda parts: held(parts, text)))
    return F.coalesce(F.when(quote.contains("...") | quote.contains("…"), several).otherwise(one), F.lit(False))


def spans(rows: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """Adds start and end (exclusive) in the source of a quote without elisions; nulls if it is not there."""
    chars = F.split(source, "")
    blank = lambda c: c.rlike(f"[{R.WS}]")
    kept = F.filter(F.sequence(F.lit(0), F.length(source) - 1), lambda i: ~blank(F.get(F.col("_c"), i)) | ((i > 0) & ~blank(F.get(F.col("_c"), i - 1))))
    rows = rows.withColumn("_c", chars).withColumn("_map", kept)
    at = F.position(T.folded(F.col(quote)), T.folded(F.col(source)))
    rows = rows.withColumn("_at", at)
    hit = F.col("_at") > 0
    first = F.get("_map", F.col("_at") - 1)
    last = F.get("_map", F.col("_at") - 2 + F.length(T.folded(F.col(quote))))
    return rows.withColumn("start", F.when(hit, first).cast("long")).withColumn("end", F.when(hit, last + 1).cast("long")).drop("_c", "_map", "_at")


def truncated(quote: Column, limit: int = R.MAX_QUOTE) -> Column:
    cut = F.substring(quote, 1, limit)
    space = limit - F.locate(" ", F.reverse(cut))
    head = F.when((F.locate(" ", cut) > 0) & (space > limit * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(quote) <= limit, quote).otherwise(F.concat(F.regexp_replace(head, f"[{R.WS}]+$", ""), F.lit("…")))


def salvage(quote: Column, source: Column) -> Column:
    """The quote if it verifies in the source, else its longest run of whole sentences that does, else empty; of equally long ones the first."""

    def best_run(parts: Column, folded: Column) -> Column:
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(i, F.size(parts)), lambda j: F.struct(i.alias("i"), T.trim(F.array_join(F.slice(parts, i, j - i + 1), " ")).alias("run")))))
        good = F.filter(runs, lambda r: (F.length(r["run"]) >= R.MIN_SALVAGE) & verified(r["run"], source, folded))
        return F.array_max(F.transform(good, lambda r: F.struct(F.length(r["run"]).alias("n"), (-r["i"]).alias("i"), r["run"].alias("run"))))["run"]

    def kept(q: Column, folded: Column) -> Column:
        parts = F.filter(F.split(q, f"(?<=[.;:?!])[{R.WS}]+"), lambda x: x != "")
        return F.when(verified(q, source, folded), q).otherwise(F.coalesce(T.let(parts, lambda p: F.when(F.size(p) > 1, best_run(p, folded))), F.lit("")))

    return T.let(F.coalesce(quote, F.lit("")), lambda q: T.let(T.folded(source), lambda folded: kept(q, folded)))


def salvaged(rows: DataFrame, keys: list[str], quote: str = "quote", source: str = "source") -> DataFrame:
    """(keys, salvaged): the quote if it verifies, else its longest run of whole sentences that does, else empty."""
    rows = rows.select(*keys, F.coalesce(quote, F.lit("")).alias("q"), F.col(source).alias("s"))
    rows = rows.withColumn("whole", verified(F.col("q"), F.col("s")))
    done = rows.where("whole").select(*keys, F.col("q").alias("salvaged"))
    open_ = rows.where("not whole").withColumn("parts", F.filter(F.split("q", f"(?<=[.;:?!])[{R.WS}]+"), lambda x: x != ""))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.transform(F.sequence(i, F.size("parts")), lambda j: F.struct(i.alias("i"), T.trim(F.array_join(F.slice("parts", i, j - i + 1), " ")).alias("run")))))
    tried = open_.select(*keys, "s", F.explode_outer(F.when(F.size("parts") > 1, runs)).alias("r")).select(*keys, "s", "r.*")
    good = F.coalesce((F.length("run") >= R.MIN_SALVAGE) & verified(F.col("run"), F.col("s")), F.lit(False))
    # Longest first; of equally long ones the one that starts first.
    best = F.max(F.when(good, F.struct(F.length("run").alias("n"), (-F.col("i")).alias("i"), "run")))
    return done.unionByName(tried.groupBy(*keys).agg(F.coalesce(best["run"], F.lit("")).alias("salvaged")))


def contained(quotes: DataFrame, docs: DataFrame, words: int = 3) -> DataFrame:
    """(quote_id, doc_id, quote, source) pairs that share a quote's second run of words: the candidates for verification.

    Whole words inside a verbatim quote stand in the source too, so only pairs that meet in the index are compared.
    Complete for quotes of five words or more without an elision among the second to fourth.  Shorter ones may be cut
    inside these words, and are then found only where they stand as whole words; hold them against sources with ``verified``.
    """

    def with_grams(rows: DataFrame, text: str) -> DataFrame:
        # Words and runs are columns of their own, as lambdas would fold the text again for every run.
        rows = rows.withColumn("_w", F.split(T.folded(F.col(text)), " "))
        last = F.greatest(F.lit(1), F.size("_w") - words + 1)
        return rows.withColumn("_g", F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("_w", i, words), " "))).drop("_w")

    probe = with_grams(quotes, "quote").select("quote_id", "quote", F.get("_g", F.least(F.lit(1), F.size("_g") - 1)).alias("gram"))
    index = with_grams(docs, "source").select("doc_id", F.explode(F.array_distinct("_g")).alias("gram"))
    hits = probe.join(index, "gram").select("quote_id", "quote", "doc_id")
    return hits.join(docs, "doc_id")


def ranked_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
