"""Documents prepared in one go against the columns of the same rules, and the plans that rest on it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import grounding, normalize, prepare, redact, replies, segment
from lexloom.plans import catalogue

SF = "/root/testdata/sf0.001"

_BITS = (
    "1. Aa ", "2) Bb ", "\n3.  Qq ", "\n4. Dd", "\n5. Ee long enough to be a clause of its own", "SECTION 1. ", "Clause IV: ", "part 2", "\nARTICLE II — ", "\nARTICLE III.\n", "1.1 Cc ", "2.3. Dd ", "(a) Xx ", "\n(b) Bb ", "\n(iv) Vv ",
    "\n", "\n\n", "\n\n\n", " ", "  ", "\t", "\r\n", "\r", " ", " ", "　", "﻿", "​​", "\u0085", "\x01", "\x1c", "\x00", "a-\nb", "A-\nB", "word word word word word words ", "short",
    "2341 2341 2346", "234123412346", "2341-2341-2346", " x_234123412346", "me.x+y@mail.example.com", "@", "ABCDE1234F", "HDFC0ABC123", "+91 9876543210", "9876543210", "A/C No: 123456789012", "acKount 1234567890", "ACCOUNT No. : 123456789",
    "“Quoted", "é", "İ", "ﬁ", "①", "ſ", "１２", "😀", "—", ".", ":", ")", "x" * 3000, "\n\n" + "y " * 1500,
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_go_is_what_the_columns_are(spark):
    """One row for each document gives what rows for each piece give."""
    dice = random.Random(3)
    rows = [(0, None), (1, ""), *((k, "".join(dice.choice(_BITS) for _ in range(dice.choice((3, 10, 30, 60))))) for k in range(2, 1500))]
    docs = spark.createDataFrame(rows, "k long, text string").repartition(4)
    columns = ["k", "idx", "label", "text", "start", "end"]
    want = segment.clauses(redact.redacted(docs.withColumn("text", normalize.normalized(F.col("text")))), ["k"]).select(columns).collect()
    assert len(want) > 1500 and sorted(map(str, want)) == sorted(map(str, prepare.clauses(docs, ["k"]).select(columns).collect()))


def test_more_clauses_than_are_kept(spark):
    text = "\n".join(f"{n}. Clause number {n} is long enough to stand alone." for n in range(1, 101))
    docs = spark.createDataFrame([(1, text)], "k long, text string")
    assert [r.idx for r in prepare.clauses(docs, ["k"]).orderBy("idx").collect()] == list(range(80))


@pytest.mark.parametrize("name", ["diff_ordered", "compare_verdict"])
def test_drafts_are_not_joined(spark, name):
    """both drafts come in one row."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "SortMergeJoin" not in text and "collect_list" not in text


def test_folding_makes_its_text_once(spark):
    """lower case stood three times in a condition, and each time all white space was looked for again."""
    made = spark.createDataFrame([("a",)], "t string").select(T.folded(F.concat("t", "t")).alias("f"))
    assert plan(made).count("regexp_replace(") == 1
    odd = ["  A\n\nb\tC ", "a  B", "“Q”—’s", "İx  Y", "", None, " \n", "a b", "x\x0by\r\nz"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(T.folded(F.col("t")).alias("f"), grounding.verified(F.col("t"), F.col("t")).alias("v")).collect()
    assert [r.f for r in rows] == ["a b c", "a b", "\"q\"-'s", "i̇x y", "", None, "", "a b", "x y z"]
    assert [r.v for r in rows] == [True, True, True, True, False, False, False, True, True]


@pytest.mark.parametrize("name", ["ground_answers", "ask_pipeline"])
def test_answers_stay_in_their_row(spark, name):
    """clauses and replies of a document are neither stored nor joined again for each provider."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert not any(x in text for x in ("InMemoryRelation", "SortMergeJoin", "Window", "collect_list"))


def test_later_replies_are_read_when_needed(spark):
    """where an earlier reply holds an object, later ones are not read."""
    rows = spark.createDataFrame([("{}", None)], "a string, b string").withColumn("b", F.when(F.col("b").isNull(), F.raise_error(F.lit("read"))).otherwise(F.col("b")))
    assert tuple(replies.first_parsed(rows, {"x": "a", "y": "b"}).select("source", "reply").first()) == ("x", "{}")
