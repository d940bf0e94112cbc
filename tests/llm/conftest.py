from __future__ import annotations

import random

import pytest

#: Extra columns that carry names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, rep int, n int, part int, size int, kept int, rate double, group int, id int, bins int"


def rows_of(texts, langs=None, sources=None):
    return [(i, t, (langs or {}).get(i), (sources or {}).get(i), None, 1, 1, 1, 1, 1, 1, 1.0, 1, 1, 1) for i, t in texts]


def prose(draw, n):
    return " ".join("".join(draw.choice(["ra", "ti", "on", "el", "ku", "sh"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null and empty texts, exact and near copies, repeated lines and passages, one long text, repeated rows."""
    draw = random.Random(3)
    base, passage = prose(draw, 300), prose(draw, 70)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, base.replace(" ra ", " zu ", 1) + " end"), (6, "word"), (7, "word"), (8, "one two three")]
    out += [(9, prose(draw, 80) + "\n" + passage + "\n" + prose(draw, 60)), (10, prose(draw, 50) + " " + passage + " ü" + prose(draw, 40)), (11, "ab " * 300), (12, prose(draw, 30000))]
    for i in range(13, 60):
        lines = [prose(draw, draw.randint(3, 14)) for _ in range(draw.randint(1, 6))]
        out.append((i, "\n".join(lines)))
    for i in range(60, 80):
        words = out[i - 45][1].split(" ")
        words[draw.randrange(len(words))] = "changed"
        out.append((i, " ".join(words) + ("\n" + out[20][1] if i % 4 == 0 else "")))
    out += [(20, out[20][1]), (None, prose(draw, 20))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    draw = random.Random(4)
    return spark.createDataFrame(rows_of(texts, {i: draw.choice(["x", "y", None]) for i, _ in texts}, {i: draw.choice(["s1", "s2", "t", None]) for i, _ in texts}), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
