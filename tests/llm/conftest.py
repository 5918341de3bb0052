"""Small tables with what the operators must cope with: nulls, empty and long texts, repeats, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def make_rows():
    rows = [(i, prose(i, 60 + 7 * i), "en" if i % 3 else "de", f"s{i % 2}") for i in range(30)]
    a, b = prose(100, 300), prose(101, 120)
    words = a.split(" ")
    near = words[:150] + ["changed"] + words[151:]
    rows += [(40, a, "en", "s0"), (41, a, "en", "s1"), (42, " ".join(near), "en", "s1"), (43, a.upper(), None, None),
             (44, prose(44, 80) + " " + b + " " + prose(45, 80), "en", "s0"), (45, prose(46, 40) + " " + b + " " + prose(47, 90), "de", None),
             (46, None, "en", "s0"), (47, "", "en", None), (48, "  \n\t ", None, "s0"), (49, "one two", "en", "s0"), (50, "one  two", "en", "s1"),
             (None, prose(51, 90), "en", "s0"), (None, None, None, None), (52, prose(52, 9000), "en", "s0"), (40, a, "en", "s0"),
             (53, "x" * 30000 + " é日本 🙂 " + "y " * 200, "fr", "s2")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


ROWS = make_rows()
CLASH = ("_row", "key", "n", "sid", "node", "component", "found", "_qualab_x", "length", "piece", "a", "b", "_p", "_spans", "doc", "label_")


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS).repartition(3, "n_chars")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(30)] + [(46, 1, 1), (None, 1, 1), (999, 1, 0), (1, 1, None), (2, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
