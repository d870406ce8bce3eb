"""Resampling plans, paired summaries and answer matching."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.functions import answers as A
from skeinworks.operators import stats


def drawn(seed, sizes, samples):
    """Row numbers a plan must have for strata of these sizes, in order, drawn one by one."""
    g = random.Random(int(hashlib.sha256(f"{seed}\0paired-question-plan".encode()).hexdigest()[:16], 16))
    starts = np.cumsum([0, *sizes])
    return [[starts[k] + g.randrange(n) for k, n in enumerate(sizes) for _ in range(n)] for _ in range(samples)]


@pytest.mark.parametrize("sizes", [[1], [7], [1, 2, 3], [64, 5], [700, 33, 1]])
def test_plan_is_the_standard_generators(sizes):
    strata = [f"s{k}" for k, n in enumerate(sizes) for _ in range(n)]
    assert stats.resample_plan(strata, 20, 42).tolist() == drawn(42, sizes, 20)


def test_missing_strata_are_called_unknown():
    assert stats.resample_plan(["z", None, ""], 5, 1).tolist() == [[(k + 1) % 3 for k in row] for row in drawn(1, [2, 1], 5)]


def test_paired_summary(spark):
    rows = [("m", "q%d" % i, "a" if i % 2 else None, float(i), i + 2.0 if i != 3 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "metric string, q string, kind string, left_value double, right_value double")
    r = stats.paired_summary(df, ["metric"], "kind", "q").first()
    assert (r["paired"], r["missing"], r["delta_mean"], r["delta_ci_low"], r["delta_ci_high"]) == (7, 1, 2.0, 2.0, 2.0)
    assert r["left_mean"] == pytest.approx(25 / 7) and r["left_ci_low"] < r["left_mean"] < r["left_ci_high"]
    none = spark.createDataFrame([("m", "q", "a", None, 1.0)], df.schema)
    r = stats.paired_summary(none, ["metric"], "kind", "q").first()
    assert r["paired"] == 0 and r["missing"] == 1 and r["delta_mean"] is None


def test_bootstrap_spearman(spark):
    df = spark.createDataFrame([("g", f"q{i}", "s", float(i), float(i * i)) for i in range(9)], "g string, q string, s string, x double, y double")
    r = stats.bootstrap_spearman(df, ["g"], "s", "q", "x", "y", samples=50).first()
    assert r["n"] == 9 and r["spearman"] == pytest.approx(1) and r["ci_low"] == pytest.approx(1)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2021-01-02T10:00", "2021-01-02"), ("2021/1/2.", "2021-01-02"), ("2nd Jan, 2021", "2021-01-02"), ("1-2-2021", "2021-01-02"), ("2021-1", "2021-01"), ("Feb 30 2021", None), ("2021-13", None), ("12", None), ("the answer is: May 2020", "2020-05"), ("unknown", None),
    ],
)
def test_dates(raw, want):
    assert A.date_of(raw) == want


def test_days_may_come_first():
    assert A.date_of("1/2/2021", day_first=True) == "2021-02-01"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("$ 1,234.50 usd.", "1234.5"), ("1,23", None), ("5bn dollars!", "5000000000"), ("3 percentage  points", "3%"), ("−2", "-2"), ("-0", "0"), ("5. million", None), ("1 000", None), ("(5)%", None), ("£2k", "2000"), ("", None), ("()", None),
    ],
)
def test_numbers(raw, want):
    assert A.number_of(raw) == want


ANSWERS = [
    "Yes, they did.", "no", "Nope!", "The answer is yes", "Paris", "the  Big-Apple", "I can't determine from the provided context.", "Unknown", "don't know", "a an the", "", "  ", "***", "not enough info to resolve the question", "true_story", "It's 5", "Straße", "ﬁne", "5 %", "May 2020",
    "answer", "answers vary", "Truely", "Cannot answer in context\n", "C++ & C#", "O'Neil", "x\ty",
]


def test_columns_say_what_the_scanners_say(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS] + [(None,)], "a string")
    got = df.select("a", A.normalize_answer("a"), A.normalize_yes_no("a"), A.canonicalize_unanswerable("a"), A.normalize_date("a"), A.normalize_number("a")).collect()
    for a, *rest in got:
        assert rest == [A.normalize(a), A.yes_no(a), A.ABSTAIN if A.abstains(a) else None, A.date_of(a), A.number_of(a)], a


def test_matches(spark):
    df = spark.createDataFrame([("March 3, 2021", "2021-03-03"), ("$1k", "1,000"), ("yes!", "True"), ("x", "x"), (None, None)], "a string, b string")
    got = [tuple(r) for r in df.select(A.date_match("a", "b"), A.numeric_match("a", "b"), A.yes_no_match("a", "b")).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, False, False)]
