"""Scores are given for the candidates of every route."""

import difflib
import random

from skeinworks.operators import resolution as ER
from skeinworks.plans import catalogue


def test_every_candidate_has_a_score(spark):
    q, d = catalogue.queries(), "/root/testdata/sf0.001"
    keys = ["left_id", "right_id"]
    c, s = q["generate_candidates"](spark, d).select(*keys), q["score_pairs"](spark, d).select(*keys)
    assert c.count() > 0 and c.exceptAll(s).count() == 0


def test_block_ratio_is_that_of_difflib():
    rng = random.Random(3)
    some = lambda: "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 30)))
    for _ in range(4000):
        a, b = some(), some()
        assert ER.block_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    a = "ab" * 120
    assert ER.block_ratio("xab", a) == difflib.SequenceMatcher(None, "xab", a).ratio()


def test_numbers_travel_in_place_of_ids(spark):
    from skeinworks.plans import q_resolution as Q
    from skeinworks.runtime import Stage

    rows = spark.createDataFrame([(f"native_{i * 37 % 101:03d}", f"b{i % 3}") for i in range(101)], "profile_id string, normalized string")
    p, ids = Q._numbered(rows, Stage(spark, "t"))
    assert p.schema["profile_id"].dataType.simpleString() == "bigint"
    got, want = Q._named(ER.block_exact(p, 20), ids).select("left_id", "right_id"), ER.block_exact(rows, 20)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
