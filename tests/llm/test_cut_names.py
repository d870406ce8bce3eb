"""A cut-off name against all names that go on from it."""

from skeinworks.llm import survivors

from .test_spark import MEN, at


def test_a_rarer_cut_in_between_hides_no_full_name(spark):
    says = [("Acme Energy Holdi", 2), ("Acme Energy Holdin", 1), ("Acme Energy Holdings Corporation", 6)]
    m, i = [], 0
    for value, n in says:
        for _ in range(n):
            i += 1
            m.append((f"m{i}", value, "org", "It is a firm.", "good", "e1", at(30 - i), at(1)))
    trust = spark.createDataFrame([("good", 1)], "builder_model string, trust_rank int")
    got = {r["field_name"]: r["mention_id"] for r in survivors.surviving_mentions(spark.createDataFrame(m, MEN), trust).collect()}
    assert got["original_name"] == "m4"
