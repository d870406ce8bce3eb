"""Operators on small tables against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.operators import gates, graph, joins, latest, retrieval, selection, stats, vectors
from skeinworks.operators import resolution as ER


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_choices_break_ties_as_stated(spark):
    d = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "B"), ("k", None), ("k", ""), ("j", "x"), ("n", None)], "k string, v string")
    assert rows(latest.majority(d, ["k"], "v", "v")) == [("j", "x"), ("k", "B")]
    assert rows(latest.majority(d, ["k"], "v", "v", F.lower("v"))) == [("j", "x"), ("k", "B")]
    assert rows(latest.representative(spark.createDataFrame([("k", "aa"), ("k", "AA"), ("k", "z")], "k string, v string"), ["k"], "v", "v")) == [("k", "AA")]
    n = spark.createDataFrame([("k", "A B"), ("k", "A"), ("k", "A")], "k string, v string")
    assert rows(latest.display_name(n, ["k"], "v", "v")) == [("k", "A")]


def test_latest_success(spark):
    c = spark.createDataFrame([("q", True, 1, 1, "a"), ("q", False, 9, 1, "b"), ("q", True, 2, 1, "c"), ("r", False, None, 2, "d"), ("r", False, 1, 1, "e")], "k string, ok boolean, t int, n int, c string")
    assert [r["c"] for r in latest.latest_success(c, ["k"], F.col("ok"), "t", "n", "c").orderBy("k").collect()] == ["c", "e"]


def test_joins_check_their_keys(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.many_to_one(a, b, ["k"]).count() == 2
    with pytest.raises(joins.GateError):
        joins.many_to_one(b, a, ["k"])
    with pytest.raises(joins.GateError):
        joins.one_to_one(b, spark.createDataFrame([(2,)], "k int"), ["k"])
    assert rows(joins.diff_sets(b, spark.createDataFrame([(2,)], "k int"), ["k"])) == [(1, "left"), (2, "right")]


@pytest.mark.parametrize("n", [2, 30, 200])
def test_blocked_pairs_equal_the_window(spark, n):
    df = spark.createDataFrame([("b", f"i{i:04d}") for i in range(n)] + [("c", "z"), (None, "y")], "b string, i string")
    ids = [f"i{i:04d}" for i in range(n)]
    want = {(ids[i], ids[j]) for i in range(n) for j in range(i + 1, n) if n <= 40 or j - i <= 4}
    assert set(rows(joins.blocked_pairs(df, "b", "i", 40))) == want
    assert set(rows(joins.blocked_pairs(df, "b", "i", None))) == set(itertools.combinations(ids, 2))


def test_missing_pairs_and_endpoints(spark):
    m = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "c"), ("c2", "a")], "chunk string, e string")
    e = spark.createDataFrame([("c", "a")], "x string, y string")
    assert rows(joins.missing_pairs(m, "chunk", "e", e, "x", "y")) == [("c1", "a", "b"), ("c1", "b", "c")]
    r = spark.createDataFrame([("c2", "b"), ("c2", "a"), ("c2", "zz")], "chunk string, src string")
    got = joins.resolve_endpoints(r, "src", m.withColumnRenamed("e", "mention"), ["chunk"], "mention")
    assert rows(got.select("src", "src_found")) == [("a", "a"), ("b", "b"), ("zz", None)]


@pytest.mark.parametrize("seed", range(3))
def test_components_and_topology(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "source string, target string")
    assert dict(rows(graph.components(df))) == {x: find(x) for x in linked}
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(60)] + [(f"p{i:02d}",) for i in range(41)], "node string")
    t = graph.topology(nodes, "node", df, "source", "target").first()
    assert t["nodes"] == 101 and t["isolates"] == 101 - len(linked) and t["components"] == len({find(x) for x in linked}) + t["isolates"] and t["edges"] == len(edges)


def test_transitivity_of_a_triangle_with_a_tail(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (2, 1)], "a int, b int")
    assert tuple(graph.transitivity(e, "a", "b").first()) == (1, 5, 0.6)


def test_rewrite_drops_only_induced_loops(spark):
    e = spark.createDataFrame([("m1", "m2", 1, "r1"), ("m3", "m3", 1, "r2"), ("m1", "m3", 0, "r3")], "x string, y string, w int, r string")
    k = spark.createDataFrame([("m1", "e1"), ("m2", "e1"), ("m3", "e2")], "m string, e string")
    out = graph.edge_dedup(graph.rewrite_edges(e, "x", "y", k, "m", "e"), "source_entity", "target_entity", "w", "r")
    assert rows(out.select("source", "target", "weight")) == [("e1", "e2", 1), ("e2", "e2", 1)]


PROFILE = [("Apple Inc.", "organization", "d1", "c1", "maker of phones"), ("Apple", "company", "d1", "c1", "maker of phones"), ("Apple Fruit", "fruit", "d2", "c2", None), ("A F", "fruit", "d2", "c2", None), ("apple inc.", "organization", "d3", "c3", None)]


def test_resolution_end_to_end(spark):
    m = spark.createDataFrame(PROFILE, "original_name string, entity_type string, document_id string, chunk_id string, description string")
    p = ER.profiles(m)
    name = {r["profile_id"]: r["original_name"] for r in p.collect()}
    named = lambda df: {tuple(sorted((name[a], name[b]))) for a, b, *_ in rows(df)}
    assert named(ER.block_exact(p)) == {("Apple Inc.", "apple inc.")}
    assert ("Apple", "Apple Fruit") in named(ER.block_containment(p)) and ("A F", "Apple Fruit") in named(ER.block_acronym(p))
    assert ("Apple Inc.", "apple inc.") in named(ER.block_fuzzy(p))
    pairs = ER.candidates({"exact": ER.block_exact(p), "part": ER.block_containment(p)})
    s = {tuple(sorted((name[r["left_id"]], name[r["right_id"]]))): r for r in ER.score(ER.pair_signals(ER.with_profiles(pairs, p))).collect()}
    exact = s["Apple Inc.", "apple inc."]
    assert exact["name_exact"] == 1.0 and exact["description"] is None and exact["embedding"] is None and 0 < exact["score"] <= 1
    weights = {k: v for k, v in ER.WEIGHTS.items() if exact[k] is not None}
    assert exact["score"] == pytest.approx(sum(v * exact[k] for k, v in weights.items()) / sum(weights.values()))


def test_constrained_clusters_respect_vetoes(spark):
    d = [("p1", "a", "b", "merge", 0.9), ("p2", "b", "c", "merge", 0.8), ("p3", "a", "c", "reject", 0.1), ("p4", "c", "d", "merge", 0.7), ("p5", "x", "y", "reject", 0.1), ("p6", "e", "e", "merge", 0.9)]
    df = spark.createDataFrame(d, "pair_id string, left_id string, right_id string, action string, score double")
    members, blocked = ER.constrained_clusters(df)
    assert rows(members) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")] and rows(blocked) == [("p2",)]


def test_decisions_and_mutual_top_k(spark):
    s = spark.createDataFrame([("p1", "a", "b", 0.8), ("p2", "a", "c", 0.6), ("p3", "b", "c", 0.3), ("p4", "c", "d", None)], "pair_id string, left_id string, right_id string, score double")
    got = ER.decide(s, F.col("pair_id") == "p2", F.lit("reject"))
    assert [r["action"] for r in got.orderBy("pair_id").collect()] == ["merge", "reject", "reject", "abstain"]
    assert rows(ER.mutual_top_k(s.dropna(), 1).select("pair_id")) == [("p1",)]


def test_unique_display_names(spark):
    e = spark.createDataFrame([("entity_000001", "Apple", "org"), ("entity_000002", "apple", "fruit"), ("entity_000003", "Pear", "fruit"), ("entity_000004", "Fig", None), ("entity_000005", "Fig", None)], "e string, n string, t string")
    names = [r["unique_name"] for r in ER.unique_display_names(e, "e", "n", F.col("t")).orderBy("e").collect()]
    assert names == ["Apple (org)", "apple (fruit)", "Pear", "Fig [000004]", "Fig [000005]"]


def test_rank_metrics(spark):
    m = retrieval.retrieval_metrics(F.col("f"), F.col("g"), F.col("a"))
    d = spark.createDataFrame([(["x", "b", "y", "z", "w", "a"], ["a", "b"], True), ([], ["a"], True), (["a"], [], False)], "f array<string>, g array<string>, a boolean")
    got = [tuple(r) for r in d.select(*[c.alias(k) for k, c in m.items()]).collect()]
    assert got == [(2, 1, 1.0, 0.5, 0), (None, 0, 0.0, 0.0, 0), (None, None, None, None, None)]
    r = spark.createDataFrame([("r", ["a<SEP>b", "b|c", " ", "a"])], "k string, ids array<string>")
    assert rows(retrieval.rank_documents(r, "k", "ids")) == [("r", "a", 1), ("r", "b", 2), ("r", "c", 3)]


def test_statistics(spark):
    d = spark.createDataFrame([("t", f"q{i}", float(i % 2)) for i in range(20)] + [("t", "q99", None)], "t string, q string, v double")
    r = stats.bootstrap_mean(d.withColumn("g", F.lit("x")), ["g"], "t", "q", "v", samples=300).first()
    assert r["n"] == 20 and r["mean"] == 0.5 and r["ci_low"] < 0.5 < r["ci_high"]
    x = spark.createDataFrame([(float(i), v) for i, v in enumerate([1.0, 2.0, 2.0, 9.0])], "a double, b double")
    assert stats.spearman(x, [], "a", "b").first()["spearman"] == pytest.approx(0.9486833)
    c = spark.createDataFrame([("a", 1, 9), ("b", 0, 0), ("c", 5, 5)], "k string, lost long, gained long")
    p = {r["k"]: r["p_value"] for r in stats.mcnemar(c).collect()}
    assert p["a"] == pytest.approx(0.021484375) and p["b"] == 1.0 and p["c"] == 1.0
    h = {r["k"]: r["p_holm"] for r in stats.holm(stats.mcnemar(c), [], "p_value", "k").collect()}
    assert h["a"] == pytest.approx(3 * 0.021484375) and h["b"] == 1.0
    f = spark.createDataFrame([("g", 1.0, 1.0, "a"), ("g", 2.0, 1.0, "b"), ("g", 3.0, 2.0, "c"), ("g", 1.0, 0.5, "d")], "g string, cost double, q double, t string")
    assert [r["t"] for r in stats.pareto_front(f, ["g"], "cost", "q", "t").orderBy("t").collect()] == ["a", "c"]


def test_lsh_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    x[150:] = x[:150] + 0.1 * rng.standard_normal((150, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16)], "i long, v array<double>")
    got = {(a, b) for a, b, *_ in rows(vectors.lsh_knn(df, "i", "v", 16, 3, tables=8, bits=5))}
    assert sum((i, i + 150) in got for i in range(150)) >= 145
    small = {(a, b) for a, b, *_ in rows(vectors.lsh_knn(df, "i", "v", 16, 3, tables=8, bits=1, max_bucket=20))}
    assert small
    assert vectors.reciprocal(vectors.lsh_knn(df, "i", "v", 16, 3)).count() > 0


def test_selection(spark):
    q = selection.balanced_quotas(spark.createDataFrame([(x,) for x in ["a", "b", "c", "a", None]], "g string"), "g", 10, "s")
    assert sorted(r["quota"] for r in q.collect()) == [3, 3, 4] and selection.balanced_quotas(q.limit(0), "g", 3, "s").count() == 0
    turns = [r["g"] for r in selection.quota_schedule(spark.createDataFrame([("a", 1), ("b", 3), ("c", 2), ("d", 0)], "g string, quota long"), "g").orderBy("position").collect()]
    assert turns == ["a", "b", "c", "b", "c", "b"]
    d = spark.createDataFrame([(f"i{i:02d}", float(-i), "s1" if i < 6 else "s2") for i in range(12)], "i string, v double, s string")
    assert [r["i"] for r in selection.greedy_select(d, "i", "v", {"s": 2}, 3).orderBy("position").collect()] == ["i00", "i01", "i06"]
    assert selection.stratified_sample(d, "s", "i", spark.createDataFrame([("s1", 2), ("s2", 1)], "s string, quota long"), "x").groupBy("s").count().orderBy("s").collect()[0]["count"] == 2
    s = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0), ("q", "d", 0.0)], "q string, d string, score double")
    g, n = spark.createDataFrame([("q", "a")], "q string, d string"), spark.createDataFrame([("q", "b")], "q string, d string")
    assert rows(selection.hard_negatives(s, g, n, "q", "d", 5).select("d")) == [("c",)]


def test_gates(spark):
    bad = spark.createDataFrame([("a",), ("a",), (None,), (" ",)], "k string")
    g = gates.report({"repeated": gates.repeated(bad, "k"), "unknown": gates.unknown(bad, "k", spark.createDataFrame([("a",)], "k string"), "k")})
    assert rows(g) == [("repeated", 3), ("unknown", 2)]
    with pytest.raises(joins.GateError):
        gates.require_pass(g)
    gates.require_pass(g, ("repeated", "unknown"))


def test_jaccard_of_every_pair(spark):
    s = {"a": {1, 2, 3}, "b": {2, 3}, "c": {9}}
    df = spark.createDataFrame([(k, i) for k, v in s.items() for i in v] + [("a", 1), (None, 1)], "g string, i int")
    want = [(p, q, len(s[p] & s[q]), round(len(s[p] & s[q]) / len(s[p] | s[q]), 6)) for p, q in itertools.combinations_with_replacement("abc", 2)]
    assert rows(graph.jaccard_matrix(df, "g", "i")) == sorted(want, key=repr)


def test_local_edges_of_an_item_of_every_group(spark):
    # the hub is in every group and on every edge: each edge is local to one group only
    n = 300
    m = spark.createDataFrame([(g, "hub") for g in range(n)] + [(g, f"x{g}") for g in range(n)] + [(0, "x0"), (1, None)], "g int, i string")
    e = spark.createDataFrame([("hub", f"x{g}", g) for g in range(n)] + [("x0", "x1", -1), ("nobody", "hub", -2)], "a string, b string, w int")
    assert sorted((r["a"], r["b"], r["g"]) for r in joins.local_edges(e, "a", "b", m, "g", "i").collect()) == sorted(("hub", f"x{g}", g) for g in range(n))
    # what a join hands on is bounded by the edges and groups, not by their product
    probe = joins.local_edges(e, "a", "b", m, "g", "i")
    probe.collect()
    assert most_rows(probe._jdf.queryExecution().executedPlan()) <= 4 * n


def most_rows(plan) -> int:
    """The most rows that one operator of an executed plan gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return most_rows(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return most_rows(plan.plan())
    made = plan.metrics().get("numOutputRows")
    below = plan.children()
    return max([made.get().value() if made.isDefined() else 0, *(most_rows(below.apply(i)) for i in range(below.size()))])


def test_pipeline_with_a_judge(spark):
    from skeinworks.plans import pipeline

    m = spark.createDataFrame(PROFILE + [("Apple Incorporated", "organization", "d4", "c4", None)], "original_name string, entity_type string, document_id string, chunk_id string, description string")
    asked = []
    out = pipeline.resolve_entities(m, judge=lambda prompts: ["same_entity" if "Incorporated" in p else "uncertain" for p in prompts])
    g = {r[0]: r[1] for r in rows(pipeline.resolution_gates(out))}
    assert not any(g.values()), g
    actions = {r["action"] for r in out["decisions"].collect()}
    assert "merge" in actions and out["entities"].count() < out["profiles"].count() and not asked


def test_pipeline_meets_every_pair_of_a_large_block(spark):
    from skeinworks.plans import pipeline

    n = 210
    names = ["".join(c.upper() if i >> k & 1 else c for k, c in enumerate("acmecorp")) for i in range(n)]
    m = spark.createDataFrame([(x, "organization", f"d{i}", f"c{i}", None) for i, x in enumerate(names)], "original_name string, entity_type string, document_id string, chunk_id string, description string")
    got = pipeline.resolve_entities(m)["candidates"].where("methods = 'acronym,containment,exact_name,fuzzy_name'").count()
    assert got == n * (n - 1) // 2


def test_model_calls_retry_and_cache(spark):
    from skeinworks.operators import models

    r = spark.createDataFrame([("a",), ("a",), ("b",), ("bad",)], "prompt string").withColumn("cache_key", models.cache_key(F.col("prompt")))
    assert models.pending(r, r.where("prompt = 'a'")).count() == 2

    def fn(prompts):
        if "bad" in prompts:
            raise TimeoutError("slow")
        return [p.upper() for p in prompts]

    out = models.call(models.pending(r, None), fn, batch=1)
    got = {x["prompt"]: (x["response"], x["attempts"]) for x in r.join(out, "cache_key").collect()}
    assert got == {"a": ("A", 1), "b": ("B", 1), "bad": (None, 3)}
    c = models.inspect_response(F.col("prompt"), ("x",))
    d = spark.createDataFrame([('{"x": 1}',), ("[1]",), ("no",), (None,)], "prompt string")
    assert [tuple(x) for x in d.select(*c.values()).collect()] == [(True, True), (True, False), (False, False), (False, False)]


def test_evidence(spark):
    from skeinworks.operators import relations

    a = spark.createDataFrame([("r1", "c1", "A", "B", " is in "), ("r2", "c1", "A", "C", "nope"), ("r3", "c9", "A", "D", ""), ("r4", "c1", "E", "F", "A is in B")], "relation_id string, chunk_id string, source string, target string, quote string")
    k, e = spark.createDataFrame([("c1", "A is in B.")], "chunk_id string, content string"), spark.createDataFrame([("B", "A")], "source string, target string")
    assert rows(relations.evidence_checks(a, k, e)) == [("r1", "already_an_edge"), ("r2", "quote_not_in_chunk"), ("r3", "no_quote"), ("r3", "unknown_chunk")]


def test_coalesce_relations_keeps_the_first_direction(spark):
    from skeinworks.operators import relations

    r = spark.createDataFrame([("c", "a", "b", "X", 2), ("c", "b", "a", "y", 1), ("c", "a", "b", "x", 3), ("c", "a", "a", "z", 0)], "chunk string, s string, t string, k string, p int")
    assert rows(relations.coalesce_relations(r, ["chunk"], "s", "t", "k", "p")) == [("c", "b", "a", 3, "y|X")]


@pytest.mark.parametrize("name", ["blocked", "components", "jaccard", "bm25"])
def test_empty_tables(spark, name):
    e = spark.createDataFrame([], "a string, b string")
    out = {
        "blocked": lambda: joins.blocked_pairs(e, "a", "b", 10),
        "components": lambda: graph.components(e, "a", "b"),
        "jaccard": lambda: graph.jaccard_matrix(e, "a", "b"),
        "bm25": lambda: retrieval.bm25(retrieval.bm25_index(e, "a", "b"), "a", e.withColumnsRenamed({"a": "q"}), "q", "b"),
    }[name]()
    assert out.count() == 0
