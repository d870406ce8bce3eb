"""Audits with planted violations, hard negatives, judge and embedding calls, route helpers."""

import difflib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinworks.functions import text as T
from skeinworks.operators import audits, gates, models, selection
from skeinworks.operators import resolution as ER


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def counts(checks):
    return {r[0]: r[1] for r in rows(gates.report(checks))}


def test_extraction_audit(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    k = spark.createDataFrame([("c1", "d1"), ("c2", "d1")], "chunk_id string, document_id string")
    calls = [("a", "d1", "c1", 1, "x", sha("x"), "v1", False), ("b", "d1", "c2", 1, "y", sha("z"), "v1", True), ("b", "d1", "c2", 1, "y", sha("y"), "v0", False), ("", "d1", "c2", 1, "y", sha("y"), "v1", None), ("e", "d9", "c1", 1, None, None, None, False)]
    calls = spark.createDataFrame(calls, "call_id string, document_id string, chunk_id string, attempt int, response string, response_sha256 string, capture_version string, response_mutated boolean")
    assert rows(audits.raw_responses(calls, k)) == [("",), ("b",), ("b",), ("e",)]
    assert audits.capture(calls, "v1").count() == 4
    m = [("m1", "c1", "d1", "a", "text", True), ("m2", "c1", "d1", "b", "text", True), ("m3", "c9", "d1", "a", None, False), ("m4", "c1", "d1", "a", " ", True), ("m5", "c1", "d1", "a", None, False), ("m5", "c1", "d1", "a", None, False)]
    m = spark.createDataFrame(m, "mention_id string, chunk_id string, document_id string, call_id string, description string, has_description boolean")
    assert rows(audits.mention_lineage(m, k, calls)) == [("m2",), ("m3",), ("m4",), ("m5",)]
    r = spark.createDataFrame([("r1", "c1", "m1", "m2"), ("r2", "c1", "m1", "m3"), ("r3", "c2", "m1", "m2"), ("r1", "c1", "m1", "m2"), ("r4", "c1", None, "m1")], "relation_id string, chunk_id string, source string, target string")
    assert rows(audits.relation_lineage(r, m)) == [("r1",), ("r2",), ("r3",), ("r4",)]
    assert rows(audits.presence(k.withColumn("f", F.lit(True)), m, "f").select("chunk_id")) == [("c2",)]
    one = spark.createDataFrame([(True, 2)], "staging_complete boolean, chunks int")
    assert audits.declared(one, staging_complete=True).count() == 0 and audits.declared(one, chunks=3).count() == 1
    assert audits.declared_count(one, "chunks", k).count() == 0 and audits.declared_count(one, "chunks", m).count() == 1


def test_resolution_and_recovery_audits(spark):
    c = [("a", "b", "acronym", 0.1, None, None, False), ("b", "a", "acronym", 0.9, None, None, False), ("a", "c", "magic", 0.9, None, None, False), ("a", "d", "fuzzy_name", 0.69, None, None, False), ("a", "e", "embedding_neighbour", None, 0.5, 0.75, False), ("a", "f", "embedding_neighbour", None, 0.5, 0.7, False), ("a", "g", "embedding_neighbour", None, 1.0, 1.0, True)]
    c = spark.createDataFrame(c, "left_id string, right_id string, methods string, lexical double, cosine double, embedding double, reciprocal boolean")
    bad = audits.route_evidence(c, ["acronym", "fuzzy_name", "embedding_neighbour", "reciprocal_embedding_neighbour"], 0.7)
    assert rows(bad.select("left_id", "right_id")) == [("a", "c"), ("a", "d"), ("a", "f"), ("a", "g"), ("b", "a")]
    members = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "3"), ("i", "4"), ("h", "4")], "grp string, item string")
    mapping = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x"), ("4", None)], "item string, e string")
    assert rows(audits.split_groups(members, "grp", mapping, "item", "e").select("grp")) == [("g",), ("h",), ("i",)]
    assert rows(audits.groups_disjoint(members, "grp", "item").select("item")) == [("4",)]
    h = spark.createDataFrame([("a" * 64, "a" * 64), ("a" * 64, "b" * 64), ("A" * 64, "A" * 64), (None, "a" * 64)], "p string, q string")
    assert audits.bad_hashes(h, ["p", "q"]).count() == 3 and audits.other_keys(h, "p", F.col("q")).count() == 2
    plan, res = spark.createDataFrame([("c1",), ("c2",)], "c string"), spark.createDataFrame([("c2",), ("c2",), ("c3",)], "c string")
    assert rows(audits.result_set(res, plan, "c")) == [("c1",), ("c2",), ("c3",)] and audits.changed_plan(plan, res).count() == 3
    before, after = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string"), spark.createDataFrame([("b", "a"), ("x", "x"), ("y", "y")], "source string, target string")
    assert rows(audits.lost_edges(before, after)) == [("b", "c")]
    e = spark.createDataFrame([("1", "2"), ("3", "3")], "source string, target string")
    mp = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "i string, e string")
    assert counts(audits.loop_audit(e, mp, "i", "e", after)) == {"er_induced_self_loops_removed": 1, "preexisting_self_loops_retained_only": 1}
    d = spark.createDataFrame([("judge",)] * 3 + [("score",)], "source string")
    assert audits.over_budget(d, 3).count() == 0 and audits.over_budget(d, 2).count() == 1
    v = spark.createDataFrame([("valid", 2), ("failed", 1), (None, 1), ("failed", 0)], "status string, n_relations int")
    assert audits.invalid_with_relations(v).count() == 2


def test_subset_and_cascade_audits(spark):
    q = spark.createDataFrame([("q1", "t", ["a"]), ("q1", "t", ["a", "a"]), ("q2", "u", ["z"]), ("q3", "u", None)], "question_id string, question_type string, document_ids array<string>")
    d = spark.createDataFrame([("a", "gold", "x"), ("b", "gold", "y"), ("c", "other", "y"), ("c", "hard_negative", " ")], "document_id string, role string, text string")
    per = spark.createDataFrame([("t", 2), ("w", 1)], "question_type string, quota long")
    got = counts(audits.subset_audit(q, d, spark.createDataFrame([("q2",)], "question_id string"), per, 4))
    assert got == {"exact_question_count": 0, "exact_type_balance": 2, "no_duplicate_question_ids": 1, "no_duplicate_document_ids": 1, "no_duplicate_document_bodies": 1, "no_pilot_question_overlap": 1, "mapping_covers_every_question_exactly": 2, "gold_documents_present": 1, "every_gold_document_used": 1, "roles_known": 1, "texts_not_blank": 1}
    s = spark.createDataFrame([("b1", "er", "N", "E", 5), ("b1", "er", "N", "E", 5), ("b2", "er", "E", "N", 4), ("b9", "zz", "N", "E", 5)], "builder string, role string, left_regime string, right_regime string, paired_question_count int")
    kept, checks = audits.cascade(s, spark.createDataFrame([("b1",), ("b2",), ("b3",)], "builder string"), [("er", "N", "E")], 5)
    assert counts(checks) == {"builders_and_roles_complete": 2, "one_summary_per_builder_and_role": 1, "contrast_as_planned": 2, "paired_question_count": 1} and kept.count() == 2


def test_facility_negatives_equal_a_plain_greedy(spark):
    rng = random.Random(5)
    data = [(f"q{q}", f"d{d:02d}", rng.choice([0.0, 1.0, 2.0, 3.5])) for q in range(12) for d in range(25) if rng.random() < 0.4]
    docs = [(f"d{d:02d}", f"s{d % 3}") for d in range(25)]
    s, k = spark.createDataFrame(data, "q string, d string, score double"), spark.createDataFrame(docs, "d string, src string")
    got = [(r["d"], r["gain"]) for r in selection.facility_negatives(s, k, "q", "d", 10, {"src": 2}, "x").orderBy("position").collect()]
    best = {}
    for q, _, v in data:
        best[q] = max(best.get(q, 0), v)
    rel = {}
    for q, d, v in data:
        if v > 0:
            rel.setdefault(d, {})[q] = v / best[q]
    cover, used, cap, want = {}, {}, 2, []
    src = dict(docs)
    while len(want) < min(10, len(rel)):
        free = [d for d in rel if d not in dict(want) and used.get(src[d], 0) < cap]
        if not free:
            cap += 1
            continue
        gain = {d: sum(max(0, v - cover.get(q, 0)) for q, v in rel[d].items()) for d in free}
        top = max(round(g, 9) for g in gain.values())
        tied = [d for d in free if abs(gain[d] - top) < 1e-9]
        d = got[len(want)][0]
        assert d in tied and used.get(src[d], 0) == min(used.get(src[x], 0) for x in tied)
        want.append((d, top))
        used[src[d]] = used.get(src[d], 0) + 1
        for q, v in rel[d].items():
            cover[q] = max(cover.get(q, 0), v)
    assert [d for d, _ in got] == [d for d, _ in want] and [g for _, g in got] == pytest.approx([g for _, g in want])
    assert selection.facility_negatives(s.limit(0), k, "q", "d", 3, {"src": 1}, "x").count() == 0


def test_facility_negatives_leave_documents_on_the_executors(spark):
    # few documents reach the driver at a time, and the choice is that of all at once
    s = spark.range(4000).selectExpr("id as d", "explode(sequence(0, 19)) as q").selectExpr("q", "d", "round(pmod(hash(q, d), 997) / 100.0, 2) as score").withColumn("score", F.col("score").cast("double"))
    k = spark.range(4000).selectExpr("id as d", "cast(id % 3 as string) as src", "cast(nullif(id % 7, 0) as string) as cat")
    caps = {"src": 3, "cat": 2}
    few, all_ = ([tuple(r) for r in selection.facility_negatives(s, k, "q", "d", 25, caps, "x", keep=n).orderBy("position").collect()] for n in (2, 4000))
    assert few == all_ and len(few) == 25
    old = spark.conf.get("spark.driver.maxResultSize", "1g")
    try:
        spark.sparkContext._jsc.sc().conf().set("spark.driver.maxResultSize", "400k")
        assert [tuple(r) for r in selection.facility_negatives(s, k, "q", "d", 25, caps, "x", keep=16).orderBy("position").collect()] == all_
    finally:
        spark.sparkContext._jsc.sc().conf().set("spark.driver.maxResultSize", old)


def test_answer_holders_read_whole_texts(spark):
    d = spark.createDataFrame([(1, "x " * 5000 + "Port, Reva!"), (2, "airport reva"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([("q1", "Port Reva"), ("q2", "port-reva"), ("q3", "Yes"), ("q4", None), ("q5", "...")], "q string, answer string")
    assert rows(selection.answer_holders(d, "doc_id", "text", q, "q", "answer")) == [("q1", 1), ("q2", 1)]
    assert rows(selection.answer_holders(d, "doc_id", "text", q, "q", "answer", max_bytes=70)) == [("q1", 1), ("q2", 1)]
    assert rows(selection.answer_holders(d, "doc_id", "text", q.limit(0), "q", "answer")) == []


def test_judge_is_asked_again_only_with_a_full_context(spark):
    good = json.dumps({"relationship": "same_entity", "rationale": " both "})

    def fn(prompts):
        return [{"full a": (good, 5), "full b": ("no json", 99), "short b": (good, 5), "full c": ("[1]", 5), "full d": ("", 99), "short d": (json.dumps({"relationship": "maybe", "rationale": "x"}), 3)}[p] for p in prompts]

    r = spark.createDataFrame([(k, f"full {k}", f"short {k}") for k in "abcd"] + [("a", "full a", "short a")], "cache_key string, full string, short string")
    got = rows(models.judge(r, fn, ["full", "short"], 100).select("cache_key", "relationship", "rationale", "problem", "prompt"))
    assert got == [("a", "same_entity", "both", None, "full"), ("b", "same_entity", "both", None, "short"), ("c", None, None, "no_object", "full"), ("d", None, None, "unknown_relationship", "short")]
    odd = [json.dumps(x) for x in ({"relationship": "uncertain"}, {"relationship": "uncertain", "rationale": "x", "more": 1}, {"relationship": "uncertain", "rationale": " "}, {"relationship": "uncertain", "rationale": 3})]
    df = spark.createDataFrame([(x,) for x in odd], "r string")
    assert [r[0] for r in df.select(models.judge_verdict(F.col("r"))["problem"]).collect()] == ["other_fields", "other_fields", "no_rationale", "no_rationale"]


def test_equal_texts_are_embedded_once(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "id string, profile_text string")
    vec = lambda texts: [[float(ord(t)), 1.0] for t in texts]
    out, cache = models.embed(p, vec, 2, model="m1")
    assert cache.count() == 2 and [(r["id"], r["embedding"]) for r in out.orderBy("id").collect()] == [("a", [120.0, 1.0]), ("b", [120.0, 1.0]), ("c", [121.0, 1.0]), ("d", None)]

    def never(texts):
        raise AssertionError(texts)

    assert models.embed(p, never, 2, cache=cache, model="m1")[1].count() == 2
    with pytest.raises(Exception, match="finite"):
        models.embed(p, lambda texts: [[0.0, 0.0] for _ in texts], 2)[0].count()


def test_letters_bound_the_similarity():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde é") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    a, b = pd.Series(words), pd.Series(words[::-1])
    bound = ER.letter_bound(a, b)
    assert all(u >= difflib.SequenceMatcher(None, x, y).ratio() - 1e-9 for u, x, y in zip(bound, a, b) if x or y)


def test_embedding_route_and_context(spark):
    n = spark.createDataFrame([("a", "b", 0.9, 1), ("b", "a", 0.9, 2), ("c", "a", -1.2, 1), ("a", "a", 1.0, 3)], "id string, neighbour string, cosine double, rank int")
    assert rows(ER.block_embedding(n)) == [("a", "b", 0.9, 1, 2, True, 0.95), ("a", "c", -1.2, None, 1, False, 0.0)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "left_id string, right_id string")
    c = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x"), ("c", "z"), ("d", None)], "profile_id string, x string")
    assert rows(ER.context_overlap(pairs, c, "o").select("left_id", "right_id", "o")) == [("a", "b", 0.5), ("a", "c", 0.0), ("a", "d", None)]


def test_vetoes_cross_clusters():
    pairs = [(1.0, "p1", "a", "b"), (0.9, "p2", "c", "d"), (0.8, "p3", "b", "c"), (0.7, "p4", "d", "e")]
    root, blocked = ER._cluster(pairs, {("a", "d")})
    assert blocked == ["p3"] and root == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}


def test_surface_keys_and_whole_mention_profiles(spark):
    df = spark.createDataFrame([("  Straße X",), ("ＡＢＣ",), ("A  b\t",), (None,)], "a string")
    assert [r[0] for r in df.select(T.surface_key(F.col("a"))).collect()] == ["strasse x", "ＡＢＣ".casefold(), "a b", None]
    names = ["Ａcme", "acme", "ACME ", "Straße", "STRASSE", None]
    m = spark.createDataFrame([(f"m{i}", n, f"d{i % 2}") for i, n in enumerate(names)], "mention_id string, original_name string, document_id string")
    got = {r["mention_id"]: (r["frequency"], r["diversity"]) for r in ER.mention_profiles(m).collect()}
    assert got == {"m0": (3, 2), "m1": (3, 2), "m2": (3, 2), "m3": (2, 2), "m4": (2, 2)}
