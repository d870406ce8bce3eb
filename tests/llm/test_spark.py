"""Operators over small tables: nulls, repeats, ties, empty tables, clashing columns, brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.llm import answers, components, leakage, mixing, names, neighbours, quantiles, reading, splitting, survivors

T0 = datetime.datetime(2024, 1, 1)


def at(n):
    return T0 + datetime.timedelta(hours=n)


def noisy(df):
    """Extra columns whose names clash with what operators use inside."""
    return df.withColumns({"label": F.lit("x"), "u": F.lit(1), "key": F.lit("k"), "n": F.lit(0), "rank": F.lit(9), "x": F.lit(None).cast("string"), "value": F.lit("v"), "at": F.lit("a")})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components_of_any_shape(spark, kind):
    rng = random.Random(7)
    edges = {
        "path": [(i, i + 1) for i in range(120)],
        "star": [(0, i) for i in range(1, 150)] + [(0, 5), (5, 0), (3, 3)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "none": [(None, 1), (2, None), (4, 4)],
    }[kind]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {}
    for v, label in rows(components.components(df, beta=0.3, rounds=3)):
        got.setdefault(label, set()).add(v)
    assert {frozenset(g) for g in got.values()} == brute_components(edges)


DEC = "pair_id string, left_mention_id string, right_mention_id string, action string, decided_at timestamp"


def test_groups_follow_the_rules_of_decisions(spark):
    d = [
        ("p1", "a", "b", " Merge ", at(1)), ("p1", "b", "a", "merge", at(1)), ("p2", "b", "c", "MERGE", at(1)), ("p3", "c", "d", "merge", at(1)), ("p3", "c", "d", "reject", at(2)),
        ("p4", "d", "e", "merge", at(1)), ("p5", "e", None, "merge", at(1)), ("p6", "e", "zz", "merge", at(1)), ("p7", "f", "f", "merge", at(1)), ("p8", "f", "g", None, at(9)), ("p8", "f", "g", "merge", at(1)),
        ("p9", "g", "h", "merge", None), (None, "g", "a", "merge", at(1)), ("p10", "x", "y", "merge", at(3)), ("p10", "x", "y", "abstain", at(3)),
    ]
    dec = noisy(spark.createDataFrame(d, DEC))
    blocked = spark.createDataFrame([("p4",), ("p4",), (None,), ("?",)], "trigger_pair_id string")
    m = noisy(spark.createDataFrame([(x,) for x in "abcdefghxy"] + [("a",), (None,)], "mention_id string"))
    assert rows(components.group_mentions(dec, blocked, m)) == [("a", "a"), ("b", "a"), ("c", "a"), ("f", "f"), ("g", "f"), ("h", "f")]
    assert rows(components.group_mentions(dec.limit(0), blocked, m)) == []
    assert rows(components.group_mentions(dec, blocked, m.limit(0))) == []


CHUNK = "document_id string, chunk_order int, chunk_id string, content string, token_count int, created_at timestamp"


def test_chunks_are_split_whole(spark):
    long = " ".join(f"t{i}" for i in range(900))
    c = [("d", 1, "c1", long, 5, at(1)), ("d", 1, "c1", long, 5, at(1)), ("d", 0, "c0", "short text", 999, at(1)), ("d", 2, "c2", None, 1, at(1)), ("d", 3, "c3", "", 0, at(1)), ("d", 4, "c4", "old " * 400, 1, at(1)), ("d", 4, "c4", "new", 1, at(2)), ("d", 5, "c5", "y" * 200000, 1, None)]
    df = noisy(spark.createDataFrame(c, CHUNK))
    got = splitting.split_chunks(df).orderBy("chunk_order", "piece_order").collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append(r)
    assert sorted(by) == ["c0", "c1", "c3", "c4", "c5"] and by["c4"][0]["content"] == "new" and len(by["c5"]) == 1
    assert [r["token_count"] for r in by["c1"]] == [300, 300, 300, 90] and by["c1"][1]["content"].startswith("t270 ")
    assert rows(splitting.oversized(df)) == [("c1",)] and rows(splitting.oversized(df.limit(0))) == []
    with pytest.raises(ValueError):
        splitting.split_chunks(df, 10, 10)


def test_sketch_tables_merge_and_answer(spark):
    rng = np.random.default_rng(2)
    v = rng.lognormal(6, 1, 3000)
    data = [("a", float(x)) for x in v] + [("b", 5.0)] * 40 + [(None, 1.0), ("a", None), ("a", float("nan")), ("a", -3.0), ("c", float("inf"))]
    df = noisy(spark.createDataFrame(data, "g string, latency double").repartition(5))
    one = quantiles.sketch(df.where("latency > 400"), ["g"], "latency")
    two = quantiles.sketch(df.where("not latency > 400"), ["g"], "latency")
    got = {(r["g"], r["fraction"]): r for r in quantiles.percentiles(quantiles.merge_sketches(one.unionByName(two), ["g"]), ["g"], [0.5, 0.95]).collect()}
    assert {k[0] for k in got} == {"a", "b", None} and got["b", 0.5]["low"] <= 5.0 <= got["b", 0.5]["high"]
    s = np.sort(v)
    for f in (0.5, 0.95):
        r = got["a", f]
        assert r["n"] == 3000 and r["low"] <= s[int(np.ceil(f * 3000)) - 1] <= r["high"]
    gone = df.where("g = 'a'").withColumn("w", F.lit(-1))
    back = quantiles.merge_sketches(quantiles.sketch(df, ["g"], "latency").unionByName(quantiles.sketch(gone, ["g"], "latency", "w")), ["g"])
    assert {r["g"] for r in quantiles.percentiles(back, ["g"], [0.5]).collect()} == {"b", None}
    assert quantiles.percentiles(quantiles.sketch(df.limit(0), ["g"], "latency"), ["g"], [0.5]).count() == 0


def test_wrong_p95_is_exact(spark):
    rng = random.Random(4)
    ret, pub, want = [], [], set()
    for g in range(12):
        n = rng.choice([1, 2, 19, 20, 21, 200])
        x = sorted(rng.lognormvariate(6, 1) for _ in range(n))
        p95 = x[-(-n * 95 // 100) - 1]
        off = rng.choice([1.0, 1.19, 1.21, 0.81, 0.79, 1000.0])
        pub.append(("r", f"b{g}", "ER", p95 * off / 1000))
        if abs(off - 1) > 0.2:
            want.add(("r", f"b{g}", "ER"))
        ret += [(f"q{g}_{i}", "r", f"b{g}", "ER", v, at(0)) for i, v in enumerate(x)]
    ret += ret[:30] + [("bad1", "r", "b0", "ER", None, at(0)), ("bad2", "r", "b0", "ER", -1.0, at(0)), ("bad3", "r", "b0", "ER", float("nan"), at(0))]
    pub += [("r", "nobody", "ER", 1.0), ("r", "b1", "none", None)]
    r = noisy(spark.createDataFrame(ret, "retrieval_result_id string, base_run_id string, builder_model string, graph_regime string, latency_ms double, retrieved_at timestamp"))
    p = noisy(spark.createDataFrame(pub, "base_run_id string, builder_key string, regime string, retrieval_latency_p95_s double"))
    assert set(rows(quantiles.wrong_p95(r, p))) == want and rows(quantiles.wrong_p95(r.limit(0), p)) == []


MEN = "mention_id string, original_name string, entity_type string, description string, builder_model string, canonical_entity_id string, extracted_at timestamp, ingested_at timestamp"


def test_survivors(spark):
    ok = "A port. Acme Bay was visited."
    m = [
        ("m1", "Acme Bay", "place", ok, "good", "e1", at(9), at(9)), ("m1", "Acme Bay", "place", ok, "good", "e1", at(9), at(10)), ("m2", "Acme Ba", "?", "A port. Acme", "bad", "e1", at(8), at(9)), ("m3", "unknown", "GPE", "N/A", "best", "e1", at(10), at(10)),
        ("m4", "Acme Bay", None, "", "bad", "e1", at(1), at(1)), ("m5", "Solo", "org", ok, "good", "e2", at(1), at(1)), ("m6", "Zed Cup", "event", ok, "best", "e3", at(1), at(1)), ("m7", "Zed Cup", "event", ok, "good", "e3", at(5), at(1)),
        ("m8", "N/A", "none", "Z�d.", "good", "e4", at(1), at(1)), ("m9", None, None, None, None, "e4", None, None), ("m0", "Free", "org", ok, "good", None, at(1), at(1)),
    ]
    trust = spark.createDataFrame([("best", 1), ("good", 2), ("bad", 3), (None, 4)], "builder_model string, trust_rank int")
    df = noisy(spark.createDataFrame(m, MEN))
    assert rows(survivors.surviving_mentions(df, trust)) == [("e1", "description", "m1"), ("e1", "entity_type", "m3"), ("e1", "original_name", "m1")]
    rec = {r[0]: r for r in rows(survivors.surviving_records(df, trust))}
    assert rec["e1"][1] == "Acme Bay" and rec["e4"][1] is None and rec["e3"][1] == "Zed Cup"
    assert rows(survivors.surviving_mentions(df.limit(0), trust)) == [] and rows(survivors.surviving_mentions(df, trust.limit(0))) != []


def test_truth_discovery_rates_sources(spark):
    votes = [(i, 1, s, 1) for i in range(20) for s in ("a", "b")] + [(i, 2, "liar", 1) for i in range(20)] + [(99, 3, "liar", 1), (99, 4, "a", 1)]
    support, weights = survivors.truth_discovery(spark.createDataFrame(votes, "item long, value long, source string, n long"), spark.createDataFrame([], "source string, weight double"))
    w = dict(rows(weights))
    s = {(r[0], r[1]): r[2] for r in rows(support)}
    assert w["a"] > w["liar"] and s[99, 4] > s[99, 3] and abs(s[0, 1] + s[0, 2] - 1) < 1e-9


def test_defective_answers(spark):
    a = [("a1", "q1", "", " SUCCESS ", "x"), ("a1", "q1", "", "success", "x"), ("a2", "q1", "It is x (", "success", None), ("a3", "q1", "", "failure", "x"), ("a4", "nope", "I cannot assist with this", "success", "x"), (None, "q1", "", "success", "x"), ("a5", "q1", "x", None, "x")]
    df = noisy(spark.createDataFrame(a, "answer_result_id string, question_id string, raw_answer string, answer_outcome string, gold_answer string"))
    q = noisy(spark.createDataFrame([("q1", "Where is x?"), ("q1", "Where is x?")], "question_id string, question string"))
    assert rows(answers.defective_answers(df, q)) == [("a1", "empty"), ("a2", "truncated"), ("a4", "refusal")]
    assert rows(answers.defective_answers(df.limit(0), q)) == []


def _vectors(spark, x, extra=()):
    data = [(f"m{i:04d}", [float(v) for v in r], at(i % 3)) for i, r in enumerate(x)] + list(extra)
    return noisy(spark.createDataFrame(data, "mention_id string, embedding array<float>, ingested_at timestamp"))


def test_mutual_neighbours_equal_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32))
    for i in range(0, 1500, 5):
        x[i + 1] = x[i] + 0.08 * rng.standard_normal(32)
        x[i + 2] = x[i] * 7
    x[900:912] = x[900]
    nan = [("bad1", None, at(0)), ("bad2", [0.0] * 32, at(0)), ("bad3", [1.0] * 16, at(0)), ("bad4", [float("nan")] * 32, at(0)), ("bad5", [1.0, None] * 16, at(0)), ("m0000", [float(v) for v in x[0]], at(9))]
    f = x.astype(np.float32).astype(np.float64)
    u = f / np.linalg.norm(f, axis=1)[:, None]
    s = np.round(u @ u.T, 7)
    np.fill_diagonal(s, -2)
    near = {i: set(sorted(np.flatnonzero(s[i] >= 0.975), key=lambda j: (-s[i, j], j))[:5]) for i in range(len(x))}
    want = {(f"m{i:04d}", f"m{j:04d}") for i in near for j in near[i] if i < j and i in near[j]}
    for options in ({}, {"cell_rows": 200, "sample_rows": 500}, {"cell_rows": 200, "sample_rows": 500, "task_rows": 90}):
        got = set(rows(neighbours.mutual_neighbours(_vectors(spark, x, nan), **options)))
        assert len(want - got) <= 0.02 * len(want) and len(got - want) <= 0.02 * len(want)
    assert rows(neighbours.mutual_neighbours(_vectors(spark, x).limit(0))) == []


def _shuffled(spark, run):
    """Most records that a stage of the run shuffled."""
    jvm, bus = spark._jvm, spark.sparkContext._jsc.sc().listenerBus()
    none, status = jvm.java.util.ArrayList, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        bus.waitUntilEmpty(30_000)
        got = status.stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteRecords() for i in range(got.size())}

    before = stages()
    out = run()
    return out, max(n for stage, n in stages().items() if stage not in before)


def test_neighbours_over_very_many_cells_meet_without_visiting_them_all(spark):
    rng = np.random.default_rng(18)
    x = rng.standard_normal((4000, 32)).astype(np.float32)
    x[1::10] = x[::10] + 0.07 * rng.standard_normal((400, 32)).astype(np.float32) * np.linalg.norm(x[::10], axis=1)[:, None] / 5.66
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = {i: set(sorted(np.flatnonzero(s[i] >= 0.975), key=lambda j: (-s[i, j], j))[:5]) for i in range(len(x))}
    want = {(f"m{i:04d}", f"m{j:04d}") for i in near for j in near[i] if i < j and i in near[j]}
    got, most = _shuffled(spark, lambda: rows(neighbours.mutual_neighbours(_vectors(spark, x), cell_rows=40, sample_rows=4000)))
    assert len(want) >= 400 and set(got) <= want and len(got) == len(set(got)) >= 0.99 * len(want)
    assert most <= 10 * len(x)


def test_general_neighbours_have_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 32)).astype(np.float32)
    v = neighbours.usable_vectors(_vectors(spark, x), "mention_id", "embedding", 32, "ingested_at")
    got = {}
    for i, j, *_ in rows(neighbours.nearest(v, 32, 5, cell_rows=200)):
        got.setdefault(i, set()).add(j)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {f"m{i:04d}": {f"m{j:04d}" for j in np.argsort(-s[i])[:5]} for i in range(600)}
    assert np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.9


DOC = "doc_id long, text string, source string, lang string"


def test_leaks_are_found_and_cut(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."
    d = [(1, f"Lead. ALPHA, beta-gamma delta epsilon zeta eta THETA iota. End", None, "en"), (2, "alpha beta gamma delta epsilon zeta eta", None, "en"), (3, None, None, None), (4, "", None, None), (5, item * 3, None, "en"), (6, "x " * 100000 + item, None, "en")]
    docs = noisy(spark.createDataFrame(d, DOC))
    items = spark.createDataFrame([(10, item), (10, item), (11, "too short"), (12, None), (13, "Z. " + item)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = [(1, 10), (1, 13), (5, 10), (5, 13), (6, 10), (6, 13)]
    assert rows(leakage.leaked_documents(docs, items)) == want
    assert rows(leakage.leaked_spans(docs, items, max_bytes=60).select("doc_id", "item_id").distinct()) == want
    assert rows(leakage.leaked_documents(docs, items.limit(0))) == [] == rows(leakage.leaked_documents(docs.limit(0), items))
    assert [r["doc_id"] for r in leakage.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in leakage.decontaminate(docs, items, action="span").collect()}
    assert cut[1].startswith("Lead. ") and "ALPHA" not in cut[1] and cut[1].endswith("End") and len(cut) == 6


def test_mixture_meets_targets(spark):
    rng = random.Random(6)
    d = [(i, "word " * rng.randint(20, 80), rng.choice([" the Small  wire", "SMALL WIRE"]) if i % 10 == 0 else "Big Post", "en") for i in range(400)] + [(900, None, "Big Post", None), (901, "a b", None, None), (902, "", "Big Post", None)]
    docs = noisy(spark.createDataFrame(d, DOC))
    targets = spark.createDataFrame([("Small Wire", 0.4, 3), ("Big Post", 0.5, 2), ("Gone", 0.1, 5)], "source string, target_weight double, max_repeats int")
    uses, shares = mixing.mixture(docs, targets, block=64)
    s = {r["source"]: r for r in shares.collect()}
    assert s["Gone"]["share"] == 0 and abs(s["Small Wire"]["share"] - 0.4 / 0.9) < 0.02 and abs(sum(r["share"] for r in s.values()) - 1) < 1e-9
    u = uses.collect()
    per = {}
    for r in u:
        per.setdefault(r["doc_id"], set()).add(r["repeat"])
    assert max(map(max, per.values())) <= 3 and all(x == set(range(1, len(x) + 1)) or x for x in per.values())
    assert sum(r["n_tokens"] for r in u if r["source"] == "Small Wire") == s["Small Wire"]["tokens"]
    seen, total = {"Small Wire": 0, "Big Post": 0}, 0
    share = {k: s[k]["share"] for k in seen}
    for r in sorted(u, key=lambda r: (r["slot"], r["source"], r["start"])):
        seen[r["source"]] += r["n_tokens"]
        total += r["n_tokens"]
    assert all(abs(seen[k] - total * share[k]) < 1 for k in seen)
    starts = sorted((r["start"], r["n_tokens"]) for r in u if r["source"] == "Big Post")
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    # a short period repeats, and blocks keep their order and shares
    short = sorted((r["slot"], r["source"], r["start"], r["n_tokens"]) for r in mixing.mixture(docs, targets, block=64, period=16)[0].collect())
    assert len(short) == len(u) and short[-1][0] > 100
    at, seen, total = dict.fromkeys(share, -1), dict.fromkeys(share, 0), 0
    for slot, k, start, n in short:
        assert start > at[k]
        at[k], seen[k], total = start, seen[k] + n, total + n
    for a, b in ((docs.limit(0), targets), (docs, targets.limit(0))):
        x, y = mixing.mixture(a, b)
        assert x.count() == 0


def test_reading_bands(spark):
    rng = random.Random(1)
    pools = {
        "easy": ["He met the dog at night.", "She saw a red boat in the rain.", "It was a cold day and the bus ran.", "We sat by the sea with all of the kids."],
        "mid": ["The council approved the annual budget after months of talks, and the reporter followed the plan.", "A spokesperson said the station had replaced every printer under a new agreement."],
        "hard": ["Notwithstanding the reservations articulated by dissenting members, the institutional harmonization necessitated the discretionary consolidation of the liabilities.", "Considerations of jurisdiction and remuneration, insofar as the provisions remain enforceable, invalidated the determination."],
    }
    docs, labels, truth = [], [], {}
    for i in range(300):
        band = ("easy", "mid", "hard")[i % 3]
        docs.append((i, " ".join(rng.choice(pools[band]) for _ in range(12)), None, "xx"))
        truth[i] = band
        if i % 7 == 0:
            labels += [(i, f" {band.upper()} ", "r1"), (i, band, "r1"), (i, "odd", "r2")]
    docs += [(900, None, None, None), (901, "- a\n- b\n- c", None, "en"), (902, "Die Stadt hat den Hafen nicht gebaut. Der Bau ist sehr teuer. Das war es auch.", None, "en"), (903, "It was a day.", None, "en"), (None, docs[0][1], None, None)]
    d, lab = noisy(spark.createDataFrame(docs, DOC)), spark.createDataFrame(labels + [(None, "easy", "r"), (5555, "easy", "r")], "doc_id long, band string, rater string")
    got = dict(rows(reading.bands(d, lab)))
    assert set(got) == set(truth) and np.mean([got[i] == b for i, b in truth.items()]) > 0.97
    assert rows(reading.bands(d, lab.limit(0))) == [] == rows(reading.bands(d.limit(0), lab))


def test_variant_pairs(spark):
    base = [("Victoria Tenounian", "person"), ("Tenounian, Victoria", "PERSON"), ("Vicky Tenounian", None), ("V. Tenounian", "person"), ("Victoria Tenuonian", "person"), ("Victoria Tenou…", "person"), ("Victoria Ten??unian", "?"), ("Zachary Kropiacuthorn", "person"), ("Ottoline Kropiacuthorn", "person"),
            ("Kropiacuthorn", "person"), ("Zera Cup 2021", "event"), ("Cup Zera 2021", "event"), ("Zera Cup 2022", "event"), ("Fibrudeivik Broadcasting Laboratories Inc.", "org"), ("FBL", "org"), ("Fibrudeivik Broadcasting Labs", "org"), ("unknown", "org"), ("N/A", None), (None, None), ("", "org"), ("Victoria Tenounian Jr.", "person")]
    rng = random.Random(2)
    filler = [(f"{a} {''.join(rng.choice(['ka', 'lo', 'mi', 'ru', 'ze', 'po']) for _ in range(5))}ov", "person") for a in ("Victoria", "Zachary", "Ottoline") for _ in range(40)]
    m = spark.createDataFrame([(n, t) for n, t in base + base[:5] + filler], "original_name string, entity_type string")
    got = {p for p in rows(names.variant_pairs(noisy(m))) if set(p) & {n for n, _ in base}}
    v = ["Tenounian, Victoria", "V. Tenounian", "Vicky Tenounian", "Victoria Ten??unian", "Victoria Tenounian", "Victoria Tenuonian"]
    want = {(a, b) for a in v for b in v if a < b} | {("Cup Zera 2021", "Zera Cup 2021")} | {tuple(sorted(p)) for p in (("FBL", "Fibrudeivik Broadcasting Laboratories Inc."), ("FBL", "Fibrudeivik Broadcasting Labs"), ("Fibrudeivik Broadcasting Laboratories Inc.", "Fibrudeivik Broadcasting Labs"))}
    assert want <= got and not any("Jr." in x or "2022" in x or "Kropiacuthorn" in x or "N/A" in x for p in got for x in p)
    assert rows(names.variant_pairs(m.limit(0))) == []


def test_common_words_do_not_depend_on_size(spark):
    rng = random.Random(3)
    rare = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    n = [f"{w} {rare()}x" for w, k in (("Nicholas", 300), ("Nick", 30), ("Summit", 300), ("Summi", 30), ("Sumit", 30), ("Vincent", 300), ("Vinc", 30)) for _ in range(k)]
    assert names.common_words(spark.createDataFrame([(x,) for x in n], "name string")) == ["nicholas", "summit", "vincent"]
