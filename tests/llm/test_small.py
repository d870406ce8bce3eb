"""Array and text parts of the operators against brute force, without Spark."""

import random

import numpy as np
import pyarrow as pa
import regex as re
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinworks.llm import answers, leakage, mixing, names, neighbours, quantiles, reading, splitting, wordhash


def walk(kind, limit, overlap):
    """Greedy cuts, one after the other."""
    n, end, ends = len(kind), 0, []
    while end < n:
        start = max(end - overlap, 0) if end else 0
        reach = min(start + limit, n)
        ends.append(n if reach == n else next((x for s in (2, 1) for x in range(reach, end, -1) if kind[x - 1] >= s), reach))
        end = ends[-1]
    return ends


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=400), st.integers(2, 40), st.integers(0, 39))
def test_cuts_equal_the_greedy_walk(kinds, limit, overlap):
    overlap = min(overlap, limit - 1)
    kind = np.array(kinds, np.int8)
    first, ends = splitting.cuts(kind, limit, overlap)
    assert ends.tolist() == walk(kind, limit, overlap)
    assert ((ends - first) <= limit).all() and first[0] == 0
    assert [max(e - overlap, 0) for e in ends[:-1]] == first[1:].tolist()


def test_split_text_loses_nothing_and_ends_naturally():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(17)) + "." for i in range(200))
    pieces = splitting.split_text(text, 300, 30)
    tokens = re.findall(splitting.TOKEN, text)
    out = re.findall(splitting.TOKEN, pieces[0][0])
    for p, n, _ in pieces[1:]:
        t = re.findall(splitting.TOKEN, p)
        assert len(t) == n <= 300 and t[:30] == out[-30:]
        out += t[30:]
    assert out == tokens and {k for _, _, k in pieces[:-1]} == {"paragraph"}
    assert splitting.split_text("") == [("", 0, "end")] and splitting.split_text("a b")[0][1] == 2


def test_words_and_grams_match_a_regex():
    texts = ["The Cat, sat-on 2 mats", "", None, "äöü x", "a" * 5000, "one two three four five six seven eight nine"]
    low = pa.array([None if t is None else t.lower() for t in texts])
    for size in (1, 30, 1 << 20):
        got = {}
        for a, _, w in wordhash.blocks(low, size):
            for i in range(len(w.hash)):
                got.setdefault(a + int(w.text[i]), []).append((w.words(i, i + 1)[0].decode(), int(w.hash[i])))
        for i, t in enumerate(texts):
            assert [x for x, _ in got.get(i, [])] == re.findall("[a-z0-9]+", (t or "").lower())
    same = {w: h for x in got.values() for w, h in x}
    assert all(same[w] == h for x in got.values() for w, h in x)


def test_spans_join_neighbouring_hits_only():
    hits = [(0, 0, 4, 1), (0, 0, 5, 2), (0, 0, 9, 1), (1, 0, 6, 3)]
    assert sorted(leakage._spans(hits, 8)) == [(0, 0, 4, 9), (0, 0, 9, 8), (1, 0, 6, 8)]
    assert leakage.cut_words("One, TWO three  four.", [(1, 2)]) == "One,    four."


def test_cut_words_counts_as_the_lowered_text_does():
    for text in ("One İstanbul two", "a Kelvin b", "İ", "xİy z", "plain, OLD words-of 3"):
        n = len(re.findall("[a-z0-9]+", text.lower()))
        assert len(leakage._word_ends(text)) == n
        assert re.findall("[a-z0-9]+", leakage.cut_words(text, [(0, n)]).lower()) == []
    assert leakage.cut_words("a b c", [(1, 99)]) == "a  " and leakage.cut_words("a b", []) == "a b" and leakage.cut_words("", [(0, 1)]) == ""


def test_answer_rules():
    q = "Where was the early ferry of Acme Foods opened during the spring session?"
    cases = {
        None: ["empty"], "": ["empty"], " \n": ["empty"], "...": ["empty"], "Answer:": ["empty"], "**": ["empty"], "null": ["empty"],
        "Port Reva": [], "Port Reva.": [], "The provided context does not say.": [], "The articles do not contain that information.": [],
        "I can't help with that request.": ["refusal"], "Leider kann ich dazu keine Auskunft geben.": ["refusal", "wrong_language"], "The council declined to answer reporters, but the article names Port Reva.": [],
        q: ["question_copy"], f"{q} {q}": ["question_copy"], f'You asked: "{q}"': ["question_copy"], "Where was the early ferry of Acme Foods opened during?": ["question_copy"], f"{q} Port Reva": [],
        "Selon les articles, la réponse est Port Reva, comme le dit le second.": ["wrong_language"], "Да, обе статьи это подтверждают.": ["wrong_language"], "Port Reva. One headline reads \"Der Markt bleibt offen\".": [],
        "I think it is Port Reva, although the": ["truncated"], "Port Reva (": ["truncated"], "Both articles point to Port Reva. The first one says the": ["truncated"], 'It was "Port': ["truncated"],
    }
    for a, want in cases.items():
        assert answers.defects(q, a, "Port Reva") == want, a
    assert answers.defects(None, "Port Reva") == [] and answers.defects("Wer?", "The answer is that it was the council.") == ["wrong_language"]


def test_schedule_stays_within_one_block():
    rng = random.Random(3)
    for _ in range(25):
        lengths = [rng.randint(1, 10**6) for _ in range(rng.randint(1, 20))]
        whole, done = sum(lengths), [0] * len(lengths)
        for i, j, slot in mixing.schedule(lengths, 1500):
            assert done[i] == j
            done[i] += 1
            assert all(abs(d - (slot + 1) * n / whole) < 1 for d, n in zip(done, lengths))
    for _ in range(50):
        lengths = [rng.choice([1, 50, 10**6, 10**12]) for _ in range(rng.randint(1, 30))]
        part = mixing.shares_of_period(lengths, 4096)
        assert sum(part) == 4096 and min(part) >= 1 and all(abs(p - n * 4096 / sum(lengths)) < 2 + len(part) for p, n in zip(part, lengths))
        # every period ends with whole shares, so the schedule may begin anew
        done = [0] * len(part)
        for i, _, _ in mixing.schedule(part, 4096):
            done[i] += 1
        assert done == part
    assert mixing.plan_quotas({}, {"a": 1.0}, {"a": 2}) == {}
    assert mixing.plan_quotas({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}) == {"a": 30, "b": 30}
    assert mixing.plan_quotas({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}, 100) == {"a": 30, "b": 50}


def test_sketch_ranks_within_the_stated_error_and_deletes():
    rng = np.random.default_rng(1)
    lay = quantiles.Layout()
    a, b = rng.lognormal(7, 1, 60_000), rng.lognormal(9, 0.3, 20_000)
    one, two = np.zeros(lay.cells, np.int64), np.zeros(lay.cells, np.int64)
    lay.add(one, quantiles.encode(a), np.ones(len(a), np.int64))
    lay.add(two, quantiles.encode(b), np.ones(len(b), np.int64))
    both = np.sort(np.concatenate([a, b]))
    for f in (0.01, 0.5, 0.95, 0.999):
        rank = int(np.ceil(f * len(both)))
        low, high = quantiles.decode(lay.code_at(one + two, rank))
        error = lay.rank_error(one + two)
        assert np.searchsorted(both, high, "right") >= rank - error and np.searchsorted(both, low) < rank + error
        assert (high - low) / low <= 2 * quantiles.RELATIVE_ERROR
    assert error < 0.02 * len(both)
    lay.add(two, quantiles.encode(b), -np.ones(len(b), np.int64))
    assert not two.any()


def test_chi_square_quantiles():
    for p, m, want in ((0.95, 6, 12.592), (0.99, 8, 20.090), (0.5, 2, 1.386)):
        assert abs(neighbours.chi2_quantile(p, m) - want) < 1e-2


def test_search_finds_planted_and_general_neighbours():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[1::3] = x[::3] + 0.05 * rng.standard_normal((1000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, 1)[:, :5]
    i, c = neighbours.search(x, x, np.arange(len(x)), 5, 6, neighbours.chi2_quantile(0.95, 6), 4.0, leaf=32)
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(i, want)])
    assert recall >= 0.9 and (i != np.arange(len(x))[:, None]).all()
    near, _ = neighbours.search(x, x, np.arange(len(x)), 5, 6, neighbours.chi2_quantile(0.95, 6), 0.1, leaf=32)
    assert np.mean([want[k][0] in near[k] for k in range(0, 3000, 3)]) > 0.98


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.integers(0, 8), st.sampled_from(["ins", "del", "sub", "swap"]), st.sampled_from("abcd"))
def test_segments_meet_after_one_edit(a, at, kind, c):
    at = min(at, len(a) - 1)
    b = {"ins": a[:at] + c + a[at:], "del": a[:at] + a[at + 1 :], "sub": a[:at] + c + a[at + 1 :], "swap": a[:at] + a[at : at + 2][::-1] + a[at + 2 :]}[kind]
    assert names.osa1(a, b) and names.osa1(b, a)


def test_names_are_read_alike():
    r = names.Reader(["victoria", "foods", "group", "cup", "broadcasting"])
    key = lambda n: (lambda x: (x["head"], tuple(x["mods"]), x["year"], x["gen"]))(r.read(n))
    same = ["Victoria Tenounian", "Tenounian, Victoria", "VICTORIA TENOUNIAN", "VictoriaTenounian", "Dr. Victoria Tenounian", "Vicky Tenounian", "Victoria K. Tenounian", "Vict. Tenounian", "Víctoria  Tenounian", "Viictoria Tenounian"]
    assert len({key(n) for n in same}) == 1
    assert key("Kropia Foods Grp Inc.") == key("The Kropia Foods Group") == key("Foods Group of Kropia") == key("Kropia Foods Group (KFG)")
    assert key("Zera Cup 2021") == key("Cup Zera, 2021") != key("Zera Cup 2022") and key("Victoria Tenounian Jr.") != key("Victoria Tenounian")
    for n in ("unknown", "N/A", "-", "the company", "Entity 1", "", "…"):
        assert r.read(n) is None


def test_prose_bands_and_cuts():
    assert reading.words_of("- a list 1\n- of things 2\n- and more 3") is None
    assert reading.words_of("One sentence only, that is all it has.") is None
    assert reading.words_of("Die Stadt hat den Hafen nicht gebaut. Der Bau ist sehr teuer. Das war es auch.") is None
    assert reading.words_of("He met the dog at night. The boat sat down on it. It was a cold day and she ran.")
    assert reading.words_of(None) is None and reading.words_of("") is None
    low, high = reading.cut_points(np.array([0.1, 0.2, 0.9, 1.0, 1.8, 1.9]), np.array([0, 0, 1, 1, 2, 2.0]))
    assert 0.2 < low < 0.9 and 1.0 < high < 1.8


def test_short_forms_stay_forms_however_frequent():
    r = names.Reader(["nicholas", "nick", "vincent", "summit", "console"])
    key = lambda n: (lambda x: (x["head"], tuple(x["mods"])))(r.read(n))
    assert key("Nick Tenounian") == key("Nicholas Tenounian") and key("Vinc. Tenounian") == key("Vincent Tenounian") and key("Sumit Zera") == key("Zera Summit")


def test_routes_visit_from_one_side_or_meet_in_trees():
    cells = np.arange(9)
    for cell in cells:
        there, back = neighbours.visits_from(cells, cell), np.array([neighbours.visits_from(np.array([cell]), c)[0] for c in cells])
        assert not there[cell] and (there ^ back)[cells != cell].all()
    rng = np.random.default_rng(19)
    top = rng.standard_normal((8000, 32)).astype(np.float32)
    top /= np.linalg.norm(top, axis=1, keepdims=True)
    plan, sent = neighbours.routes(top, 10**7, 500, 6, 0.05, 0.95, 262144)
    assert 1 < len(plan) == sent <= 11
    ends = np.concatenate([first + tasks for _, tasks, first in plan])
    assert ends.tolist() == list(range(1, len(ends) + 1))
    few, sent = neighbours.routes(top, 500_000, 8, 6, 0.05, 0.95, 262144)
    assert len(few) == 1 and 1 < sent < 3
    for odd in (7993, 7999):  # a row more or less in the sample makes no more cells
        assert len(neighbours.routes(top[:odd], 500_000, 8, 6, 0.05, 0.95, 262144)[0][0][0].leaves) == 8
    # trees would cut through a crowd, whose members are all near: its cells are visited
    crowd = top[:1] + 1e-3 * top
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    assert len(neighbours.routes(crowd, 10**6, 16, 6, 0.05, 0.95, 262144)[0]) == 1
    half = np.concatenate([top[:4000], crowd[4000:]])
    assert len(neighbours.routes(half, 10**6, 16, 6, 0.05, 0.95, 262144)[0]) == 1
