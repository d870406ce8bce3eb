"""Text, answer and JSON functions."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from skeinworks.functions import answers as A
from skeinworks.functions import json_repair
from skeinworks.functions import text as T


def one(spark, expr, schema, *values):
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(expr).collect()]


def test_normalize_text_folds_like_python(spark):
    words = ["  Apple\t Inc. ", "STRASSE", "Straße", "ﬁne print", "Ünï", None, ""]
    got = one(spark, T.normalize_text(F.col("a")), "a string", *[(w,) for w in words])
    assert got == [None if w is None else " ".join(unicodedata.normalize("NFKC", w).casefold().split()) for w in words]


def test_names_and_types(spark):
    assert one(spark, T.lexical_view(F.col("a")), "a string", ("u.s. steel-corp_x",), ("--",)) == ["u s steel corp_x", ""]
    assert one(spark, T.acronym(F.col("a")), "a string", ("united states steel",), ("one",), ("",)) == ["uss", None, None]
    assert one(spark, T.type_family(F.col("a")), "a string", ("Company",), ("tech company",), ("fruit",), ("gizmo",), ("",), (None,)) == ["organization", "organization", "natural", "gizmo", None, None]


def test_keywords_keep_the_first_spelling(spark):
    assert one(spark, T.keywords_split(F.col("a")), "a string", ("a, B;b| c d ,,A",), ("",), (None,)) == [["a", "B", "c d"], [], None]


def test_wrappers_and_bounds(spark):
    assert one(spark, T.strip_wrappers(F.col("a")), "a string", ("<think>x\ny</think>\n```json\n{1}\n```",), ("plain",)) == ["{1}", "plain"]
    assert one(spark, T.bounded_text(F.col("a"), 5), "a string", ("abcdef",), ("abcde",), ("abc def",)) == ["abcd…", "abcde", "abc…"]
    assert one(spark, T.model_size(F.col("a")), "a string", ("x 270M",), ("qwen 0.8b",), ("none",)) == [0.27, 0.8, None]


def test_ids_use_json_literals(spark):
    import hashlib

    d = [('a"b\\', "c\td")]
    joined = "\x1f".join(json.dumps(x, ensure_ascii=False) for x in d[0])
    listed = json.dumps(list(d[0]), ensure_ascii=False, separators=(",", ":"))
    df = spark.createDataFrame(d, "a string, b string")
    got = df.select(T.joined_id("p_", F.col("a"), F.col("b")), T.array_id("p_", F.col("a"), F.col("b"))).first()
    assert list(got) == ["p_" + hashlib.sha256(x.encode()).hexdigest()[:24] for x in (joined, listed)]


def test_token_f1(spark):
    rows = [(["a", "b", "a"], ["a", "a", "c"]), ([], []), ([], ["a"]), (["x"], ["y"])]
    got = one(spark, T.token_f1(F.col("p"), F.col("g")), "p array<string>, g array<string>", *rows)
    assert got == [pytest.approx(2 / 3), 1.0, 0.0, 0.0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("The answer is: unknown", A.ABSTAIN), ("Not enough information to answer the question", A.ABSTAIN), ("I cannot determine from the provided context", A.ABSTAIN), ("There is insufficient information about x", "there is insufficient information about x"),
        ("Yes, they did", "yes"), ("No one knows", "no"), ("March 3rd, 2021", "2021-03-03"), ("13/02/2020", "2020-02-13"), ("02/13/2020", "2020-02-13"), ("2021-13-01", "2021 13 01"), ("March 2021", "2021-03"), ("1999", "1999"), ("31.02.2020", "31 02 2020"),
        ("$1.5 million", "1500000"), ("(1,200)", "-1200"), ("12 percent", "12%"), ("-0.50", "-0.5"), ("The  Big, Apple!", "big apple"), (None, ""), ("", ""),
    ],
)
def test_answers(raw, want):
    assert A.normalize(raw) == want


def test_answer_functions_run_in_batches(spark):
    df = spark.createDataFrame([("yes!",), (None,), ("1k",)], "a string")
    assert [r[0] for r in df.select(A.normalize_answer("a")).collect()] == ["yes", "", "1000"]
    assert [r[0] for r in df.select(A.canonicalize_unanswerable("a")).collect()] == [None, None, None]


@pytest.mark.parametrize(
    "raw, status, value",
    [
        ('{"a": 1}', "strict", {"a": 1}), ("```json\n{'a': 'b'}\n```", "recovered", {"a": "b"}), ("<think>hm</think> {a: 1, }", "recovered", {"a": 1}), ('{"a": [1, 2', "recovered", {"a": [1, 2]}), ('text {"a": {"b": "c"}} tail', "recovered", {"a": {"b": "c"}}),
        ("[1]", "failed", None), ("nothing", "failed", None), ("", "no_response", None), (None, "no_response", None), ("<think>x</think>", "no_response", None),
    ],
)
def test_recover(raw, status, value):
    s, v = json_repair.recover(raw)
    assert s == status and (json.loads(v) if v else None) == value
