"""Sources, sinks and streams."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from skeinworks.operators.joins import GateError
from skeinworks.sources import files
from skeinworks.streaming import streams


def put(path, text):
    path.write_text(text)
    return str(path)


def test_jsonl(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, good, "a int").count() == 2
    broken = put(tmp_path / "b.jsonl", '{"a": 1}\n{"a": 2}\n{"a": ')
    with pytest.raises(Exception):
        files.read_jsonl(spark, broken, "a int").collect()
    assert files.read_jsonl(spark, broken, "a int", tolerate_tail=True).count() == 2
    middle = put(tmp_path / "c.jsonl", '{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, middle, "a int", tolerate_tail=True).collect()


def test_envelopes_and_arrays(spark, tmp_path):
    e = put(tmp_path / "e.jsonl", '{"record_type": "artifact_header", "version": 1}\n{"record_type": "node", "record": {"id": "x"}}\n')
    assert files.read_enveloped(spark, e, "id string", "node").collect()[0]["id"] == "x"
    with pytest.raises(Exception):
        files.read_enveloped(spark, e, "id string", "edge").collect()
    a = put(tmp_path / "a.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert files.read_json_array(spark, a, "a int, b string").count() == 2
    with pytest.raises(GateError):
        files.read_json_array(spark, a, "a int")


def test_graphml(spark, tmp_path):
    x = '<graphml><graph edgedefault="undirected"><node id="a"/><edge source="a" target="b"/><edge source="b" target="a"/><edge source="a" target="a"/></graph></graphml>'
    assert [tuple(r) for r in files.read_graphml_edges(spark, put(tmp_path / "g.graphml", x)).collect()] == [("a", "b")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "t")
    assert files.write_immutable(df, path) and not files.write_immutable(df.orderBy(F.desc("k")), path)
    with pytest.raises(GateError):
        files.write_immutable(df.limit(1), path)
    log = str(tmp_path / "log")
    assert files.append_new(df, log, "k") == 2 and files.append_new(df, log, "k") == 0
    assert files.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), log, "k") == 1
    files.write_csv(df, str(tmp_path / "c"), ["v", "k"])
    with pytest.raises(GateError):
        files.write_csv(df, str(tmp_path / "d"), ["k"])
    one = files.manifest(spark, {"t": df})
    assert files.reusable(one, files.manifest(spark, {"t": df.select("k", "v")})).first()["reusable"]
    assert not files.reusable(one, files.manifest(spark, {"t": df.limit(1)})).first()["reusable"]


def run(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams_replay_and_windows(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), f"u{i % 2}", "claimed" if i % 3 else "completed") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, at timestamp, user string, status string")
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    log, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    run(streams.to_log(stream, log, "id", cp))
    run(streams.to_log(spark.readStream.schema(df.schema).parquet(src), log, "id", str(tmp_path / "cp2")))
    assert spark.read.parquet(log).count() == 40
    want = {tuple(r) for r in streams.windowed_counts(df, "at", "user").collect()}
    out = streams.windowed_counts(stream, "at", "user", late="100 days")
    run(out.writeStream.format("memory").queryName("w").outputMode("complete"))
    assert {tuple(r) for r in spark.table("w").collect()} == want
    assert streams.sessions(df, "at", "user", "10 minutes").count() == 40 and streams.sessions(df, "at", "user", "15 minutes").count() == 2


def test_stage_states(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", "claimed", t0), ("a", "failed", t0 + datetime.timedelta(1)), ("a", "claimed", t0 + datetime.timedelta(2)), ("a", "completed", t0 + datetime.timedelta(3)), ("a", "failed", t0 + datetime.timedelta(4)), ("b", "claimed", t0)]
    df = spark.createDataFrame(rows, "item string, status string, at timestamp")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    out = streams.stage_states(spark.readStream.schema(df.schema).parquet(src), "item", "status", "at")
    run(out.writeStream.format("memory").queryName("s").outputMode("update"))
    assert {tuple(r) for r in spark.table("s").collect()} == {("a", "completed", 2), ("b", "claimed", 1)}
    assert os.path.isdir(src)


def test_replacing_and_identities(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "t")
    files.replace_table(spark.range(5), path)
    files.replace_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3 and not os.path.exists(path + ".old") and not os.path.exists(path + ".new")
    assert files.run_id("base_", {"b": 1, "a": "é"}) == files.run_id("base_", {"a": "é", "b": 1}) != files.run_id("base_", {"a": "e", "b": 1})
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.txt", "x")
    put(folder / "b.txt", "y")
    want = spark.createDataFrame([("a.txt", hashlib.sha256(b"x").hexdigest()), ("b.txt", "0"), ("c.txt", "0")], "name string, sha256 string")
    assert sorted(map(tuple, files.preflight(spark, str(folder), want).collect())) == [("b.txt", "other_digest"), ("c.txt", "missing")]


def test_graphml_nodes_and_workspaces(spark, tmp_path):
    x = '<graphml><graph><node id="a"><data key="k">v</data><data key="t">w</data></node><node id="b"><data key="k">u</data></node></graph></graphml>'
    got = {r["node"]: r["attributes"] for r in files.read_graphml_nodes(spark, put(tmp_path / "g.graphml", x)).collect()}
    assert got == {"a": {"k": "v", "t": "w"}, "b": {"k": "u"}}
    n, k = spark.createDataFrame([("a",), ("b",), (" ",)], "node string"), spark.createDataFrame([("c1",)], "chunk_id string")
    e = spark.createDataFrame([("b", "a", 1), ("a", "z", 1), ("a", "a", 1)], "source string, target string, weight int")
    path = str(tmp_path / "w")
    files.export_workspace(path, n, e, k)
    files.export_workspace(path, n, e, k)
    with pytest.raises(GateError):
        files.export_workspace(path, n.limit(1), e, k)
    t, checks = files.reopen_workspace(spark, path, k)
    assert {r[0]: r[1] for r in checks.collect()} == {"blank_nodes": 1, "dangling_ends": 1, "duplicate_edges": 0, "duplicate_nodes": 0, "loops": 1, "exact_chunk_snapshot_reopened": 0}
    assert t["edges"].where("source > target").count() == 0
