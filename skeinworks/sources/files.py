"""Sources and sinks with explicit schemas and checks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import GateError


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, tolerate_tail: bool = False) -> DataFrame:
    """JSON lines of a known schema; blank lines are skipped.

    A line that is no object raises when it is read. With ``tolerate_tail`` the last line
    of each file may be broken (a writer was interrupted) and is then left out; a broken
    line elsewhere still raises.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not tolerate_tail:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json("value")
    j = lines.join(last, "file").withColumn("ok", ok.isNotNull())
    # only the last line of a file may be broken
    broken = F.raise_error(F.concat(F.lit("broken line: "), F.substring("value", 1, 80))).cast("boolean")
    keep = F.when(F.col("ok"), F.lit(True)).when(F.col("at") < F.col("last"), broken).otherwise(F.lit(False))
    return j.where(keep).select(row.alias("x")).select("x.*")


def read_enveloped(spark: SparkSession, path: str, record: T.StructType | str, kind: str) -> DataFrame:
    """Records of a file whose rows are ``{"record_type", "record"}`` after a header row."""
    record = T._parse_datatype_string(record) if isinstance(record, str) else record
    schema = T.StructType([T.StructField("record_type", T.StringType()), T.StructField("record", record)])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    checked = F.when(F.col("record_type") == kind, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("unexpected record type: "), F.coalesce("record_type", F.lit("null")))))
    return rows.where("record_type is null or record_type <> 'artifact_header'").select(checked.alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON file that holds one array of objects with exactly the fields of the schema."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    found = set(spark.read.option("multiLine", True).json(path).columns)
    if found != set(schema.fieldNames()):
        raise GateError(f"fields {sorted(found)} differ from {sorted(schema.fieldNames())}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """Undirected simple edges ``(source, target)`` of a GraphML file."""
    e = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
    return e.select(F.least("_source", "_target").alias("source"), F.greatest("_source", "_target").alias("target")).where("source <> target").distinct()


def read_graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes ``(node, attributes)`` of a GraphML file; attributes by key."""
    n = spark.read.format("xml").option("rowTag", "node").schema("_id string, data array<struct<_key: string, _VALUE: string>>").load(path)
    pairs = F.filter(F.coalesce("data", F.array().cast("array<struct<_key: string, _VALUE: string>>")), lambda d: d["_key"].isNotNull())
    return n.select(F.col("_id").alias("node"), F.map_from_entries(pairs).alias("attributes"))


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a table beside the old one and then puts it in its place, so that readers never see half of it."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fresh, target, old = (fs_path(path + suffix) for suffix in (".new", "", ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fresh, True)
    df.write.parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        raise OSError(f"cannot put {path} in place")
    fs.delete(old, True)


def run_id(prefix: str, payload: dict) -> str:
    """Identity of a run: prefix and hash of its canonical JSON payload."""
    body = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return prefix + hashlib.sha256(body.encode()).hexdigest()[:24]


def preflight(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """``(name, problem)`` of files that are missing, unknown or of another digest than ``expected(name, sha256)`` says."""
    got = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    j = expected.select("name", "sha256").join(got, "name", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("sha256") != F.col("found"), "other_digest")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def export_workspace(path: str, nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> None:
    """Writes a graph and its chunks once: nodes by id, edges from the smaller to the greater end, chunks by id.

    The same content again is no change; other content raises.
    """
    a, b = F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")
    rest = [c for c in edges.columns if c not in ("source", "target")]
    for name, df, key in (("nodes", nodes, ["node"]), ("edges", edges.select(a, b, *rest), ["source", "target"]), ("chunks", chunks, ["chunk_id"])):
        write_immutable(df.repartitionByRange(*key).sortWithinPartitions(*key), f"{path}/{name}")


def reopen_workspace(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a workspace and what is wrong with them: ``(check_name, violations)``."""
    from ..operators import audits, gates, graph

    t = {n: spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "chunks")}
    checks = graph.integrity(t["nodes"], "node", t["edges"], "source", "target")
    if chunks is not None:
        checks = checks.unionByName(gates.violations("exact_chunk_snapshot_reopened", audits.differing(t["chunks"], chunks, ["chunk_id"])))
    return t, checks


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed field order; columns that are not listed are an error."""
    extra = set(df.columns) - set(columns)
    if extra:
        raise GateError(f"columns not listed: {sorted(extra)}")
    df.select(*columns).write.option("header", True).csv(path)


def digest(df: DataFrame) -> str:
    """Order-independent content digest of a table: number of rows and the sum of row hashes."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s")).first()
    return f"{r['n']}:{r['s'] or 0}"


def write_immutable(df: DataFrame, path: str) -> bool:
    """Writes a table once. The same content again is no change (False); other content raises."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        if digest(spark.read.parquet(path)) != digest(df):
            raise GateError(f"{path} exists with other content")
        return False
    df.write.parquet(path)
    return True


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not in the log yet; returns how many. Replaying a batch adds nothing."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = df.dropDuplicates([key])
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.select(df.columns).write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()


def manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(logical_name, digest, record_count, schema)`` of some tables, for reuse checks."""
    found = [(n, digest(d), d) for n, d in sorted(tables.items())]
    rows = [(n, h, int(h.split(":")[0]), json.dumps(d.schema.jsonValue(), sort_keys=True)) for n, h, d in found]
    return spark.createDataFrame(rows, "logical_name string, digest string, record_count long, schema string")


def reusable(expected: DataFrame, recorded: DataFrame) -> DataFrame:
    """``(logical_name, reusable)``: whether the recorded digest and schema of each expected table still hold."""
    r = recorded.select("logical_name", F.col("digest").alias("_d"), F.col("schema").alias("_s"))
    same = F.col("digest").eqNullSafe(F.col("_d")) & F.col("schema").eqNullSafe(F.col("_s"))
    return expected.join(r, "logical_name", "left").select("logical_name", same.alias("reusable"))
