"""Sources, sinks and streams on the driver's tables: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import latest
from ..runtime import shared_dir
from ..sources import files
from ..streaming import streams
from .q_graph import _EDGE, _REL, named_edges
from .registry import M, query


def _place(df, name):
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"


@query("select question_type, count(*)::bigint as n, sum(length(question))::bigint as chars, sum(len(gold_document_ids))::bigint as links from questions group by 1")
def jsonl_scan(t):
    q = t("questions")
    path = _place(q, "jsonl")
    q.write.json(path)
    r = files.read_jsonl(q.sparkSession, path, q.schema)
    return r.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).alias("chars"), F.sum(F.size("gold_document_ids")).alias("links"))


@query("select retrieval_outcome, count(*)::bigint as n from retrievals group by 1")
def jsonl_scan_broken_tail(t):
    r = t("retrievals").select("retrieval_result_id", "retrieval_outcome")
    path = _place(r, "tail")
    lines = r.select(F.to_json(F.struct("retrieval_result_id", "retrieval_outcome")).alias("value"))
    lines.write.text(path)
    # a writer that was interrupted leaves a file with a broken last line
    r.sparkSession.createDataFrame([('{"retrieval_result_id": "cut',)], "value string").write.mode("append").text(path)
    return files.read_jsonl(r.sparkSession, path, r.schema, tolerate_tail=True).groupBy("retrieval_outcome").agg(F.count(F.lit(1)).alias("n"))


@query("select builder_model, count(*)::bigint as n from mentions group by 1")
def enveloped_scan(t):
    m = t("mentions").select("mention_id", "builder_model")
    path = _place(m, "envelopes")
    m.select(F.lit("mention").alias("record_type"), F.struct("mention_id", "builder_model").alias("record")).write.json(path)
    m.sparkSession.createDataFrame([("artifact_header",)], "record_type string").write.mode("append").json(path)
    return files.read_enveloped(m.sparkSession, path, m.schema, "mention").groupBy("builder_model").agg(F.count(F.lit(1)).alias("n"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def json_array_scan(t):
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _place(n, "array")
    # one file with one array, which only suits small tables such as this
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).write.text(path)
    return files.read_json_array(n.sparkSession, path, n.schema)


@query("select builder_model, display_name, trust_rank from builder_trust")
def csv_sink(t):
    b = t("builder_trust")
    path = _place(b, "csv")
    files.write_csv(b, path, ["builder_model", "display_name", "trust_rank"])
    return b.sparkSession.read.schema(b.select("builder_model", "display_name", "trust_rank").schema).option("header", True).csv(path)


@query("select count(distinct pair_id)::bigint as appended, 0::bigint as replayed, count(distinct pair_id)::bigint as logged from pair_decisions where pair_id is not null")
def append_only_sink(t):
    d = t("pair_decisions").where("pair_id is not null").select("pair_id", "source")
    path = _place(d, "log")
    first, second = files.append_new(d, path, "pair_id"), files.append_new(d, path, "pair_id")
    return d.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("logged")).select(F.lit(first).cast("long").alias("appended"), F.lit(second).cast("long").alias("replayed"), "logged")


@query("select true as written, false as again, count(*)::bigint as rows from region")
def immutable_sink(t):
    r = t("region")
    path = _place(r, "immutable")
    first, second = files.write_immutable(r, path), files.write_immutable(r, path)
    return r.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(first).alias("written"), F.lit(second).alias("again"), "rows")


@query("select r_regionkey, r_name from region where r_regionkey % 2 = 0")
def replaced_table(t):
    r = t("region").select("r_regionkey", "r_name")
    path = _place(r, "replaced")
    files.replace_table(r, path)
    files.replace_table(r.where("r_regionkey % 2 = 0"), path)
    return r.sparkSession.read.parquet(path)


@query("select distinct least(n_name, r_name) as source, greatest(n_name, r_name) as target from nation join region on n_regionkey = r_regionkey where n_name <> r_name")
def graphml_scan(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _place(j, "graphml")
    edge = F.concat(F.lit('<edge source="'), "n_name", F.lit('" target="'), "r_name", F.lit('"/>'))
    j.agg(F.concat(F.lit("<graphml><graph>"), F.array_join(F.collect_list(edge), ""), F.lit("</graph></graphml>")).alias("value")).write.text(path)
    return files.read_graphml_edges(j.sparkSession, path)


@query(
    f"with {M}, {_REL}, {_EDGE}, n as (select distinct original_name as x from m where original_name is not null) select 'blank_nodes' as check_name, (select count(*) from n where trim(x) = '')::bigint as violations union all select 'dangling_ends', 0 union all select 'duplicate_edges', 0 union all select 'duplicate_nodes', 0 "
    "union all select 'loops', (select count(*) from eg where source = target) union all select 'exact_chunk_snapshot_reopened', 0"
)
def workspace_reopened(t):
    e = named_edges(t)
    path = _place(e, "workspace")
    n = t("mentions").select("mention_id", "ingested_at", "original_name")
    n = latest.latest(n, ["mention_id"], [F.desc("ingested_at")]).where("original_name is not null").select(F.col("original_name").alias("node")).distinct()
    k = t("chunks").select("chunk_id").distinct()
    files.export_workspace(path, n, e, k)
    return files.reopen_workspace(e.sparkSession, path, k)[1]


@query("select date_trunc('hour', ts) as window_start, event_type, count(*)::bigint as n from events group by 1, 2")
def stream_windows(t):
    """The events as a stream, file by file, counted in windows by the streaming engine."""
    e = t("events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    src = _place(e, "events")
    e.repartition(4).write.parquet(src)
    stream = e.sparkSession.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = src + "-out"
    done = streams.windowed_counts(stream, "at", "event_type", late="3650 days")
    # every batch writes its whole state under its own number; the last one is the result
    q = done.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i:06d}")).option("checkpointLocation", src + "-check").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return e.sparkSession.read.parquet(f"{out}/{last:06d}").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_STATUS = "case lower(trim(action)) when 'merge' then 'completed' when 'reject' then 'failed' else 'claimed' end"


@query(f"select pair_id, max(({_STATUS} = 'completed')::int) = 1 as completed, sum(({_STATUS} = 'claimed')::int)::bigint as attempts from pair_decisions where pair_id is not null group by 1")
def stream_stage_states(t):
    """Decisions as events of their pair: a pair that completed stays so, and claims are counted."""
    d = t("pair_decisions").where("pair_id is not null").select("pair_id", F.expr(_STATUS).alias("status"), F.col("decided_at").cast("timestamp").alias("at"))
    src = _place(d, "states")
    d.repartition(2).write.parquet(src)
    stream = d.sparkSession.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = src + "-out"
    states = streams.stage_states(stream, "pair_id", "status", "at")
    q = states.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch_no={i}")).option("checkpointLocation", src + "-check").trigger(availableNow=True).start()
    q.awaitTermination()
    r = d.sparkSession.read.parquet(out).groupBy("pair_id").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("x"))
    return r.select("pair_id", (F.col("x.status") == "completed").alias("completed"), F.col("x.attempts").alias("attempts"))
