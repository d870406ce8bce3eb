"""Retrieval and answer metrics, efficiency, comparisons of regimes, statistics, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, latest, metrics, retrieval, selection, stats
from .registry import A, M, R, query

_RM = (
    "rm as (select retrieval_result_id, r.question_id, base_run_id, builder_model as builder, graph_regime as regime, retrieval_outcome, latency_ms, question_type, answerable and len(gold_document_ids) > 0 as ok, coalesce(retrieved_document_ids, []) as f, gold_document_ids as g from r join questions using (question_id)), "
    "rx as (select *, list_min(list_filter(list_transform(g, lambda d: list_position(f, d)), lambda p: p > 0)) as fr from rm), "
    "rq as (select * exclude (f, g), case when ok then fr end as rank, case when ok then (fr is not null)::int end as hit, case when ok then len(list_intersect(list_distinct(g), list_distinct(f))) / len(list_distinct(g)) end as recall, case when ok then coalesce(1.0 / fr, 0) end as rr, "
    "case when ok then (len(list_filter(g, lambda d: not list_contains(f[1:5], d))) = 0)::int end as chain from rx)"
)


def _retrievals(t):
    r = metrics.clean_latency(latest.latest(t("retrievals").select("retrieval_result_id", "question_id", "base_run_id", "builder_model", "graph_regime", "retrieval_outcome", "latency_ms", "context_token_count", "retrieved_document_ids", "retrieved_at"), ["retrieval_result_id"], [F.desc("retrieved_at")]))
    return r.withColumnsRenamed({"builder_model": "builder", "graph_regime": "regime"})


def _answers(t):
    a = t("answers").select("answer_result_id", "retrieval_result_id", "question_id", "base_run_id", "builder_model", "graph_regime", "answer_model", "answer_outcome", "gold_answer", "raw_answer", "latency_ms", "input_tokens", "output_tokens", "error_type", "answered_at", "ingested_at")
    a = metrics.clean_latency(latest.latest(a, ["answer_result_id"], [F.desc("ingested_at")])).withColumnsRenamed({"builder_model": "builder", "graph_regime": "regime"})
    return a.withColumn("outcome", F.lower(T.strip(F.col("answer_outcome"))))


def _rank_rows(t):
    q = t("questions").select("question_id", "question_type", "answerable", "gold_document_ids")
    r = _retrievals(t).join(q, "question_id").withColumn("found", F.coalesce("retrieved_document_ids", F.array().cast("array<string>")))
    m = retrieval.retrieval_metrics(F.col("found"), F.col("gold_document_ids"), F.col("answerable") & (F.size("gold_document_ids") > 0))
    return r.select("*", *[c.alias(k) for k, c in m.items()])


@query(f"with {R}, {_RM} select retrieval_result_id, rank::int as first_relevant_rank, hit as retrieval_hit, round(recall, 6) as retrieval_recall, round(rr, 6) as reciprocal_rank, chain as complete_chain from rq")
def retrieval_metrics(t):
    return _rank_rows(t).select("retrieval_result_id", "first_relevant_rank", "retrieval_hit", F.round("retrieval_recall", 6).alias("retrieval_recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "complete_chain")


@query(
    f"with {R}, e as (select retrieval_result_id, unnest(retrieved_document_ids) as d, unnest(range(len(retrieved_document_ids))) as p from r), f as (select retrieval_result_id, trim(d) as document_id, min(p) as p from e where trim(d) <> '' group by 1, 2) select retrieval_result_id, document_id, row_number() over (partition by retrieval_result_id order by p)::int as rank from f"
)
def rank_documents(t):
    return retrieval.rank_documents(_retrievals(t).select("retrieval_result_id", "retrieved_document_ids"), "retrieval_result_id", "retrieved_document_ids")


@query(
    f"with {R}, {_RM} select regime, coalesce(question_type, '(all)') as question_type, count(*)::bigint as questions, round(avg(hit), 6) as retrieval_hit, round(avg(recall), 6) as retrieval_recall, round(avg(rr), 6) as mrr, round(avg(chain), 6) as complete_chain, "
    "round(quantile_cont(latency_ms, 0.5), 2) as latency_median, round(quantile_cont(latency_ms, 0.95), 2) as latency_p95 from rq group by grouping sets ((regime, question_type), (regime))"
)
def downstream_aggregate(t):
    rows = _rank_rows(t)
    q = lambda p: F.round(F.percentile("latency_ms", F.lit(p)), 2)
    g = rows.groupingSets([[F.col("regime"), F.col("question_type")], [F.col("regime")]], "regime", "question_type")
    out = g.agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("retrieval_hit"), 6).alias("retrieval_hit"), F.round(F.avg("retrieval_recall"), 6).alias("retrieval_recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg("complete_chain"), 6).alias("complete_chain"), q(0.5).alias("latency_median"), q(0.95).alias("latency_p95"),
    )
    return out.withColumn("question_type", F.coalesce("question_type", F.lit("(all)")))


@query()
def question_metrics(t):
    rows = metrics.question_rows(t("retrievals"), t("answers"), t("questions"))
    return metrics.aggregate(rows, ["regime", "question_type"])


@query(f"with {R}, {_RM}, q as (select regime, question_id, avg(hit) as v from rq where hit is not null group by 1, 2) select regime, count(*)::bigint as questions, round(avg(v), 6) as mean_hit from q group by 1")
def two_level_question_mean(t):
    q = _rank_rows(t).where("retrieval_hit is not null").groupBy("regime", "question_id").agg(F.avg("retrieval_hit").alias("v"))
    return q.groupBy("regime").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("v"), 6).alias("mean_hit"))


@query(f"with {R}, {_RM}, b as (select builder, avg(rr) as v from rq group by 1) select split_part(builder, '_', 1) as family, count(*)::bigint as builders, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as lowest, round(max(v), 6) as highest from b group by 1")
def family_summary(t):
    b = _rank_rows(t).groupBy("builder").agg(F.avg("reciprocal_rank").alias("v"))
    r = lambda f, n: F.round(f("v"), 6).alias(n)
    return b.groupBy(F.substring_index("builder", "_", 1).alias("family")).agg(F.count(F.lit(1)).alias("builders"), r(F.avg, "mean"), r(F.stddev_samp, "std"), r(F.min, "lowest"), r(F.max, "highest"))


@query(f"with {R}, {_RM} select regime, case when rank is null then 'Not found' when rank >= 6 then '6+' else rank::int::varchar end as bucket, count(*)::bigint as n, round(count(*) / sum(count(*)) over (partition by regime), 6) as share from rq where ok group by 1, 2")
def share_within_group(t):
    g = _rank_rows(t).where("answerable and size(gold_document_ids) > 0").groupBy("regime", T.rank_bucket(F.col("first_relevant_rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return g.selectExpr("regime", "bucket", "n", "round(n / sum(n) over (partition by regime), 6) as share")


@query(f"with {R}, {_RM}, v as (select question_id, regime, avg(hit) as v from rq group by 1, 2), p as (select question_id, max(case when regime = 'Native' then v end) as a, max(case when regime = 'ER+RR' then v end) as b from v group by 1) select question_id, round(a, 6) as left_value, round(b, 6) as right_value, round(b - a, 6) as delta from p")
def paired_deltas(t):
    v = _rank_rows(t).groupBy("question_id", "regime").agg(F.avg("retrieval_hit").alias("v"))
    d = stats.paired_deltas(v, ["question_id"], "regime", "Native", "ER+RR", "v")
    return d.select("question_id", *[F.round(c, 6).alias(c) for c in ("left_value", "right_value", "delta")])


@query()
def bootstrap_contrast(t):
    v = _rank_rows(t).groupBy("question_id", "question_type", "regime").agg(F.avg("retrieval_hit").alias("v"))
    d = stats.paired_deltas(v, ["question_id", "question_type"], "regime", "Native", "ER+RR", "v").withColumn("contrast", F.lit("ER+RR - Native"))
    return stats.bootstrap_mean(d, ["contrast"], "question_type", "question_id", "delta")


@query(f"with {R}, {_RM}, v as (select question_id, regime, max(hit) as v from rq where hit is not null group by 1, 2), p as (select question_id, max(case when regime = 'Native' then v end) as a, max(case when regime = 'ER' then v end) as b from v group by 1), j as (select question_type, a, b from p join questions using (question_id) where a is not null and b is not null) "
    "select question_type, sum((a = 1 and b = 1)::int)::bigint as \"both\", sum((a = 1 and b = 0)::int)::bigint as lost, sum((a = 0 and b = 1)::int)::bigint as gained, sum((a = 0 and b = 0)::int)::bigint as neither from j group by 1")  # fmt: skip
def transitions(t):
    v = _rank_rows(t).where("retrieval_hit is not null").groupBy("question_id", "question_type", "regime").agg(F.max("retrieval_hit").alias("v"))
    d = stats.paired_deltas(v, ["question_id", "question_type"], "regime", "Native", "ER", "v")
    return stats.transitions(d, ["question_type"], "left_value", "right_value")


@query(
    f"with {R}, {_RM}, v as (select builder, question_id, regime, max(hit) as v from rq where hit is not null group by 1, 2, 3), p as (select builder, question_id, max(case when regime = 'Native' then v end) as a, max(case when regime = 'ER+RR' then v end) as b from v group by 1, 2), "
    "c as (select builder, sum((a = 1 and b = 0)::int)::int as lost, sum((a = 0 and b = 1)::int)::int as gained from p where a is not null and b is not null group by 1), "
    "k as (select *, list_sum(list_transform(range(0, least(lost, gained) + 1), lambda i: exp(lgamma(lost + gained + 1) - lgamma(i + 1) - lgamma(lost + gained - i + 1) - (lost + gained) * ln(2)))) as s from c), "
    "z as (select builder, lost, gained, case when lost + gained = 0 then 1 else least(1, 2 * s) end as p from k), w as (select *, row_number() over (order by round(p, 9), builder) as i, count(*) over () as m from z) "
    "select builder, lost::bigint as lost, gained::bigint as gained, round(p, 6) as p_value, round(max(least(1, (m - i + 1) * p)) over (order by i), 5) as p_holm from w"
)
def mcnemar_holm(t):
    v = _rank_rows(t).where("retrieval_hit is not null").groupBy("builder", "question_id", "regime").agg(F.max("retrieval_hit").alias("v"))
    d = stats.paired_deltas(v, ["builder", "question_id"], "regime", "Native", "ER+RR", "v")
    c = stats.mcnemar(stats.transitions(d, ["builder"], "left_value", "right_value")).withColumn("k", F.round("p_value", 9))
    out = stats.holm(c.drop("p_value").withColumnRenamed("k", "p_value"), [], "p_value", "builder")
    return out.select("builder", "lost", "gained", F.round("p_value", 6).alias("p_value"), F.round("p_holm", 5).alias("p_holm"))


_E = "e as (select * from request_efficiency_by_builder_and_regime where retrieval_latency_mean_s > 0 and answer_latency_mean_s > 0 and questions > 0)"


@query(f"with {_E}, k as (select regime, rank() over (partition by regime order by retrieval_latency_mean_s) + (count(*) over (partition by regime, retrieval_latency_mean_s) - 1) / 2 as x, rank() over (partition by regime order by answer_latency_mean_s) + (count(*) over (partition by regime, answer_latency_mean_s) - 1) / 2 as y from e) select regime, count(*)::bigint as n, round(case when count(*) > 1 and not isnan(corr(x, y)) then corr(x, y) end, 6) as spearman from k group by 1")
def rank_spearman(t):
    e = t("request_efficiency_by_builder_and_regime").where("retrieval_latency_mean_s > 0 and answer_latency_mean_s > 0 and questions > 0")
    return stats.spearman(e, ["regime"], "retrieval_latency_mean_s", "answer_latency_mean_s").withColumn("spearman", F.round("spearman", 6))


@query(f"with {_E} select regime, count(*)::bigint as n, round(case when count(*) > 1 and not isnan(regr_slope(ln(answer_latency_mean_s), ln(questions))) then regr_slope(ln(answer_latency_mean_s), ln(questions)) end, 5) as slope, round(case when count(*) > 1 and not isnan(regr_intercept(ln(answer_latency_mean_s), ln(questions))) then regr_intercept(ln(answer_latency_mean_s), ln(questions)) end, 5) as intercept, round(case when count(*) > 1 and not isnan(regr_r2(ln(answer_latency_mean_s), ln(questions))) then regr_r2(ln(answer_latency_mean_s), ln(questions)) end, 5) as r2 from e group by 1")
def loglog_fit(t):
    e = t("request_efficiency_by_builder_and_regime").where("retrieval_latency_mean_s > 0 and answer_latency_mean_s > 0")
    return stats.loglog_fit(e, ["regime"], "questions", "answer_latency_mean_s").select("regime", "n", *[F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2")])


@query(
    f"with {_E}, f as (select regime, base_run_id, builder_key, answer_latency_mean_s as cost, questions as quality, max(questions) over (partition by regime order by answer_latency_mean_s, questions desc, base_run_id || builder_key rows between unbounded preceding and 1 preceding) as best from e) select regime, base_run_id, builder_key, cost, quality::int as quality from f where best is null or quality > best"
)
def pareto_front(t):
    e = t("request_efficiency_by_builder_and_regime").where("retrieval_latency_mean_s > 0 and answer_latency_mean_s > 0 and questions > 0")
    e = e.select("regime", "base_run_id", "builder_key", F.col("answer_latency_mean_s").alias("cost"), F.col("questions").alias("quality"), F.concat("base_run_id", "builder_key").alias("tie"))
    return stats.pareto_front(e, ["regime"], "cost", "quality", "tie").drop("tie")


@query(f"with {_E} select regime, base_run_id, builder_key, round((retrieval_latency_mean_s - median(retrieval_latency_mean_s) over (partition by regime)) / nullif(stddev_pop(retrieval_latency_mean_s) over (partition by regime), 0), 5) as z from e")
def z_label_score(t):
    e = t("request_efficiency_by_builder_and_regime").where("retrieval_latency_mean_s > 0 and answer_latency_mean_s > 0 and questions > 0")
    return stats.z_scores(e, ["regime"], "retrieval_latency_mean_s").select("regime", "base_run_id", "builder_key", F.round("z", 5).alias("z"))


@query("with v as (select split_part(builder_key, '_', 1) as family, builder_key, avg(answer_latency_mean_s) as v from request_efficiency_by_builder_and_regime group by 1, 2) select family, builder_key, round(v / first_value(v) over (partition by family order by builder_key), 5) as relative from v")
def relative_to_first(t):
    v = t("request_efficiency_by_builder_and_regime").groupBy(F.substring_index("builder_key", "_", 1).alias("family"), "builder_key").agg(F.avg("answer_latency_mean_s").alias("v"))
    return v.selectExpr("family", "builder_key", "round(v / first_value(v) over (partition by family order by builder_key), 5) as relative")


@query(
    f"with {R}, {A} select a.builder_model as builder, a.graph_regime as regime, count(*)::bigint as requests, round(avg(a.latency_ms), 4) as answer_mean_ms, round(quantile_cont(a.latency_ms, 0.95), 2) as answer_p95_ms, round(avg(r.latency_ms), 4) as retrieval_mean_ms, "
    "round(avg(r.context_token_count), 4) as context_mean, round(avg(a.output_tokens), 4) as output_mean from a join r using (retrieval_result_id) group by 1, 2"
)
def request_efficiency(t):
    r = _retrievals(t).select("retrieval_result_id", F.col("latency_ms").alias("rl"), "context_token_count")
    j = _answers(t).join(r, "retrieval_result_id")
    m = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return j.groupBy("builder", "regime").agg(
        F.count(F.lit(1)).alias("requests"), m("latency_ms", "answer_mean_ms"), F.round(F.percentile("latency_ms", F.lit(0.95)), 2).alias("answer_p95_ms"), m("rl", "retrieval_mean_ms"), m("context_token_count", "context_mean"), m("output_tokens", "output_mean")
    )


@query(f"with {R}, {A} select coalesce(q.question_type, 'unknown') as question_type, r.retrieval_outcome, lower(trim(a.answer_outcome)) as answer_outcome, count(*)::bigint as n from r join a using (retrieval_result_id) join questions q on q.question_id = r.question_id group by 1, 2, 3")
def join_questions_retrieval_answers(t):
    q = t("questions").select("question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"))
    j = joins.one_to_one(_retrievals(t), _answers(t).select("retrieval_result_id", "outcome"), ["retrieval_result_id"])
    return joins.many_to_one(j, q, ["question_id"]).groupBy("question_type", "retrieval_outcome", F.col("outcome").alias("answer_outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, n_name, count(*)::bigint as orders, round(sum(o_totalprice), 2) as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2")
def join_many_to_one_validated(t):
    c = joins.many_to_one(t("orders").withColumnRenamed("o_custkey", "c_custkey"), t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    n = joins.many_to_one(c, t("nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return n.groupBy("o_orderstatus", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    f"with {A}, k as (select question_id, builder_model, graph_regime, answer_result_id, lower(trim(answer_outcome)) = 'success' as ok, answered_at, input_tokens from a) select question_id, builder_model as builder, graph_regime as regime, answer_result_id from (select *, row_number() over (partition by question_id, builder_model, graph_regime order by ok::int desc, answered_at desc nulls last, input_tokens desc nulls last, answer_result_id desc) as n from k) where n = 1"
)
def latest_success_per_phase(t):
    a = _answers(t).withColumn("attempt", F.coalesce("input_tokens", F.lit(-1)))
    return latest.latest_success(a, ["question_id", "builder", "regime"], F.coalesce(F.col("outcome") == "success", F.lit(False)), "answered_at", "attempt", "answer_result_id").select("question_id", "builder", "regime", "answer_result_id")


@query(f"with {R}, {A} select a.builder_model as builder, count(*)::bigint as requests, round(avg(epoch(a.ingested_at) - epoch(a.answered_at)), 3) as mean_delay_s, round(max(epoch(a.ingested_at) - epoch(a.answered_at)), 3) as max_delay_s from a where a.answered_at is not null and a.ingested_at is not null group by 1")
def lifecycle_durations(t):
    d = _answers(t).where("answered_at is not null and ingested_at is not null").withColumn("d", F.expr("(unix_micros(cast(ingested_at as timestamp)) - unix_micros(cast(answered_at as timestamp))) / 1e6"))
    return d.groupBy("builder").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("d"), 3).alias("mean_delay_s"), F.round(F.max("d"), 3).alias("max_delay_s"))


@query(
    f"with {A}, g as (select b.builder_model as builder, x.regime from builder_trust b, (select distinct graph_regime as regime from a) x), s as (select builder_model as builder, graph_regime as regime, count(*) as n, sum(output_tokens) as tok, sum(latency_ms) / 1000 as sec from a group by 1, 2) "
    "select g.builder, g.regime, s.n is not null as applicable, coalesce(s.n, 0)::bigint as requests, round(tok / nullif(sec, 0), 5) as tokens_per_s, round(n / sum(n) over (partition by g.builder), 6) as share from g left join s on s.builder = g.builder and s.regime = g.regime"
)
def stage_efficiency(t):
    a = _answers(t)
    grid = t("builder_trust").select(F.col("builder_model").alias("builder")).crossJoin(a.select("regime").distinct())
    s = a.groupBy("builder", "regime").agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("tok"), (F.sum("latency_ms") / 1000).alias("sec"))
    j = grid.join(s, ["builder", "regime"], "left")
    return j.select("builder", "regime", F.col("n").isNotNull().alias("applicable"), F.coalesce("n", F.lit(0)).alias("requests"), F.round(F.try_divide("tok", "sec"), 5).alias("tokens_per_s"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("builder")), 6).alias("share"))


@query(
    f"with {A}, u as (select answer_model, 'input_tokens' as measure, input_tokens::double as v from a union all select answer_model, 'output_tokens', output_tokens from a union all select answer_model, 'latency_ms', latency_ms from a) select answer_model, measure, count(v)::bigint as n, round(min(v), 4) as minimum, round(median(v), 4) as median, round(max(v), 4) as maximum from u group by 1, 2"
)
def resource_overview(t):
    u = _answers(t).select("answer_model", *[F.col(c).cast("double").alias(c) for c in ("input_tokens", "output_tokens", "latency_ms")]).unpivot("answer_model", ["input_tokens", "output_tokens", "latency_ms"], "measure", "v")
    r = lambda f, n: F.round(f("v"), 4).alias(n)
    return u.groupBy("answer_model", "measure").agg(F.count("v").alias("n"), r(F.min, "minimum"), r(F.median, "median"), r(F.max, "maximum"))


@query(f"with {R}, {_RM}, h as (select question_id, count(*) as n, avg(1 - hit) as miss from rq group by 1) select h.question_id, question, n::bigint as n, round(miss, 6) as miss_rate from h join questions q using (question_id) where miss is not null order by miss desc, h.question_id limit 50")
def hard_questions(t):
    h = _rank_rows(t).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.col("retrieval_hit")).alias("miss")).where("miss is not null")
    top = h.orderBy(F.desc("miss"), "question_id").limit(50)
    return top.join(t("questions").select("question_id", "question"), "question_id").select("question_id", "question", "n", F.round("miss", 6).alias("miss_rate"))


@query(
    f"with {R}, {_RM}, {A}, j as (select q.regime, hit, case when lower(trim(answer_outcome)) = 'success' and contains(lower(coalesce(raw_answer, '')), lower(a.gold_answer)) then 1 else 0 end as good from rq q join a using (retrieval_result_id) where hit is not null) "
    "select regime, count(*)::bigint as cells, sum(hit)::bigint as hits, sum((hit = 1 and good = 1)::int)::bigint as correct_with_hit, sum((hit = 0 and good = 1)::int)::bigint as correct_without, round(100.0 * sum((hit = 1 and good = 1)::int) / nullif(sum(hit), 0), 4) as conversion from j group by 1"
)
def funnel(t):
    a = _answers(t).select("retrieval_result_id", ((F.col("outcome") == "success") & F.contains(F.lower(F.coalesce("raw_answer", F.lit(""))), F.lower("gold_answer"))).alias("good"))
    j = _rank_rows(t).where("retrieval_hit is not null").join(a, "retrieval_result_id").withColumn("good", F.coalesce(F.col("good"), F.lit(False)))
    c = lambda p: F.count_if(F.expr(p))
    return j.groupBy("regime").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("retrieval_hit").alias("hits"), c("retrieval_hit = 1 and good").alias("correct_with_hit"), c("retrieval_hit = 0 and good").alias("correct_without"),
        F.round(F.try_divide(100.0 * c("retrieval_hit = 1 and good"), F.sum("retrieval_hit")), 4).alias("conversion"),
    )


@query(
    f"with {R}, {_RM}, {A}, j as (select q.regime, hit, retrieval_outcome as ro, lower(trim(answer_outcome)) as ao from rq q join a using (retrieval_result_id)) select regime, case when ro = 'failure' then 'retrieval failure' when ao <> 'success' then 'answer failure' when ro = 'empty' then 'empty retrieval' when hit = 1 then 'hit' when hit = 0 then 'miss' else 'not applicable' end as outcome, count(*)::bigint as n from j group by 1, 2"
)
def classify_outcome(t):
    j = _rank_rows(t).join(_answers(t).select("retrieval_result_id", "outcome"), "retrieval_result_id")
    c = F.when(F.col("retrieval_outcome") == "failure", "retrieval failure").when(F.col("outcome") != "success", "answer failure").when(F.col("retrieval_outcome") == "empty", "empty retrieval").when(F.col("retrieval_hit") == 1, "hit").when(F.col("retrieval_hit") == 0, "miss").otherwise("not applicable")
    return j.groupBy("regime", c.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with u as (unpivot (select base_run_id, builder_key, regime, retrieval_latency_mean_s, answer_latency_mean_s, context_tokens_mean from request_efficiency_by_builder_and_regime) on retrieval_latency_mean_s, answer_latency_mean_s, context_tokens_mean into name metric value v), "
    "m as (select builder_key, metric, regime, avg(v) as v from u group by 1, 2, 3), p as (select builder_key, metric, max(case when regime = 'Native' then v end) as a, max(case when regime = 'ER' then v end) as b from m group by 1, 2) select builder_key, metric, round(b - a, 5) as effect from p"
)
def topology_effects(t):
    e = t("request_efficiency_by_builder_and_regime")
    cols = ["retrieval_latency_mean_s", "answer_latency_mean_s", "context_tokens_mean"]
    m = e.select("builder_key", "regime", *cols).unpivot(["builder_key", "regime"], cols, "metric", "v").groupBy("builder_key", "metric", "regime").agg(F.avg("v").alias("v"))
    return stats.paired_deltas(m, ["builder_key", "metric"], "regime", "Native", "ER", "v").select("builder_key", "metric", F.round("delta", 5).alias("effect"))


@query(f"with {R}, {_RM} pivot (select builder, regime, round(avg(hit), 6) as v from rq group by 1, 2) on regime in ('Native', 'ER', 'ER+RR') using max(v) group by builder")
def builder_performance(t):
    v = _rank_rows(t).groupBy("builder", "regime").agg(F.round(F.avg("retrieval_hit"), 6).alias("v"))
    return v.groupBy("builder").pivot("regime", ["Native", "ER", "ER+RR"]).agg(F.max("v"))


@query(
    f"with {M}, s as (select builder_model, count(*) as n, sum((parse_status = 'strict')::int) as strict, sum((parse_status = 'recovered')::int) as recovered, count(distinct chunk_id) as chunks, sum((entity_type is not null and trim(entity_type) <> '')::int) as typed, sum((description is not null and trim(description) <> '')::int) as described from m group by 1) "
    "select builder_model, n::bigint as mentions, chunks::bigint as chunks, round(strict / n, 6) as strict_rate, round(recovered / n, 6) as recovered_rate, round(typed / n, 6) as typed_rate, round(described / n, 6) as described_rate from s"
)
def extraction_metrics(t):
    from .q_text import mentions

    m = mentions(t, "builder_model", "chunk_id", "parse_status", "entity_type", "description")
    rate = lambda p, n: F.round(F.count_if(F.expr(p)) / F.count(F.lit(1)), 6).alias(n)
    return m.groupBy("builder_model").agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("chunk_id").alias("chunks"), rate("parse_status = 'strict'", "strict_rate"), rate("parse_status = 'recovered'", "recovered_rate"),
        rate("trim(entity_type) <> ''", "typed_rate"), rate("trim(description) <> ''", "described_rate"),
    )


@query(
    f"with {A}, l as (select coalesce(error_type, '(none)') as error_type, lower(trim(answer_outcome)) as outcome, count(*) as n from a group by 1, 2) select error_type, outcome, n::bigint as n, round(n / sum(n) over (), 6) as share from l"
)
def extraction_efficiency(t):
    g = _answers(t).groupBy(F.coalesce("error_type", F.lit("(none)")).alias("error_type"), "outcome").agg(F.count(F.lit(1)).alias("n"))
    return g.selectExpr("error_type", "outcome", "n", "round(n / sum(n) over (), 6) as share")


@query(f"with {R}, {_RM}, v as (select question_id, regime, avg(1 - hit) as e from rq group by 1, 2), p as (select question_id, max(case when regime = 'ER' then e end) as a, max(case when regime = 'ER+RR' then e end) as b from v group by 1) select question_id, round(a, 6) as er_error, round(b - a, 6) as change from p where b - a is not null order by abs(b - a) desc, question_id limit 40")
def question_rr_harm(t):
    v = _rank_rows(t).groupBy("question_id", "regime").agg(F.avg(1 - F.col("retrieval_hit")).alias("e"))
    d = stats.paired_deltas(v, ["question_id"], "regime", "ER", "ER+RR", "e").where("delta is not null").orderBy(F.desc(F.abs("delta")), "question_id").limit(40)
    return d.select("question_id", F.round("left_value", 6).alias("er_error"), F.round("delta", 6).alias("change"))


@query("select date_trunc('hour', ts) as hour_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(t):
    e = t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("hour_start"), "event_type", "n", "total")


@query(
    f"with {R}, {_RM}, p as (select unnest(gold_document_ids) as document_id, question_id from questions), q as (select document_id, count(*) as k from p group by 1) select case when q.k is null then 'unused' else 'gold' end as role, count(*)::bigint as documents, coalesce(sum(q.k), 0)::bigint as links from documents d left join q using (document_id) group by 1"
)
def role_and_links(t):
    q = t("questions").select(F.explode("gold_document_ids").alias("document_id")).groupBy("document_id").agg(F.count(F.lit(1)).alias("k"))
    j = t("documents").select("document_id").join(q, "document_id", "left")
    return j.groupBy(F.when(F.col("k").isNull(), "unused").otherwise("gold").alias("role")).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("k"), F.lit(0)).alias("links"))


_QUOTA = (
    "g as (select distinct question_type from questions where question_type is not null), o as (select question_type, row_number() over (order by substr(sha256('quota' || chr(0) || question_type), 1, 16), question_type) as k, count(*) over () as n from g), "
    "qu as (select question_type, 90 // n + (k <= 90 % n)::int as quota from o)"
)


@query(f"with {_QUOTA} select question_type, quota::bigint as quota from qu")
def balanced_quotas(t):
    return selection.balanced_quotas(t("questions"), "question_type", 90, "quota")


@query(f"with {_QUOTA}, turns as (select question_type, unnest(range(1, quota + 1)) as r from qu) select row_number() over (order by r, question_type)::bigint as position, question_type from turns")
def quota_schedule(t):
    return selection.quota_schedule(selection.balanced_quotas(t("questions"), "question_type", 90, "quota"), "question_type")


@query(
    f"with {_QUOTA}, q as (select question_type, question_id, row_number() over (partition by question_type order by substr(sha256('seed' || chr(0) || question_id), 1, 16), question_id) as n from questions where question_type is not null) select question_type, question_id from q join qu using (question_type) where n <= quota"
)
def stratified_questions(t):
    q = t("questions").select("question_type", "question_id").where("question_type is not null")
    return selection.stratified_sample(q, "question_type", "question_id", selection.balanced_quotas(q, "question_type", 90, "quota"), "seed")


@query(
    f"with {R}, {_RM}, e as (select retrieval_result_id, unnest(f) as d, unnest(range(len(f))) as p from rm), o as (select split_part(source, ' ', 2) as kind, count(*) as n from e join documents on document_id = d group by 1) select coalesce(kind, '(none)') as publisher_kind, n::bigint as retrieved from o"
)
def retrieved_publishers(t):
    e = _retrievals(t).select(F.explode("retrieved_document_ids").alias("document_id"))
    kind = F.coalesce(F.split_part("source", F.lit(" "), F.lit(2)), F.lit("(none)"))
    return e.join(t("documents").select("document_id", "source"), "document_id").groupBy(kind.alias("publisher_kind")).agg(F.count(F.lit(1)).alias("retrieved"))


@query(f"with {R}, b as (select builder_model, graph_regime, median(latency_ms) as v from r group by 1, 2), d as (select builder_model, graph_regime, round(abs(v - median(v) over (partition by graph_regime)), 4) as distance from b) select *, rank() over (partition by graph_regime order by distance desc)::int as outlier_rank from d")
def rank_outlier(t):
    b = _retrievals(t).groupBy(F.col("builder").alias("builder_model"), F.col("regime").alias("graph_regime")).agg(F.median("latency_ms").alias("v"))
    d = b.select("builder_model", "graph_regime", F.round(F.abs(F.col("v") - F.median("v").over(Window.partitionBy("graph_regime"))), 4).alias("distance"))
    return d.withColumn("outlier_rank", F.rank().over(Window.partitionBy("graph_regime").orderBy(F.desc("distance"))))


@query()
def answer_normalization(t):
    from ..functions import answers as N

    a = _answers(t).where("outcome = 'success'").withColumn("n", N.normalize_answer("raw_answer")).withColumn("g", N.normalize_answer("gold_answer"))
    kind = F.when(F.col("n") == N.ABSTAIN, "abstention").when(F.col("n").isin("yes", "no"), "yes/no").when(F.col("n").rlike(r"^\d{4}(-\d\d){0,2}$"), "date").when(F.col("n").rlike(r"^-?\d+(\.\d+)?%?$"), "number").otherwise("text")
    return a.groupBy(kind.alias("kind"), (F.col("n") == F.col("g")).alias("exact")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with x as (select chunk_id, document_id, chunk_order, row_number() over (partition by chunk_id order by created_at desc) as k from chunks), c as (select document_id, count(*) as n, count(distinct chunk_order) as orders, max(chunk_order) as top from x where k = 1 group by 1) "
    "select document_id, n::bigint as chunks, (orders = n)::boolean as orders_unique, (top = n - 1)::boolean as orders_complete from c"
)
def snapshot_chunks(t):
    c = latest.latest(t("chunks").select("chunk_id", "document_id", "chunk_order", "created_at"), ["chunk_id"], [F.desc("created_at")])
    g = c.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_order").alias("o"), F.max("chunk_order").alias("top"))
    return g.select("document_id", "chunks", (F.col("o") == F.col("chunks")).alias("orders_unique"), (F.col("top") == F.col("chunks") - 1).alias("orders_complete"))
