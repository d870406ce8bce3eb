"""Best representative of each duplicate group, field by field, by iterative truth discovery.

Every mention claims a value for each field of its entity. Source reliability and
value support are estimated in turn: a value is supported by the weights of the
sources that claim it, and a source is as reliable as the average support of its
claims. Support tells values that a better supported value merely continues (cut off)
from genuine ones, and elects the value of each field where votes decide. Where a
published order of trust and the time of extraction decide, they rank the genuine
claims instead (see :func:`surviving_mentions`).

All state is hashed claims; groups are only ever aggregated, so an entity may hold
any part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Stage, pick

FIELDS = ("original_name", "entity_type", "description")

# What stands in for a value, by field; compared in lower case without outer punctuation.
STAND_INS = {
    "original_name": "unknown|tbd|the company|company|none|unnamed|name|unknown entity|the article|article|they|it|this person|person|the person|the author|author|the organization|"
    "the organisation|the city|the place|the event|the product|the team|he|she|we|you|i|him|her|them|someone|somebody|something|entity|null|n/a|na|nan|not specified|unspecified|anonymous|untitled|other|misc",
    "entity_type": "misc|miscellaneous|unknown|none|type|tuple|entity|other|others|n/a|na|nan|null|tbd|undefined|unspecified|entity_type|category|thing|object|concept_unknown",
    "description": "not mentioned in the text|no description provided|n/a|na|see above|description unavailable|no description available|no description|unknown|tbd|description|no further information is given|"
    "no further information|no information available|none|null|nan|not available|not specified|to be determined|missing|empty|unspecified|not provided",
}
# Traces of damaged encodings.
GARBLED = r"\x{FFFD}|\?\?|\\u[0-9a-fA-F]{2}|\\x[0-9a-fA-F]{2}|&#\d+;?|&[a-z]+;|Ã.|â€|Â.|[\x00-\x08\x0b\x0c\x0e-\x1f]"
_MARKED_CUT = r"(?:…|\.\.\.|[-–—])\s*$"


def says_something(field: str, value: Column) -> Column:
    """Whether a value could be genuine, seen alone: not blank, no stand-in, not garbled, no marked or evident cut."""
    core = F.regexp_replace(F.lower(value), r"(?U)^[\s\p{Punct}<>|`^~$+=]+|[\s\p{Punct}<>|`^~$+=]+$", "")
    stand_in = core.isin(*STAND_INS[field].split("|")) | (core == "")
    if field == "original_name":
        stand_in = stand_in | core.rlike(r"^(?:entity|person|organi[sz]ation|location|event|product|name) ?\d+$")
    ok = value.isNotNull() & ~stand_in & ~value.rlike(GARBLED) & ~value.rlike(_MARKED_CUT)
    if field == "description":
        ok = ok & value.rlike(r"""(?U)[.!?。!?]["'”’»)\]]*\s*$""")
    return F.coalesce(ok, F.lit(False))


def newest_mentions(mentions: DataFrame) -> DataFrame:
    """Consolidated mentions, one row an id: of a mention delivered more than once the latest ingested."""
    m = pick(
        mentions, mention_id="mention_id", entity="canonical_entity_id", builder="builder_model", at="extracted_at", got="ingested_at", **{f: f for f in FIELDS}
    ).where("mention_id is not null")
    last = m.groupBy("mention_id").agg(F.max(F.struct("got", "at", "entity", "builder", *FIELDS)).alias("x"))
    return last.select("mention_id", "x.entity", "x.builder", "x.at", *[f"x.{f}" for f in FIELDS]).where("entity is not null")


def claims(newest: DataFrame) -> DataFrame:
    """``(entity, mention_id, builder, at, field, value, genuine)``, one row a mention and field.

    ``genuine`` as far as a value alone tells; it is null-safe and never null.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), says_something(f, F.col(f)).alias("genuine")) for f in FIELDS])).alias("c")
    return newest.select("entity", "mention_id", "builder", "at", each).select("entity", "mention_id", "builder", "at", "c.*")


def truth_discovery(votes: DataFrame, prior: DataFrame, tolerance: float = 1e-3, most_rounds: int = 200, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """Support of values and reliability of sources, from ``votes(item, value, source, n)``.

    ``item`` and ``value`` are hashes, ``source`` a string; ``prior(source, weight)`` starts
    the weights (0.5 where there is none). Returns ``(item, value, support)``, with support
    summing to 1 over an item, and ``(source, weight)``. Stops when no weight moves by
    more than ``tolerance``; if ``most_rounds`` do not get there, an error says so. Null
    sources share one weight.
    """
    stage = stage or Stage(votes.sparkSession, "truth")
    v = votes.withColumn("source", F.coalesce("source", F.lit("")))
    sources = v.select("source").distinct().join(prior.dropDuplicates(["source"]), "source", "left").select("source", F.coalesce("weight", F.lit(0.5)).alias("weight"))
    weights = stage.write(sources, "weights")
    for _ in range(most_rounds):
        support = _support(v, weights)
        new = v.join(support, ["item", "value"]).groupBy("source").agg((F.sum(F.col("n") * F.col("support")) / F.sum("n")).alias("new"))
        both = stage.write(weights.join(new, "source").select("source", F.col("new").alias("weight"), F.abs(F.col("new") - F.col("weight")).alias("moved")), "weights")
        stage.drop(weights)
        weights = both
        if (both.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"weights still move after {most_rounds} rounds")
    weights = weights.select("source", "weight")
    return _support(v, weights), weights


def _support(votes: DataFrame, weights: DataFrame) -> DataFrame:
    per = votes.join(weights, "source").groupBy("item", "value").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    total = per.groupBy("item").agg(F.sum("s").alias("t"))
    return per.join(total, "item").select("item", "value", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0).alias("support"))


def judged_claims(mentions: DataFrame, trust: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Claims with ``rank``, ``support`` and the final ``genuine``, and the source weights.

    A name that looks genuine is cut off if another name of the entity goes on where it
    ends and has at least its support.
    """
    t = pick(trust, builder="builder_model", rank="trust_rank").dropna().groupBy("builder").agg(F.min("rank").alias("rank"))
    newest = stage.write(newest_mentions(mentions), "newest")
    c = claims(newest).join(F.broadcast(t) if t.count() <= 100_000 else t, "builder", "left")
    c = stage.write(c.withColumn("item", F.xxhash64("entity", "field")).withColumn("v", F.xxhash64("entity", "field", "value")), "claims")
    votes = stage.write(c.where("genuine").groupBy("item", F.col("v").alias("value"), F.col("builder").alias("source")).agg(F.count(F.lit(1)).alias("n")), "votes")
    prior = t.select(F.col("builder").alias("source"), (1 / (1 + F.col("rank"))).alias("weight"))
    support, weights = truth_discovery(votes, prior, stage=stage)
    support = stage.write(support.select("item", F.col("value").alias("v"), "support"), "support")
    # every value tells all its beginnings, so that a value meets the best supported of those that go on from it
    names = stage.write(c.where("genuine and field = 'original_name'").select("item", "v", "value").distinct().join(support, ["item", "v"]), "names")
    starts = names.where("length(value) > 1").selectExpr("item", "support", "value as whole", "explode(sequence(1, length(value) - 1)) as l")
    longer = starts.groupBy("item", F.expr("substring(whole, 1, l)").alias("value")).agg(F.max("support").alias("most"))
    cut = names.join(longer, ["item", "value"])
    cut = stage.write(cut.where("most >= support").select("item", "v", F.lit(True).alias("cut")), "cut")
    near = F.broadcast(cut) if cut.count() <= 200_000 else cut
    out = c.join(support, ["item", "v"], "left").join(near, ["item", "v"], "left")
    return out.withColumn("genuine", F.col("genuine") & F.col("cut").isNull()).drop("cut", "item", "v"), weights


def surviving_mentions(mentions: DataFrame, trust: DataFrame) -> DataFrame:
    """``(canonical_entity_id, field_name, mention_id)``: whose value survives.

    For every entity with two or more mentions and every field, the genuine claim that
    no other genuine claim of the field beats in trust (lower ``trust_rank``) or in time
    of extraction; none where trust and time disagree or nothing is genuine. Builders
    without a rank are the least trusted, a null time is the earliest; of equals the
    smallest mention id is taken.
    """
    stage = Stage(mentions.sparkSession, "survivors")
    c, _ = judged_claims(mentions, trust, stage)
    rank, at = F.coalesce("rank", F.lit(2147483647)), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62)))
    c = c.select("entity", "field", "mention_id", "genuine", rank.alias("rank"), at.alias("at"))
    g = c.groupBy("entity", "field").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("genuine"), F.struct(F.col("rank"), (-F.col("at")).alias("age"), F.col("mention_id")))).alias("best"),
        F.max(F.when(F.col("genuine"), F.col("at"))).alias("last"),
    )
    g = g.where("n >= 2 and best is not null and -best.age = last")
    return g.select(F.col("entity").alias("canonical_entity_id"), F.col("field").alias("field_name"), F.col("best.mention_id").alias("mention_id"))


def surviving_records(mentions: DataFrame, trust: DataFrame) -> DataFrame:
    """``(canonical_entity_id, original_name, entity_type, description, ..._support)``, one row an entity.

    Each field has the value with the highest support by truth discovery; of equals the
    more trusted, then the later, then the greatest. A field without a genuine value is null.
    """
    stage = Stage(mentions.sparkSession, "survivors")
    c, _ = judged_claims(mentions, trust, stage)
    key = F.struct("support", (-F.coalesce("rank", F.lit(2147483647))).alias("r"), F.col("at"), F.col("value"))
    best = [F.max(F.when(F.col("genuine") & (F.col("field") == f), key)).alias(f) for f in FIELDS]
    g = c.groupBy("entity").agg(*best)
    cols = [x for f in FIELDS for x in (F.col(f"{f}.value").alias(f), F.col(f"{f}.support").alias(f"{f}_support"))]
    return g.select(F.col("entity").alias("canonical_entity_id"), *cols)
