"""Mixing sources to target weights by weighted fair queueing (operator 4). DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.common import WORD, materialize, n_words, table, with_rows


def source_targets(sources: DataFrame, weights: tuple[int, ...], budget: float, max_repeats: int) -> DataFrame:
    """(source, source_size) -> also weight, target: the budget shared by weight, none above max_repeats times its size.

    Sharing the excess again and again ends where one level v has sum(min(cap, v * weight)) = budget. Sources in the
    order of cap / weight fill up first, so v is the first level that the next source to fill does not reach. One row
    a source is all that these windows order.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") - 1) % n + 1)
    )
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    levels = (
        capped.withColumn("left", F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
    )
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("rank").alias("at"), "level"))).over(every)
    return levels.withColumn("v", first["level"]).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("v").isNull() | (F.col("v") >= F.col("full_at")), F.col("cap")).otherwise(F.col("v") * F.col("weight")).alias("target"),
    )


_BINS, _FEW = 256, 10_000


def _running(rows: DataFrame, per_range: int) -> DataFrame:
    """Add so_far: the size of a row's source up to and with it, in the order of key, doc_id, size and _row.

    Rows are range-sorted and each range's sum is added to those after it, first within groups of about the square
    root of the ranges, then over the groups: no window holds more than a range's rows, or a root's sums."""
    order = ["key", "doc_id", "size", "_row"]
    n = max(1, math.ceil(rows.count() / per_range))
    at = materialize(rows.repartitionByRange(n, "rank", *order).withColumn("at", F.spark_partition_id()))
    root = math.isqrt(n) + 1
    sums = at.groupBy("rank", "at").agg(F.sum("size").alias("sum")).withColumn("group", F.floor(F.col("at") / root))
    before = lambda *by: Window.partitionBy(*by)
    groups = sums.groupBy("rank", "group").agg(F.sum("sum").alias("group_sum"))
    groups = groups.withColumn("group_before", F.sum("group_sum").over(before("rank").orderBy("group")) - F.col("group_sum"))
    sums = sums.withColumn("sum_before", F.sum("sum").over(before("rank", "group").orderBy("at")) - F.col("sum"))
    offsets = sums.join(groups, ["rank", "group"]).select(F.col("rank").alias("of"), F.col("at").alias("of_at"), (F.col("sum_before") + F.col("group_before")).alias("offset"))
    own = F.sum("size").over(before("rank", "at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("own", own).join(offsets, (F.col("rank") == F.col("of")) & (F.col("at") == F.col("of_at"))).withColumn("so_far", F.col("own") + F.col("offset")).drop("own", "at", "of", "of_at", "offset")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_repeats: int = 2, seed: str = "mix", per_range: int = 20_000) -> DataFrame:
    """Take documents until the budget is spent, sources in proportion to their weights.

    docs: doc_id, text, source. Returns doc_id, source, size, source_size, target, taken. A document's size is its
    number of words. In the order of md5(seed, doc_id) each source's documents get virtual finish times, their
    source's words so far divided by its weight; a second round follows the first, up to max_repeats rounds. Sums over
    ever finer bins of finish time (_BINS each) find the bin that holds the budget's end; what finishes before is taken,
    and the few entries of that bin are put in order.

    Nulls: a null text has size 0, a null source is a source of its own and comes last, null doc_ids are shuffled
    together. Repeated rows are taken each for itself; rows of one doc_id, however many, follow in the order of size,
    then of a row id. Documents without words are never taken. An empty table gives an empty result. Ties in finish
    time go by source, then by shuffle order. Extra columns are ignored.
    """
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))
    sizes = with_rows(sizes)
    targets = materialize(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_repeats))
    ranked = sizes.join(targets.select(F.col("source").alias("of"), "rank"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    queued = _running(ranked, per_range).join(targets.select(F.col("rank").alias("of"), "source_size", "weight", "target"), F.col("rank") == F.col("of")).drop("of")
    queued = materialize(queued)

    top = queued.agg(F.max(max_repeats * F.col("source_size") / F.col("weight")), F.sum("size")).first()
    spend = budget * (top[1] or 0)
    finish = lambda r: (F.col("so_far") + r * F.col("source_size")) / F.col("weight")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("round")
    every = queued.where("size > 0").select("*", rounds).withColumn("finish", finish(F.col("round")))
    bins, spent, low, width = [], 0, 0.0, (top[0] or 0.0) / _BINS or 1.0
    inside = F.lit(True)
    while True:
        place = F.floor((F.col("finish") - F.lit(low)) / F.lit(width))
        found = every.where(inside).groupBy(place.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).orderBy("bin").collect()
        n = 0
        for r in found:
            if spent + r.words > spend:
                n = r.n
                break
            spent += r.words
        if not n:  # the budget outlasts all entries
            bins.append((low, width, _BINS + 1))
            break
        bins.append((low, width, r.bin))
        inside = inside & (place == F.lit(r.bin))
        low, width = low + r.bin * width, width / _BINS
        if n <= _FEW or low + width == low:
            break

    def state(time):
        """-1 before the bin that holds the budget's end, 0 in it, 1 after it."""
        out = F.lit(0)
        for low, width, end in reversed(bins):
            place = F.floor((time - F.lit(low)) / F.lit(width))
            out = F.when(place < F.lit(end), -1).when(place > F.lit(end), 1).otherwise(out)
        return out

    in_order = Window.partitionBy(F.lit(1)).orderBy("finish", "rank", "key", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    last = every.where(state(F.col("finish")) == 0).withColumn("spent", F.sum("size").over(in_order) + F.lit(spent)).where(F.col("spent") <= F.lit(spend))
    late = last.groupBy(F.col("_row").alias("of")).agg(F.count("*").alias("late"))
    known = sum((F.when(state(finish(F.lit(r))) < 0, 1).otherwise(0) for r in range(max_repeats)), F.lit(0))
    taken = F.when(F.col("size") > 0, F.col("size") * (known + F.coalesce(F.col("late"), F.lit(0)))).otherwise(0)
    return queued.join(late, F.col("_row") == F.col("of"), "left").select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, with weights 5, 2, 1 and 150 % of all words. Edge
    cases as in mix."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS full_at,
    (sum(source_size) OVER () * 1.5::DOUBLE
       - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, rank, weight,
    CASE WHEN v IS NULL OR v >= full_at THEN cap ELSE v * weight END AS target
  FROM (SELECT *, (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, rank LIMIT 1) AS v FROM levels)),
queued AS (
  SELECT s.*, t.source_size, t.rank, t.weight, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT q.*, CAST(so_far + r * source_size AS DOUBLE) / weight AS finish
  FROM queued q, (VALUES (0), (1)) rounds(r) WHERE size > 0),
spent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM entries),
taken AS (
  SELECT doc_id, count(*) AS n FROM spent WHERE spent <= 1.5 * (SELECT sum(size) FROM sizes) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(t.n, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""
