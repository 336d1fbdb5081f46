"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Sources are ordered by code point (null last) and weigh 5, 2, 1, repeating. All words together are
shared out by weight; sources whose share is more than max_epochs times their words are clamped there, and the
excess is shared out again among the others by weight, until none is above. A source's documents are then taken
whole epochs times, and the remaining fraction by a seeded order of the documents.

Documents are read once, into a table of their sizes. Sources may be as many as documents: they are ranked by
ranges, and shared out by sums over all of them, a round for each clamping.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own; an
empty table gives no rows; a source without words has target 0; rows that share a doc_id are ordered by size, and
those that share both are alike; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: ASCII white space separates words; everything else belongs to them.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: The seeded order is cut into so many bins; only the bin in which the fraction ends is sorted.
BINS = 4096


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their place (from 0) by code point, null last: sorted ranges, and the sizes of the ranges before."""
    by_name = [F.col("source").isNull(), F.col("source")]
    parts = settle(sources.repartitionByRange(*by_name).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # of a row a range
    offsets = parts.groupBy("range").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by_name)) - 1
    return parts.withColumn("place", place).join(offsets.drop("n"), "range").withColumn("place", F.col("place") + F.col("offset")).drop("range", "offset")


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources(source, source_size) -> with target."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = settle(ranked(sources).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "weights")
    everything = table.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("weight")).first()
    level, clamped = None, -1
    while everything["weight"]:
        above = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        sums = table.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("cap"), F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if sums["n"] == clamped:
            break
        clamped = sums["n"]
        if sums["weight"] == everything["weight"]:
            break
        level = (everything["total"] - sums["cap"]) / (everything["weight"] - sums["weight"])
    target = F.lit(0.0) if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, times, taken."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.conv(F.substring(key, 1, 12), 16, 10).cast("long").alias("u"))
    rows = settle(rows.withColumn("bin", F.shiftright(F.col("u"), 36).cast("int")), "sizes")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    plan = water_fill(sizes, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(epochs)).withColumn("want", F.col("target") - F.floor(epochs) * F.col("source_size"))
    # bins before the end of the fraction are taken once more; the bin where it ends is resolved row by row
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    at = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    plan = (
        at.alias("a").join(plan.alias("b"), same)
        .select("a.source", "a.bin", "a.before", "a.bin_size", "b.source_size", "b.target", "b.whole", "b.want")
        .withColumn("state", F.when(F.col("before") + F.col("bin_size") <= F.col("want"), 1).when(F.col("before") >= F.col("want"), 0).otherwise(2))
    )
    same = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bin") == F.col("p.bin"))
    rows = rows.alias("r").join(plan.alias("p"), same).select("r.doc_id", "r.source", "r.size", "r.u", "r.bin", "p.before", "p.source_size", "p.target", "p.whole", "p.want", "p.state")
    inside = Window.partitionBy("source", "bin").orderBy("u", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter("state = 2").withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # the document in which the fraction ends is taken if at least half of it lies before that end
    edge = edge.withColumn("extra", (F.col("start") + F.col("size") / 2 <= F.col("want")).cast("int")).drop("start")
    done = rows.filter("state < 2").withColumn("extra", F.col("state")).unionByName(edge)
    times = F.least(F.col("whole") + F.col("extra"), F.lit(max_epochs)).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: doc_id, source, times, epoch (from 1), one row for each repetition."""
    return mix_sources(docs, **options).filter("times > 0").select("doc_id", "source", "times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("epoch"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
lv AS (SELECT a.source, (SELECT sum(source_size) FROM s)::DOUBLE AS total, a.source_size, a.w, 3.0 * a.source_size AS cap,
    coalesce((SELECT sum(3.0 * b.source_size)::DOUBLE FROM s b WHERE b.source_size / b.w < a.source_size / a.w), 0) AS capped,
    coalesce((SELECT sum(b.w) FROM s b WHERE b.source_size / b.w < a.source_size / a.w), 0) AS used, (SELECT sum(w) FROM s) AS all_w FROM s a),
f AS (SELECT max((total - capped) / (all_w - used)) AS level FROM lv WHERE (total - capped) / (all_w - used) < cap / w),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap::DOUBLE, level * w) END::DOUBLE AS target FROM lv, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS want,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
    (least(whole + CASE WHEN start + size / 2.0 <= want AND want > 0 THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken FROM o
"""
