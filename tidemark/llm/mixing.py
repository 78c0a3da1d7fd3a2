"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document gets the key -ln(u) / w: u is uniform and drawn from a hash of seed, doc_id, text and a number within equal
rows, w is its quality weight. So rows without id are drawn as others are, whatever their size.
Within a source the documents with the smallest keys come first, as far as the source's budget of words goes. A budget
above the source's size first takes complete epochs of all its documents and then a fractional one.

The order within a source is never sorted as a whole: keys map to buckets of equal width in 1 - exp(-key), the words
per source and bucket are summed, and only the bucket in which the budget ends is ordered. Reruns agree, as keys depend
on the rows alone. Equal rows are counted before anything is shuffled and dealt out again in pieces. Everything runs in
DataFrame operations.

Rows: NULL text has size 0. NULL is a source of its own and comes last. Sources of size 0 have target 0. Repeated rows
count each for itself; ties in the key go by doc_id, text hash and number, NULL first. Empty tables give no rows. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.skew import repeated
from tidemark.llm.text import size_of
from tidemark.operators.ordering import settle

BUCKETS = 4_096
MAX_EPOCHS = 3
CYCLE = 3
SEED = "mix-1"
#: Quality weight by label; documents without one weigh 1.
WEIGHTS = {1: 2.0, 0: 0.5}
_DRAWS = 2**52


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight from quality labels; of several labels of a document the best counts."""
    best = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    weight = F.lit(1.0)
    for label, value in WEIGHTS.items():
        weight = F.when(F.col("q") == label, value).otherwise(weight)
    return best.select("doc_id", weight.alias("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weights 1, 2, 3, ... of all words, none above three times its source.

    The excess over a cap goes to the others by weight until none is above: all targets are min(cap, level x weight)
    for one level. With sources ordered by cap / weight, the level follows from sums over the capped ones before.
    One row per source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sizes.withColumn("w", (F.row_number().over(ordered) - 1) % CYCLE + 1)
    t = t.withColumn("ratio", F.col("source_size") * MAX_EPOCHS / F.col("w"))
    t = t.withColumn("capped", F.coalesce(F.sum(F.col("source_size") * MAX_EPOCHS).over(by_cap), F.lit(0)))
    t = t.withColumn("gone", F.coalesce(F.sum("w").over(by_cap), F.lit(0)))
    level = (F.sum("source_size").over(everything) - F.col("capped")) / (F.sum("w").over(everything) - F.col("gone"))
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.least((F.col("source_size") * MAX_EPOCHS).cast("double"), F.col("level") * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def draw(seed: str) -> Column:
    """Uniform in (0, 1): 52 bits of an MD5 hash, which SQL engines share, of seed, doc_id, text hash and number."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5", "number")
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(_DRAWS))


def _weighted(rows: DataFrame, weights: DataFrame | None) -> DataFrame:
    """rows with weight, 1 where none is known; rows without id need no partner and stay out of the join."""
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    named = rows.filter("doc_id IS NOT NULL").join(weights.select("doc_id", "weight"), "doc_id", "left")
    bare = rows.filter("doc_id IS NULL").withColumn("weight", F.lit(1.0))
    return named.fillna(1.0, ["weight"]).unionByName(bare)


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the source, weight and sampling key of every document."""
    rows = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), size_of("text").alias("size"))
    rows = settle(rows.groupBy("doc_id", "source", "text_md5", "size").agg(F.count(F.lit(1)).alias("times")))
    rows = repeated(settle(_weighted(rows, weights)), "times", "number")
    rows = rows.withColumn("mix_key", -F.log(draw(seed)) / F.col("weight"))
    bucket = F.least(F.floor((1 - F.exp(-F.col("mix_key"))) * buckets), F.lit(buckets - 1)).cast("int")
    rows = settle(rows.withColumn("bucket", bucket))

    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    cells = settle(cells)
    plan = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")))
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("epochs", F.floor(F.col("target") / size))
    plan = settle(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    # Where the fractional epoch ends: the first bucket at which the running sum reaches the rest.
    upto = F.sum("cell").over(Window.partitionBy("source").orderBy("bucket"))
    crossing = cells.withColumn("upto", upto).alias("c").join(
        plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))
    )
    crossing = crossing.filter("upto >= rest").groupBy("p.source").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("cell")).alias("before"))).alias("end")
    )
    crossing = crossing.select(F.col("source").alias("_s"), "end.bucket", "end.before").withColumnRenamed("bucket", "_end")
    plan = plan.alias("p").join(crossing, F.col("p.source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = settle(plan.withColumnRenamed("source", "_s"))

    full = rows.join(plan, rows["source"].eqNullSafe(plan["_s"])).drop("_s")
    sure = full.filter("bucket <> _end OR _end IS NULL").withColumn(
        "chosen", F.coalesce(F.col("bucket") < F.col("_end"), F.lit(False))
    )
    order = Window.partitionBy("source").orderBy("mix_key", "doc_id", "text_md5", "number").rowsBetween(Window.unboundedPreceding, 0)
    edge = full.filter("bucket = _end").withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    # The document in which the budget ends goes in where that leaves the sum nearer to it.
    edge = edge.withColumn(
        "chosen", (F.col("start") < F.col("rest")) & (2 * F.col("start") + F.col("size") <= 2 * F.col("rest"))
    ).drop("start")
    taken = (F.col("size") * (F.col("epochs") + F.col("chosen").cast("int"))).cast("long")
    out = ["doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "weight", "mix_key"]
    return sure.select(*out).unionByName(edge.select(*out))
