"""Order-dependent work over groups of any size: ranks, running sums, exact percentiles, top-k.

A window over a group runs in one task, so a group holding a third of the rows
would not finish. Groups above ROWS_PER_BLOCK are cut: bounds come from a sample
of their rows, each row finds its block by binary search in the bounds of its
group, and one shuffle by group and block brings rows together. Blocks are
worked on alone, and what earlier blocks of a group add up to is carried in.
Smaller groups stay whole, and where there are no others the plan is a plain window.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "_block"
#: Rows of a group that one task orders; a larger group is cut into blocks of about as many.
ROWS_PER_BLOCK = 1_000_000
#: The most bounds of a table, whatever its size: they are broadcast.
MOST_BLOCKS = 4_096
_SAMPLED_PER_BLOCK = 20
#: Rows that a settled roll-up is made from, per partition of its shuffles, and bytes that a task reads in them, about.
ROWS_PER_PARTITION = 400_000
BYTES_PER_PARTITION = 16 * 2**20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, one under the session's warehouse."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile shuffles to partitions that grow in number with the rows, in place of in size.

    Settings stay as they are where the session's own number of partitions is enough. Other threads of the session that
    plan a query meanwhile get these partitions as well, which changes no result.
    """
    number, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    parts = -(-rows // ROWS_PER_PARTITION)
    if parts <= int(spark.conf.get(number)):
        yield
        return
    before = {name: spark.conf.get(name, None) for name in (number, size)}
    try:
        spark.conf.set(number, str(parts))
        spark.conf.set(size, str(BYTES_PER_PARTITION))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def settle(df: DataFrame, rows_read: int = 0) -> DataFrame:
    """Work out a roll-up once and keep it in the checkpoint folder, for use by several passes.

    rows_read: how many rows it is made from. Joins and sums on the way are dealt to more tasks where these are more than
    the session's number of partitions suits, so that no task's memory grows with them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _partitions_for(df.sparkSession, rows_read):
        return df.checkpoint()


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality with columns of right that are called _k_<name>."""
    return reduce(Column.__and__, [left[n].eqNullSafe(right[f"_k_{n}"]) for n in names])


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(f"_k_{n}") for n in names], *[c for c in df.columns if c not in names])


def with_blocks(
    df: DataFrame, group: Sequence[str], key: Sequence[str], rows_per_block: int | None = None, descending: bool = False
) -> tuple[DataFrame, bool]:
    """df with BLOCK, and whether any group is cut.

    BLOCK is 0 in groups that fit a block. In others it never falls along the key, NULL first, or against the key
    where descending: positive numbers there, negative ones here. End the key with a unique column so that ties can be
    cut as well. Bounds come from a sample, so that blocks are about even; they are kept, and retried tasks see the same.
    """
    limit = rows_per_block or ROWS_PER_BLOCK
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    rows, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    limit = max(limit, -(-rows // MOST_BLOCKS))
    if most <= limit:
        return df.withColumn(BLOCK, F.lit(0)), False
    # Fewer groups than MOST_BLOCKS are above the limit.
    large = df
    if group:
        hot = F.broadcast(_renamed(sizes.where(F.col("_n") > limit).drop("_n"), group))
        large = df.join(hot, _same(df, hot, group), "left_semi")
    share = min(1.0, _SAMPLED_PER_BLOCK / limit)
    drawn = large.sample(share, 7).select(*group, F.struct(*key).alias("_key"))
    step = max(1, round(limit * share))
    bounds = drawn.groupBy(*group).agg(F.sort_array(F.collect_list("_key")).alias("_all"))
    bounds = bounds.select(*group, F.filter("_all", lambda _, i: i % step == 0).alias("_bounds"))
    bounds = settle(bounds)
    if group:
        found = F.broadcast(_renamed(bounds, group))
        placed = df.join(found, _same(df, found, group), "left").drop(*[f"_k_{n}" for n in group])
    else:
        placed = df.withColumn("_bounds", bounds.select("_bounds").scalar())
    halves = [2**i for i in reversed(range((MOST_BLOCKS * 2).bit_length()))]
    placed = placed.withColumn("_key", F.struct(*key))
    passed = F.aggregate(
        F.array(*[F.lit(w) for w in halves]),
        F.lit(0),
        lambda at, w: F.when(F.get("_bounds", at + w - 1) <= F.col("_key"), at + w).otherwise(at),
    )
    sign = -1 if descending else 1
    block = F.when(F.col("_bounds").isNull(), 0).otherwise(sign * (passed + 1)).cast("int")
    return placed.withColumn(BLOCK, block).drop("_bounds", "_key"), True


def running(
    blocked: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    block: str = BLOCK,
    whole: Mapping[str, str] | None = None,
    cut: bool = True,
) -> DataFrame:
    """Add running sums, the row itself included, in group order; whole names sums over the group.

    blocked has a block column that never falls in that order. Rows with a NULL
    group key are left out, as a group-by on the Python side would. cut tells
    that groups have several blocks; without it a window does the work.
    """
    keys = [*group, block]
    rows = blocked.where(reduce(Column.__and__, [F.col(g).isNotNull() for g in group])) if group else blocked
    rows = rows.repartition(*keys)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy(*keys)
    added = {n: F.sum(c).over(inside) for n, c in sums.items()}
    totals = {name: F.sum(sums[n]).over(here) for name, n in (whole or {}).items()}
    if not cut:
        return rows.withColumns({**added, **totals})
    parts = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_part_{n}") for n, c in sums.items()])
    # One row per group and block. With no group this window sees one row per block, MOST_BLOCKS or so of them.
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys,
        *[F.coalesce(F.sum(f"_part_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in sums],
        *[F.sum(f"_part_{n}").over(Window.partitionBy(*group)).alias(name) for name, n in (whole or {}).items()],
    )
    carried = {n: F.col(f"_carry_{n}") + c for n, c in added.items()}
    return rows.join(carry, keys).withColumns(carried).drop(*[f"_carry_{n}" for n in sums])


def row_numbers(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    size: str | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """row_number() over (partition by group order by order) for groups of any size; size names the group's rows."""
    blocked, cut = with_blocks(df, group, order, rows_per_block)
    whole = {size: name} if size else None
    return running(blocked, group, order, {name: F.lit(1).cast("bigint")}, whole=whole, cut=cut).drop(BLOCK)


def percent_ranks(
    df: DataFrame, group: str, value: str, name: str, tie: Sequence[str], rows_per_block: int | None = None
) -> DataFrame:
    """percent_rank() over (partition by group order by value desc), NULL values last; NULL is a group.

    tie columns split equal values over blocks. A row's place is the number of
    rows before the first of its value: known inside a block, and carried in
    where the value began in an earlier block.
    """
    order = F.col(value).desc_nulls_last()
    blocked, cut = with_blocks(df, [group], [value, *tie], rows_per_block, descending=True)
    blocked = blocked.repartition(group, BLOCK)
    here = Window.partitionBy(group, BLOCK)
    placed = blocked.withColumns({"_at": F.rank().over(here.orderBy(order)) - 1, "_rows": F.count(F.lit(1)).over(here)})
    place, size = F.col("_at"), F.col("_rows")
    if cut:
        last = F.when(F.count(value) == F.count(F.lit(1)), F.min(value))
        parts = placed.groupBy(group, BLOCK).agg(
            F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last_at"), last.alias("_last")
        )
        # One row per group and block from here on.
        whole = Window.partitionBy(group)
        earlier = whole.orderBy(BLOCK)
        begun = F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumns({"_before": begun, "_size": F.sum("_n").over(whole)})
        parts = parts.withColumn(
            "_start", F.min(F.col("_before") + F.col("_last_at")).over(Window.partitionBy(group, "_last"))
        )
        carry = parts.select(
            F.col(group).alias("_group"), F.col(BLOCK).alias("_part"), "_before", "_size",
            F.lag("_last").over(earlier).alias("_open"), F.lag("_start").over(earlier).alias("_open_at"),
        )
        placed = placed.join(carry, placed[group].eqNullSafe(carry["_group"]) & (placed[BLOCK] == carry["_part"]))
        goes_on = F.col("_open_at").isNotNull() & F.col("_open").eqNullSafe(F.col(value))
        place, size = F.when(goes_on, F.col("_open_at")).otherwise(F.col("_before") + F.col("_at")), F.col("_size")
    rank = F.when(size == 1, F.lit(0.0)).otherwise(F.try_divide(place, size - 1))
    added = ["_at", "_rows", "_group", "_part", "_before", "_size", "_open", "_open_at"]
    return placed.withColumn(name, rank.cast("double")).drop(BLOCK, *added)


# --- exact percentiles ---------------------------------------------------------------

#: Bins of the whole range of doubles, on a scale of logarithms, and of each bin that is cut further.
COARSE_BINS = 65_536
FINE_BINS = 4_096


def _scale(value: Column) -> Column:
    """-800 to 801, never falling as value rises: large values are spread by their logarithm, NaN comes last."""
    spread = F.signum(value) * F.log1p(F.abs(value))
    return F.when(F.isnan(value), 801.0).otherwise(F.greatest(F.lit(-800.0), F.least(F.lit(800.0), spread)))


def _coarse_bin(value: Column, bins: int) -> Column:
    return F.floor((_scale(value) + 800) * (bins / 1602)).cast("int")


def _fine_bin(bins: int) -> Column:
    """Bin 0..bins-1 of _value between _low and _high; 0 where they are equal."""
    start, width = _scale(F.col("_low")), (_scale(F.col("_high")) - _scale(F.col("_low"))) / bins
    at = F.floor(F.try_divide(_scale(F.col("_value")) - start, width))
    return F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1))).cast("int")


def _wanted(parts: DataFrame, keys: Sequence[str], ranks: Column) -> DataFrame:
    """Of parts (keys, _from, _bin, _n, _low, _high) those that hold a wanted rank; _from counts the rows before."""
    inside = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_from") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    placed = parts.withColumn("_first", first).withColumn("_ranks", ranks)
    held = F.exists("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_n")))
    return placed.where(held)


def exact_percentiles(
    df: DataFrame, shares: Mapping[str, Sequence[float]], coarse_bins: int = COARSE_BINS, fine_bins: int = FINE_BINS
) -> dict[str, Column]:
    """Linearly interpolated percentiles, exact for any number of rows: an array per column, NULL without any value.

    Values are never ordered as a whole. Rows are counted in bins of the range of doubles; the bins that hold a wanted
    rank are cut into bins once more, and only the distinct values of the fine bins that hold one are ordered. Each
    step is a scan that shuffles bin counts, and hands on as many rows as ranks are wanted, which are broadcast. df is
    scanned three times: hand in a stored or cheap one. The arrays come back as a scalar subquery of the plan that
    uses them: nothing reaches the driver.
    """
    names = list(shares)
    pairs = F.array(*[F.struct(F.lit(i).alias("_no"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(names)])
    rows = df.select(F.inline(pairs)).where(F.col("_value").isNotNull())
    listed = F.array(*[F.array(*[F.lit(float(s)) for s in shares[c]]) for c in names])
    at = F.transform(F.get(listed, F.col("_no")), lambda s: s * (F.col("_size") - 1))
    ranks = F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x))))
    count = [F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high")]

    # As many rows as there are bins with values.
    coarse = rows.groupBy("_no", _coarse_bin(F.col("_value"), coarse_bins).alias("_bin")).agg(*count)
    coarse = coarse.withColumns(
        {"_size": F.sum("_n").over(Window.partitionBy("_no")), "_from": F.lit(0).cast("long")}
    )
    # At most two bins per wanted percentile from here on.
    coarse = _wanted(coarse, ["_no"], ranks).select(
        F.col("_no").alias("_of"), "_size", F.col("_first").alias("_from"), "_low", "_high"
    )

    def inside(of: DataFrame) -> DataFrame:
        bins_of = F.broadcast(of)
        held = (rows["_no"] == bins_of["_of"]) & rows["_value"].between(bins_of["_low"], bins_of["_high"])
        return rows.join(bins_of, held)

    fine = inside(coarse).withColumn("_bin", _fine_bin(fine_bins))
    fine = fine.groupBy("_no", "_size", "_from", "_bin").agg(*count)
    fine = _wanted(fine, ["_no", "_from"], ranks).select(
        F.col("_no").alias("_of"), "_size", F.col("_first").alias("_from"), "_low", "_high"
    )
    values = inside(fine).groupBy("_no", "_size", "_from", F.col("_value").alias("_bin")).agg(*count)
    values = _wanted(values, ["_no", "_from"], ranks)

    # Each wanted place between the values at the ranks below and above it.
    order = F.transform(at, lambda x, i: F.struct(i.alias("no"), x.alias("at")))
    found = values.withColumn("_place", F.explode(order))
    place = F.col("_place.at")

    def held_by(rank: Column) -> Column:
        return (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_n"))

    both = found.groupBy("_no", F.col("_place.no").alias("no")).agg(
        F.max(F.when(held_by(F.floor(place)), F.col("_low"))).alias("low"),
        F.max(F.when(held_by(F.ceil(place)), F.col("_low"))).alias("high"),
        F.max(place - F.floor(place)).alias("part"),
    )
    value = F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    lists = both.groupBy("_no").agg(F.array_sort(F.collect_list(F.struct("no", value.alias("value")))).alias("list"))
    lists = lists.select("_no", F.transform("list", lambda x: x["value"]).alias("list"))
    # One row per column.
    row = lists.agg(F.map_from_entries(F.collect_list(F.struct("_no", "list")))).scalar()
    return {c: F.try_element_at(row, F.lit(i)) for i, c in enumerate(names)}


def equal_count_bucket(rank: Column, size: Column, buckets: int = 10) -> Column:
    """Bucket 1..n of a rank, equal to cutting the ranks at their own quantiles."""
    return F.greatest(
        F.lit(1),
        F.coalesce(F.ceil(F.try_divide((rank - 1) * buckets, size - 1)), F.lit(1)),
    ).cast("int")


def top_k(
    df: DataFrame,
    group: str,
    score: str,
    tie: Sequence[str],
    k: int,
    ascending: bool = False,
    filled: str | None = None,
) -> DataFrame:
    """First k rows of each group by score, optionally only those with text in `filled`.

    Spark keeps at most k rows per group and map task before it shuffles, so a
    hot group is cut down where it is read.
    """
    for column in (group, score, *tie, *([filled] if filled else [])):
        if column not in df.columns:
            raise KeyError(f"Missing required column: {column}")
    if filled:
        df = df.where(F.col(filled).isNotNull() & (F.col(filled).cast("string") != ""))
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    order = Window.partitionBy(group).orderBy(first, *tie)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def sample_share(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A repeatable share of the rows, by a seeded hash of the key: no sort, no shuffle, no bound on rows."""
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.where(drawn < share * 2**32)
