"""Exact order statistics that never put a whole group into one task.

A group (one gene, one cohort, one family of tests) may hold any share of the
rows, so no window here is partitioned by the group alone while it scans
measurements. Every kernel works in three steps:

1. a *monotone block* of the ordering value splits each group into value ranges.
   The block is a pure function of the value, so it needs no sampling and gives
   the same answer when a lost task is recomputed;
2. block totals (pre-aggregated map-side, one small row per group and block) are
   accumulated along the blocks, which yields each block's offset;
3. rows join their offset on (group, block) and a window over (group, block)
   finishes the count.

The number of blocks per octave follows ``spark.sql.shuffle.partitions``: a
session tuned for more tasks splits a hot group into more pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastry.session import materialize

BLOCK = "_block"
ONE = "_one"


def blocks_per_octave(df: DataFrame) -> int:
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def value_block(value: Column, per_octave: int) -> Column:
    """Monotone in ``value``: equal steps of log2(1 + |value|) on either side of zero.

    Never NULL, so that the join on it infers no filter and both readers of the
    blocked rows share one exchange.
    """
    return F.coalesce(F.floor(F.signum(value) * F.log2(F.abs(value) + 1.0) * per_octave).cast("long"), F.lit(0).cast("long"))


def small_value_block(value: Column, per_octave: int) -> Column:
    """For values in (0, 1] that crowd towards zero, such as p-values."""
    return F.coalesce(F.floor(F.log2(F.greatest(value, F.lit(1e-300))) * per_octave).cast("long"), F.lit(0).cast("long"))


def _offsets(blocked: DataFrame, keys: Sequence[str], weights: Sequence[str], descending: bool) -> DataFrame:
    order = F.col(BLOCK).desc() if descending else F.col(BLOCK).asc()
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(w).alias(w) for w in weights])
    return totals.select(
        *keys,
        BLOCK,
        *[F.coalesce(F.sum(w).over(along), F.lit(0)).alias(f"_{w}_offset") for w in weights],
        *[F.sum(w).over(whole).alias(f"_{w}_all") for w in weights],
    )


def running_totals(
    cells: DataFrame,
    keys: Sequence[str],
    order: str,
    weights: Sequence[str],
    *,
    descending: bool = False,
    block: Column | None = None,
) -> DataFrame:
    """Add ``{w}_before`` (total over cells ordered strictly before) and ``{w}_total``.

    ``cells`` holds one row per (keys, order): ties are already summed, so a value
    shared by a third of all rows is one row here.
    """
    keys = list(keys)
    block = value_block(F.col(order), blocks_per_octave(cells)) if block is None else block
    blocked = cells.withColumn(BLOCK, block)
    joined = blocked.join(_offsets(blocked, keys, weights, descending), [*keys, BLOCK])
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(F.col(order).desc() if descending else F.col(order).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = joined
    for w in weights:
        out = out.withColumn(f"{w}_before", F.col(f"_{w}_offset") + F.coalesce(F.sum(w).over(inside), F.lit(0)))
        out = out.withColumn(f"{w}_total", F.col(f"_{w}_all"))
    return out.drop(BLOCK, *[f"_{w}_{s}" for w in weights for s in ("offset", "all")])


def mid_rank_of(weight: str) -> Column:
    """Average rank of a tie cell from its running total."""
    return F.col(f"{weight}_before") + (F.col(weight) + 1.0) / 2.0


def quantile_of(value: str, weight: str, q: float) -> Column:
    """Linear-interpolation quantile over tie cells, as a grouped aggregate."""
    position = (F.col(f"{weight}_total") - 1.0) * q
    low, high = F.floor(position), F.ceil(position)
    begin, end = F.col(f"{weight}_before"), F.col(f"{weight}_before") + F.col(weight)
    at_low = F.max(F.when((begin <= low) & (low < end), F.col(value)))
    at_high = F.max(F.when((begin <= high) & (high < end), F.col(value)))
    # the weighted form makes a median the exact mean of its two middle values
    share = F.max(position - low)
    return at_low * (F.lit(1.0) - share) + at_high * share


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    outputs: Mapping[str, float],
    *,
    mean: str | None = None,
    count: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles (and optionally mean and count) per group, NULL values ignored.

    ``weight`` is a multiplicity column: the quantile is that of the rows repeated
    so many times (used by the resampling operators).

    Selection instead of ordering: a first pass counts rows by block and finds the blocks that
    hold the wanted positions; only the rows of these blocks are shuffled and ordered. The mean
    and the count come from the first pass too. ``df`` is read twice. The blocks are written, so
    that their size is known when the second pass is planned: where it is small, the rows stay put.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), *([F.col(weight).alias("_w")] if weight else []))
    rows = rows.withColumn(BLOCK, value_block(F.col("_v"), blocks_per_octave(df)))
    times = F.col("_w") if weight else F.lit(1).cast("long")
    n = F.sum("_w") if weight else F.count(F.lit(1))
    along = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    held = rows.groupBy(*keys, BLOCK).agg(n.alias("_n"), *([F.sum(F.col("_v") * times).alias("_s")] if mean else []))
    placed = held.select(
        *keys, BLOCK, "_n", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_offset"), F.sum("_n").over(whole).alias("_n_total"),
        *([(F.sum("_s").over(whole) / F.sum("_n").over(whole)).alias("_mean")] if mean else []),
    )

    def inside(position: Column) -> Column:
        return (F.col("_offset") <= position) & (position < F.col("_offset") + F.col("_n"))

    wanted = F.lit(False)
    for q in outputs.values():
        position = (F.col("_n_total") - 1.0) * q
        wanted = wanted | inside(F.floor(position)) | inside(F.ceil(position))
    chosen = materialize(placed.where(wanted).drop("_n"), "blocks")
    shared = ["_offset", "_n_total", *(["_mean"] if mean else [])]
    cells = rows.join(chosen, [*keys, BLOCK]).groupBy(*keys, BLOCK, "_v").agg(n.alias("_n"), *[F.first(c).alias(c) for c in shared])
    before = Window.partitionBy(*keys, BLOCK).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ordered = cells.withColumn("_n_before", F.col("_offset") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a value that changed between the passes must not pass for a missing one
    aggs = [F.coalesce(quantile_of("_v", "_n", q), F.raise_error(F.lit("values changed between two reads")).cast("double")).alias(name) for name, q in outputs.items()]
    if mean:
        aggs.append(F.first("_mean").alias(mean))
    if count:
        aggs.append(F.first("_n_total").alias(count))
    return ordered.groupBy(*keys).agg(*aggs)


def unit_medians(df: DataFrame, keys: Sequence[str], outputs: Mapping[str, str]) -> DataFrame:
    """Medians of columns (output name to column) per small group, in one shuffle; for keys that
    hold a case or a sample. Groups without a value in one of the columns are left out.

    A group has a few rows in many tasks, so that nothing combines before the shuffle: the rows move as
    they are and are numbered by value behind it. A hash of the keys leads the sort: it differs where
    the names of cohorts and genes begin alike.
    """
    by = ["_hash", *keys]
    whole = Window.partitionBy(*by)
    columns = list(dict.fromkeys(outputs.values()))
    numbered = df.select(F.xxhash64(*keys).alias("_hash"), *keys, *columns)
    for c in columns:
        numbered = numbered.withColumn(f"_place_{c}", F.row_number().over(whole.orderBy(F.col(c).asc_nulls_last())))
    numbered = numbered.withColumns({f"_n_{c}": F.count(c).over(whole) for c in columns})

    def median(c: str) -> Column:
        twice = F.col(f"_place_{c}") * 2 - F.col(f"_n_{c}")  # 1 in the middle, 0 and 2 beside it
        return F.sum(F.col(c) * F.when(twice == 1, 1.0).when(twice.isin(0, 2), 0.5))

    medians = numbered.groupBy(*by).agg(*[median(c).alias(out) for out, c in outputs.items()])
    return medians.drop("_hash").dropna(subset=list(outputs))


def _with_offsets(df: DataFrame, keys: Sequence[str], block: Column, descending: bool) -> DataFrame:
    blocked = df.withColumn(BLOCK, block).withColumn(ONE, F.lit(1).cast("long"))
    return blocked.join(_offsets(blocked, keys, [ONE], descending), [*keys, BLOCK])


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK, ONE, f"_{ONE}_offset", f"_{ONE}_all")


def mid_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, *, total: str | None = None, descending: bool = False) -> DataFrame:
    """Average rank of every row within its group; ``total`` adds the group size.

    Ties collapse into one cell before anything is ordered, so a value shared by most rows
    of a group is one row of the window; the rows then look their cell up. NULL ranks lowest.
    """
    keys = list(keys)
    cells = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    low = F.lit(-(2**62))
    block = F.when(F.col("_cell").isNull(), low).otherwise(value_block(F.col("_cell"), blocks_per_octave(df)))
    ranks = running_totals(cells, [f"_k_{k}" for k in keys], "_cell", ["_n"], descending=descending, block=block)
    ranks = ranks.select(*[f"_k_{k}" for k in keys], "_cell", mid_rank_of("_n").alias(out), F.col("_n_total").alias(total or "_n_total"))
    same = F.col(value).eqNullSafe(F.col("_cell"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    helpers = [f"_k_{k}" for k in keys] + ["_cell"] + ([] if total else ["_n_total"])
    return df.drop(*[c for c in (out, total) if c]).join(ranks, same).drop(*helpers)


def row_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ties: Sequence[str | Column],
    out: str,
    *,
    total: str | None = None,
    descending: bool = True,
    block: Column | None = None,
) -> DataFrame:
    """Distinct ranks 1..n within the group by ``value``, ties settled by ``ties``.

    ``block`` may refine the split where many rows tie on ``value``: any column that
    ascends along the full order.
    """
    keys = list(keys)
    if block is None:
        joined = _with_offsets(df, keys, value_block(F.col(value), blocks_per_octave(df)), descending)
    else:
        joined = _with_offsets(df, keys, block, False)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order, *ties)
    ranked = joined.withColumn(out, F.col(f"_{ONE}_offset") + F.row_number().over(inside))
    if total:
        ranked = ranked.withColumn(total, F.col(f"_{ONE}_all"))
    return _drop_helpers(ranked)


def hash_rank(df: DataFrame, keys: Sequence[str], digest: Column, ties: Sequence[str], out: str, *, total: str | None = None) -> DataFrame:
    """Ranks 1..n by a hexadecimal digest; its leading digits are an even block."""
    keys = list(keys)
    hashed = df.withColumn("_digest", digest)
    # evenly filled blocks, 16 or more for each shuffle partition
    digits = 2 + (blocks_per_octave(df) - 1).bit_length() // 4
    joined = _with_offsets(hashed, keys, F.conv(F.substring("_digest", 1, digits), 16, 10).cast("long"), False)
    inside = Window.partitionBy(*keys, BLOCK).orderBy("_digest", *ties)
    ranked = joined.withColumn(out, F.col(f"_{ONE}_offset") + F.row_number().over(inside))
    if total:
        ranked = ranked.withColumn(total, F.col(f"_{ONE}_all"))
    return _drop_helpers(ranked).drop("_digest")


def bh_q_values(df: DataFrame, family: Sequence[str], p: str, out: str) -> DataFrame:
    """Benjamini-Hochberg q-values within each family.

    The step-up minimum runs over the larger p-values: first inside the block,
    then over the minima of the blocks above it.
    """
    family = list(family)
    clean = F.when(F.isnan(p) | F.col(p).isNull(), 1.0).otherwise(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)))
    tested = df.withColumn("_bh_p", clean)
    keys = [f"_k_{k}" for k in family]
    # equal p-values are one cell: all of p = 1, say, is one row from here on
    cells = tested.groupBy(*[F.col(k).alias(f"_k_{k}") for k in family], F.col("_bh_p").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    block = small_value_block(F.col("_cell"), blocks_per_octave(df))
    raw = running_totals(cells, keys, "_cell", ["_n"], block=block).select(
        *keys, "_cell", block.alias(BLOCK), (F.col("_cell") * F.col("_n_total") / (F.col("_n_before") + F.col("_n"))).alias("_raw"))
    above = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    minima = (
        raw.groupBy(*keys, BLOCK).agg(F.min("_raw").alias("_low"))
        .select(*keys, BLOCK, F.coalesce(F.min("_low").over(above), F.lit(1.0)).alias("_later"))
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = raw.join(minima, [*keys, BLOCK]).select(*keys, "_cell", F.least(F.lit(1.0), F.col("_later"), F.min("_raw").over(inside)).alias(out))
    same = F.col("_bh_p") == F.col("_cell")
    for k in family:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return tested.drop(out).join(stepped, same).drop(*keys, "_cell", "_bh_p")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str, *, minimum: int = 2, degenerate: float | None = None) -> DataFrame:
    """Spearman correlation per group; ``degenerate`` when a side is constant or too short."""
    pairs = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = mid_rank(mid_rank(pairs, keys, "_x", "_rx"), keys, "_y", "_ry")
    usable = (F.count(F.lit(1)) >= minimum) & (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return ranked.groupBy(*keys).agg(
        # corr() itself would divide by zero for a constant side under ANSI
        F.when(usable, F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))).otherwise(F.lit(degenerate).cast("double")).alias(out)
    )


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, *, total: str | None = None) -> DataFrame:
    """Ranks 1..n along any order, within groups or (``keys`` empty) over all rows.

    Rows are dealt by range of the whole order, with boundaries that Spark takes from the
    data, so neither a shared prefix nor a tie on the first columns keeps a group together.
    The dealt rows are written once: a part's number is then fixed, and a lost task reads it
    again. Offsets need one row for each (group, part).
    """
    keys = list(keys)
    along = [*[F.col(k) for k in keys], *order]
    dealt = materialize(df.repartitionByRange(*along).withColumn(BLOCK, F.spark_partition_id().cast("long")), "ranges")
    joined = _with_offsets(dealt, keys, F.col(BLOCK), False)
    ranked = joined.withColumn(out, F.col(f"_{ONE}_offset") + F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order)))
    if total:
        ranked = ranked.withColumn(total, F.col(f"_{ONE}_all"))
    return _drop_helpers(ranked)


def text_rank(df: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str) -> DataFrame:
    """Ranks 1..n by text columns."""
    return ordered_rank(df, keys, [F.col(c) for c in columns], out)
