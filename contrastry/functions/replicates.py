"""Order statistics of many resampled replicates at once, without a row for each replicate.

How often a unit is drawn is one packed array on the unit; joined to a measurement it stays one
row, and all sums run over the packed columns: two replicates share a 64-bit word, 32 bits each,
so that one addition serves both. A shuffle moves rows of a fixed width (half a word for each
replicate) whose number does not depend on the replicates. Replicates become rows only where the
result has one row for each of them; that result is written, as it is read several times.

Bound: the draws of one group in one replicate must stay below 2**31 in sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastry.functions.ordered import BLOCK, blocks_per_octave, value_block
from contrastry.session import materialize

LOW = 0xFFFFFFFF


class Packed:
    """Names and arithmetic of the packed columns of one kind of weight."""

    def __init__(self, name: str, replicates: int):
        self.name, self.replicates = name, replicates
        self.columns = [f"{name}_{j}" for j in range((replicates + 1) // 2)]

    def of(self, times: Column) -> list[Column]:
        """Packed columns of an array with one number for each replicate."""
        def at(i: int) -> Column:
            return F.coalesce(F.get(times, F.lit(i)), F.lit(0)).cast("long")

        return [(at(2 * j) + F.shiftleft(at(2 * j + 1), 32)).alias(c) for j, c in enumerate(self.columns)]

    def sums(self) -> list[Column]:
        return [F.sum(c).alias(c) for c in self.columns]

    def over(self, window, suffix: str) -> list[Column]:
        return [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(c + suffix) for c in self.columns]

    def lanes(self, suffix: str = "") -> Column:
        """One array with the number of each replicate."""
        words = [F.col(c + suffix) for c in self.columns]
        return F.slice(F.array(*[x for w in words for x in (w.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(w, 32))]), 1, self.replicates)


def packed_times(draws: DataFrame, pool: Sequence[str], unit: str, numbers: Sequence[int]) -> DataFrame:
    """(pool, unit, _times): one array for each unit, in the order of the replicate ``numbers``."""
    held = draws.groupBy(*pool, unit).agg(F.map_from_entries(F.collect_list(F.struct("replicate", "times"))).alias("_held"))  # at most one entry a replicate
    return held.select(*pool, unit, F.array(*[F.coalesce(F.try_element_at("_held", F.lit(n)), F.lit(0)).cast("int") for n in numbers]).alias("_times"))


def _replicate_rows(keep: Column, numbers: Sequence[int]) -> Column:
    """Explodes an array with one struct for each replicate where ``keep`` of it holds."""
    named = F.zip_with(F.array(*[F.lit(n) for n in numbers]), keep, lambda n, s: F.struct(n.alias("replicate"), s.alias("s")))
    return F.explode(F.filter(named, lambda r: r["s"].isNotNull()))


def _middle(total: Column, q: float) -> tuple[Column, Column, Column]:
    position = (total - 1.0) * q
    return F.floor(position), F.ceil(position), position - F.floor(position)


def _holding(begin: Column, n: Column, total: Column, q: float) -> Column:
    """For each replicate whether cells from ``begin`` on hold the lower and the upper position; NULL where neither."""
    paired = F.zip_with(begin, n, lambda b, m: F.struct(b.alias("b"), (b + m).alias("e")))

    def held(cell: Column, t: Column) -> Column:
        low, high, share = _middle(t, q)
        is_low, is_high = (cell["b"] <= low) & (low < cell["e"]), (cell["b"] <= high) & (high < cell["e"])
        return F.when((t > 0) & (is_low | is_high), F.struct(is_low.alias("low"), is_high.alias("high"), share.alias("share")))

    return F.zip_with(paired, total, held)


def _between(keys: Sequence[str], out: str) -> list[Column]:
    low, high = F.max(F.when(F.col("r.s.low"), F.col("_v"))), F.max(F.when(F.col("r.s.high"), F.col("_v")))
    share = F.max("r.s.share")
    return [(low * (F.lit(1.0) - share) + high * share).alias(out)]


def replicated_quantile(values: DataFrame, keys: Sequence[str], value: str, times: str, numbers: Sequence[int], out: str, q: float = 0.5) -> DataFrame:
    """(keys, replicate, out): the quantile of the values repeated ``times`` in each replicate.

    A packed histogram by value block tells which blocks hold the wanted position of any replicate;
    only the values of these blocks are read again and ordered. Replicates without a draw drop out.
    """
    keys, w = list(keys), Packed("_w", len(numbers))
    rows = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), *w.of(F.col(times))).withColumn(BLOCK, value_block(F.col("_v"), blocks_per_octave(values)))
    held = rows.groupBy(*keys, BLOCK).agg(*w.sums())
    along = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    placed = held.select(*keys, BLOCK, *w.columns, *w.over(along, "_off"), *w.over(Window.partitionBy(*keys), "_all"))
    holds = F.exists(_holding(w.lanes("_off"), w.lanes(), w.lanes("_all"), q), lambda s: s.isNotNull())
    chosen = materialize(placed.where(holds).drop(*w.columns), "blocks", inferred=False)  # a few rows for each group
    cells = rows.join(chosen.select(*keys, BLOCK), [*keys, BLOCK], "left_semi").groupBy(*keys, BLOCK, "_v").agg(*w.sums())
    before = Window.partitionBy(*keys, BLOCK).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ordered = cells.select(*keys, BLOCK, "_v", *w.columns, *w.over(before, "_in")).join(chosen, [*keys, BLOCK])
    begin = F.zip_with(w.lanes("_off"), w.lanes("_in"), lambda a, b: a + b)
    hits = ordered.select(*keys, "_v", _replicate_rows(_holding(begin, w.lanes(), w.lanes("_all"), q), numbers).alias("r"))
    return materialize(hits.groupBy(*keys, F.col("r.replicate").alias("replicate")).agg(*_between(keys, out)), "quantiles", inferred=False)


def replicated_rank_effects(rows: DataFrame, keys: Sequence[str], arm: str, value: str, times: str, numbers: Sequence[int]) -> DataFrame:
    """(keys, replicate, effect, median_t, median_n): signed U effect of arm t against arm n and both medians.

    Equal values are one cell; running totals along the cells are packed like the cells. Replicates
    that lack an arm drop out.
    """
    keys, count = list(keys), len(numbers)
    t, n = Packed("_t", count), Packed("_n", count)
    none = F.array().cast("array<int>")
    is_t = F.col(arm) == "t"
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), *t.of(F.when(is_t, F.col(times)).otherwise(none)), *n.of(F.when(is_t, none).otherwise(F.col(times))))
    cells = rows.groupBy(*keys, "_v").agg(*t.sums(), *n.sums()).withColumn(BLOCK, value_block(F.col("_v"), blocks_per_octave(rows)))
    along = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = cells.groupBy(*keys, BLOCK).agg(*t.sums(), *n.sums()).select(*keys, BLOCK, *[c for p in (t, n) for c in (*p.over(along, "_off"), *p.over(whole, "_all"))])
    before = Window.partitionBy(*keys, BLOCK).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inner = cells.select(*keys, BLOCK, "_v", *t.columns, *n.columns, *t.over(before, "_in"), *n.over(before, "_in")).join(placed, [*keys, BLOCK])

    def begin(p: Packed) -> Column:
        return F.zip_with(p.lanes("_off"), p.lanes("_in"), lambda a, b: a + b)

    ordered = materialize(inner.select(*keys, "_v", *[c for p in (t, n) for c in (p.lanes().alias(p.name), begin(p).alias(f"{p.name}_begin"), p.lanes("_all").alias(f"{p.name}_total"))]), "cells", inferred=False)
    # what a cell adds to the rank sum of arm t: its draws there, each at the middle rank of the cell
    size = F.zip_with("_t", "_n", lambda a, b: (a + b + 1) / F.lit(2.0))
    middle = F.zip_with(F.zip_with("_t_begin", "_n_begin", lambda a, b: a + b), size, lambda a, b: a + b)
    summed = ordered.withColumn("_rank", F.zip_with("_t", middle, lambda a, b: a * b)).groupBy(*keys).agg(
        F.array(*[F.sum(F.get("_rank", F.lit(i))) for i in range(count)]).alias("_rank"), F.first("_t_total").alias("_t"), F.first("_n_total").alias("_n"))

    def effect(r: Column, sizes: Column) -> Column:
        a, b = sizes["a"].cast("double"), sizes["b"]
        return F.when((sizes["a"] > 0) & (b > 0), (r - a * (a + 1.0) / 2.0) * 2.0 / (a * b) - 1.0)

    effects = summed.select(*keys, _replicate_rows(F.zip_with("_rank", F.zip_with("_t", "_n", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), effect), numbers).alias("r")).select(
        *keys, F.col("r.replicate").alias("replicate"), F.col("r.s").alias("effect"))
    out = effects
    for p in (t, n):
        hits = ordered.select(*keys, "_v", _replicate_rows(_holding(F.col(f"{p.name}_begin"), F.col(p.name), F.col(f"{p.name}_total"), 0.5), numbers).alias("r"))
        out = out.join(hits.groupBy(*keys, F.col("r.replicate").alias("replicate")).agg(*_between(keys, f"median{p.name}")), [*keys, "replicate"])
    return materialize(out, "effects", inferred=False)
