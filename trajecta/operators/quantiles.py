"""Exact quantiles of groups of any size by refined bucket counts.

Groups of at most `exact_rows` rows are aggregated as they are. Of a larger one only counts are
kept: each pass deals the rows between two bounds to buckets by a monotone function of the value,
finds the bucket that the wanted rank falls into, and goes on between its least and its greatest
value, until few rows are left or all are equal. A pass keeps `buckets` + 1 rows a wanted rank,
however many distinct values there are, and its partial counts are made before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.lineage import cut

#: rows of a group up to which its values are aggregated in one buffer
EXACT_ROWS = 200_000
#: rows of bounds (about 100 bytes each) up to which they are broadcast; beyond, rows of the large groups are dealt over SALTS tasks a group
BROADCAST_ROWS = 50_000
SALTS = 64
#: more passes than doubles can ask for: one by magnitude, then 52 bits by 12 a pass
MAX_PASSES = 12


@dataclass(frozen=True)
class Quantile:
    """The value at a share of the sorted non-null values: between two neighbours by their distance, or (lower) the first that reaches the share."""

    column: str
    share: float
    lower: bool = False

    def aggregate(self) -> Column:
        if self.lower:
            return F.expr(f"percentile_disc({self.share!r}) within group (order by `{self.column}`)")
        return F.percentile(self.column, F.lit(self.share))

    def ranks(self, n: Column) -> list[Column]:
        """Ranks from 0 of the values that it needs."""
        if self.lower:
            return [F.greatest(F.ceil(n * F.lit(self.share)) - 1, F.lit(0)).cast("long")]
        at = (n - 1) * F.lit(self.share)
        return [F.floor(at).cast("long"), F.ceil(at).cast("long")]

    def value(self, n: Column, values: list[Column]) -> Column:
        if self.lower:
            return values[0]
        at = (n - 1) * F.lit(self.share)
        below, above = values
        return F.when(F.floor(at) == F.ceil(at), below).otherwise((F.ceil(at) - at) * below + (at - F.floor(at)) * above)


def _magnitude(x: Column) -> Column:
    """Rises with x over all doubles: signed binary logarithm; infinite values lie beyond all others, nan beyond them."""
    size = F.log2(F.abs(x)) + 1100
    return F.when(F.isnan(x), 4400.0).when(F.abs(x) == float("inf"), F.signum(x) * 2200.0).when(x == 0, 0.0).otherwise(F.signum(x) * size)


def _bucket(x: Column, low: Column, high: Column, buckets: int) -> Column:
    """Even buckets between the bounds; by magnitude where the bounds lie far apart."""
    near = (low > 0) & (high < low * 4) | (high < 0) & (low > high * 4)
    share = F.when(near, (x - low) / (high - low)).otherwise((_magnitude(x) - _magnitude(low)) / (_magnitude(high) - _magnitude(low)))
    return F.floor(share * buckets).cast("int")


def same_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables of groups on all of `by`; null is a group like others."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in by])


def meet_groups(rows: DataFrame, bounds: DataFrame, keys: list[str], n_bounds: int, how: str = "inner") -> DataFrame:
    """rows with the columns of bounds, a table of n_bounds rows by group; nulls are a group like others, and a large group is spread over tasks."""
    salted = how == "inner" and n_bounds > BROADCAST_ROWS
    if salted:
        rows = rows.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
        bounds = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    elif n_bounds <= BROADCAST_ROWS:
        bounds = F.broadcast(bounds)
    return same_groups(rows, bounds, [*keys, "_salt"] if salted else keys, how).drop("_salt")


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, Quantile], exact_rows: int = EXACT_ROWS, buckets: int = 4096) -> DataFrame:
    """(by, *wanted): a row a group, null where a group has no values. Nulls are not counted; nan is the greatest value, as in sorting."""
    columns = sorted({q.column for q in wanted.values()})
    counts = [F.count(c).alias(f"_n_{i}") for i, c in enumerate(columns)]
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *counts).where(F.col("_n") > exact_rows)
    large = cut(large) if by else large
    n_large = large.count()
    plain = [q.aggregate().alias(name) for name, q in wanted.items()]
    if not n_large:
        return df.groupBy(*by).agg(*plain)
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_x")).select(*by, "_x.*").where("_v is not null")
    rows = meet_groups(rows, large.select(*by), by, n_large) if by else rows
    found = _select(rows, [*by, "_c"], {name: (columns.index(q.column), q) for name, q in wanted.items()}, exact_rows, buckets)
    if not by:
        return found
    found = same_groups(large.select(*by), found, by, "left")
    small = meet_groups(df, large.select(*by), by, n_large, "left_anti")
    return small.groupBy(*by).agg(*plain).unionByName(found)


def _select(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[int, Quantile]], few: int, buckets: int) -> DataFrame:
    """Quantiles of rows(keys, _v), all of large groups: (keys but the last, *wanted)."""
    by = keys[:-1]
    stats = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    asked = [F.struct(F.lit(name).alias("_name"), F.lit(w).alias("_which"), k.alias("_rank"), F.lit(c).alias("_for")) for name, (c, q) in wanted.items() for w, k in enumerate(q.ranks(F.col("_n")))]
    goals = stats.select(*keys, "_n", "_low", "_high", F.explode(F.array(*asked)).alias("_g")).select(*keys, "_n", "_low", "_high", "_g.*").where("_for = _c").drop("_for")
    goals = cut(goals.withColumns({"_below": F.lit(0).cast("long"), "_inside": F.col("_n")}))
    open_ = (F.col("_low") < F.col("_high")) & (F.col("_inside") > few)
    carried = [c for c in goals.columns if c not in ("_low", "_high", "_below", "_inside")]
    for _ in range(MAX_PASSES):
        n_open = goals.where(open_).count()
        if not n_open:
            break
        met = meet_groups(rows, goals.where(open_), keys, n_open).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        bucket = _bucket(F.col("_v"), F.col("_low"), F.col("_high"), buckets)
        dealt = met.groupBy(*carried, "_below", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = Window.partitionBy(*carried).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        placed = dealt.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_inside").over(before), F.lit(0)))
        chosen = placed.where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_inside"))).select(*goals.columns)
        goals = cut(goals.where(~open_).unionByName(chosen))
    n_goals = goals.count()
    last = meet_groups(rows, goals.where("_low < _high"), keys, n_goals).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    last = last.groupBy(*carried, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    last = last.select(*by, "_n", "_name", "_which", F.element_at("_all", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_value"))
    values = goals.where("not _low < _high").select(*by, "_n", "_name", "_which", F.col("_low").alias("_value")).unionByName(last)
    out = []
    for name, (_, q) in wanted.items():
        mine = F.col("_name") == name
        parts = [F.max(F.when(mine & (F.col("_which") == w), F.col("_value"))) for w in range(1 if q.lower else 2)]
        out.append(q.value(F.max(F.when(mine, F.col("_n"))), parts).alias(name))
    return values.groupBy(*by).agg(*out)
