"""Operators on ordered lists: numbering, first-seen, caps, carrying forward, gaps.  Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


#: Rows that one task is given of one group; a larger table is cut into segments of about this size.
SEGMENT = 1_000_000


def segmented(df: DataFrame, by: list[str], order: list[str | Column], rows: int = SEGMENT) -> tuple[DataFrame, bool]:
    """df with _seg: consecutive stretches of each group in its order, of bounded size whatever the size of the group.

    A window over (by, _seg) then works on one stretch, and what it needs of the stretches before comes from a table of
    one row for each stretch.  A table that is one stretch is not moved; whether it was cut is the second result.  Rows
    equal in by and order share a stretch.
    """
    parts = -(-df.count() // rows)
    if parts <= 1:
        return df.withColumn("_seg", F.lit(0)), False
    return checkpointed(df.repartitionByRange(parts, *by, *order)).withColumn("_seg", F.spark_partition_id()), True


def _with_before(df: DataFrame, is_cut: bool, by: list[str], value: Column, fold, reverse: bool = False) -> DataFrame:
    """df with _before: fold (an aggregate) of the values of the stretches before (after, if reverse) the row's own; NULL if none."""
    if not is_cut:
        return df.withColumn("_before", F.lit(None))
    order = F.col("_seg").desc() if reverse else F.col("_seg").asc()
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    each = df.groupBy(*by, "_seg").agg(value.alias("_v")).withColumn("_before", fold(F.col("_v")).over(w)).drop("_v")
    keys = [*by, "_seg"]
    each = each.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], "_before")
    match = F.lit(True)
    for k, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return df.join(each, match).select(*df.columns, "_before")


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "ord", rows: int = SEGMENT) -> DataFrame:
    """A dense 0-based number in each group; a group that holds most rows is numbered by many tasks."""
    cut = _with_before(*segmented(df, by, order, rows), by, F.count("*"), F.sum)
    n = F.row_number().over(Window.partitionBy(*by, "_seg").orderBy(*order)) - 1
    return cut.withColumn(name, (n + F.coalesce(F.col("_before").cast("bigint"), F.lit(0))).cast("bigint")).drop("_seg", "_before")


def first_seen(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the first by order; keeps the order, unlike dropDuplicates().

    Done as a grouped minimum, which combines map-side, so a key that a third of the rows share is no problem.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [(o if isinstance(o, Column) else F.col(o)).alias(f"_o{k}") for k, o in enumerate(order)]
    rank = F.struct(*first, *rest)
    least = df.groupBy(*keys).agg(F.min(rank).alias("_m"))
    return least.select(*[F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in df.columns])


def capped(df: DataFrame, by: list[str], order: list[str | Column], cap: int) -> DataFrame:
    """The first cap rows of each group, with truncated: whether the group had more.

    One row more than the cap tells that, so each task keeps only cap + 1 rows of a group (a window group limit).
    """
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= cap + 1)
    return ranked.withColumn("truncated", F.max("_n").over(w) > cap).where(F.col("_n") <= cap).drop("_n")


def attempt_and_saved(df: DataFrame, by: list[str], order: list[str | Column], ok: Column, rows: int = SEGMENT) -> DataFrame:
    """attempt: 0-based number of every row; saved: dense number of the rows that are ok, NULL for others."""
    out = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    cut, is_cut = segmented(out, by, order, rows)
    w = Window.partitionBy(*by, "_seg").orderBy(*order)
    cut = _with_before(cut, is_cut, by, F.count("*"), F.sum).withColumn("attempt", (F.row_number().over(w) - 1 + F.coalesce(F.col("_before").cast("bigint"), F.lit(0))).cast("bigint")).drop("_before")
    own = F.sum(F.col("_ok").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cut = _with_before(cut, is_cut, by, F.count_if("_ok"), F.sum).withColumn("_s", own + F.coalesce(F.col("_before").cast("bigint"), F.lit(0)))
    return cut.withColumn("saved", F.when(F.col("_ok"), F.col("_s") - 1)).drop("_ok", "_s", "_seg", "_before")


def carried_forward(df: DataFrame, by: list[str], order: str, is_leaf: Column, is_staged: Column, title: str, rows: int = SEGMENT) -> DataFrame:
    """For each staged leaf the titles of the branches before it that no earlier staged leaf took: (by..., order, headings).

    Titles survive leaves that were lost; those after the last staged leaf vanish.
    """
    out = df.withColumn("_leaf", is_leaf).withColumn("_staged", is_leaf & is_staged)
    w = Window.partitionBy(*by, "_seg").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = _with_before(*segmented(out, by, [order], rows), by, F.count_if("_staged"), F.sum, reverse=True)
    group = cut.withColumn("_g", F.sum(F.col("_staged").cast("bigint")).over(w) + F.coalesce(F.col("_before").cast("bigint"), F.lit(0)))
    kept = group.where((F.col("_g") > 0) & (F.col("_staged") | ~F.col("_leaf")))
    heads = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_leaf"), F.struct(F.col(order).alias("o"), F.col(title).alias("t"))))), lambda x: x["t"])
    return kept.groupBy(*by, "_g").agg(F.max(F.when(F.col("_staged"), F.col(order))).alias(order), heads.alias("headings")).drop("_g")


def idle_gaps(df: DataFrame, by: list[str], at: str, tie: str, seconds: int, rows: int = SEGMENT) -> DataFrame:
    """Rows that came more than seconds after the row before them, with gap_s; 0 turns the check off."""
    if seconds < 0:
        raise ValueError("the window can't be negative")
    cut = _with_before(*segmented(df, by, [at, tie], rows), by, F.max(at), F.max)
    earlier = F.coalesce(F.lag(at).over(Window.partitionBy(*by, "_seg").orderBy(at, tie)), F.col("_before").cast(df.schema[at].dataType))
    gap = F.floor((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000)
    out = cut.withColumn("gap_s", gap).drop("_seg", "_before")
    return out.where(F.lit(seconds > 0) & (F.col("gap_s") > seconds))


def take_while(df: DataFrame, by: list[str], number: str, good: Column) -> DataFrame:
    """The rows of each group before its first row that is not good."""
    stop = df.where(~F.coalesce(good, F.lit(False))).groupBy(*by).agg(F.min(number).alias("_stop"))
    return df.join(stop, by, "left").where(F.col("_stop").isNull() | (F.col(number) < F.col("_stop"))).drop("_stop")
