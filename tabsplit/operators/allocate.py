"""Exact allocation in whole cents: every split adds up to what was split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_even(rows: DataFrame, keys: list[str], total: str, order: str, name: str = "share_cents") -> DataFrame:
    """The total of each group dealt over its rows; the first ones in order get a cent more."""
    group = Window.partitionBy(*keys)
    n, place = F.count("*").over(group), F.row_number().over(group.orderBy(order)) - 1
    dealt = rows.withColumns({"_n": n, "_place": place}).withColumn("_base", F.expr(f"({total} - pmod({total}, _n)) div _n"))
    return dealt.withColumn(name, F.col("_base") + F.when(F.col("_place") < F.col(total) - F.col("_base") * F.col("_n"), 1).otherwise(0)).drop("_n", "_place", "_base")


def cap_quantities(rows: DataFrame, keys: list[str], claimed: str, available: str, order: str, name: str = "capped") -> DataFrame:
    """Claims of an item scaled down to its quantity where they exceed it; the first in order get what rounding leaves."""
    group = Window.partitionBy(*keys)
    known = rows.withColumn("_all", F.sum(claimed).over(group)).withColumn("_place", F.row_number().over(group.orderBy(order)) - 1)
    scaled = known.withColumn("_down", F.when(F.col("_all") > F.col(available), F.expr(f"{claimed} * {available} div _all")).otherwise(F.col(claimed)))
    left = F.when(F.col("_all") > F.col(available), F.col(available) - F.sum("_down").over(group)).otherwise(0)
    return scaled.withColumn("_left", left).withColumn(name, F.col("_down") + F.when(F.col("_place") < F.col("_left"), 1).otherwise(0)).drop("_all", "_place", "_down", "_left")


def distribute(rows: DataFrame, keys: list[str], pool: str, weight: str, total_weight: str, order: str, name: str) -> DataFrame:
    """A pool over the group's rows by weight against a total weight; the last row in order takes what is left.

    Null where there is nothing to distribute. Halves of cents round up.
    """
    group = Window.partitionBy(*keys)
    share = F.expr(f"CASE WHEN {pool} > 0 AND {total_weight} > 0 THEN (2 * {weight} * {pool} + {total_weight}) div (2 * {total_weight}) END")
    dealt = rows.withColumn("_share", share).withColumn("_rest", F.col(pool) - F.sum("_share").over(group)).withColumn("_last", F.max(order).over(group))
    return dealt.withColumn(name, F.col("_share") + F.when(F.col(order) == F.col("_last"), F.col("_rest")).otherwise(0)).drop("_share", "_rest", "_last")


def resolve_discount(kind: str, value: str, subtotal: str) -> Column:
    """Cents of a discount: a percentage, at most 100, of the subtotal, or an amount; nothing unless it is positive."""
    return F.expr(f"CASE WHEN {kind} IS NULL OR {value} IS NULL OR {value} <= 0 THEN 0 WHEN {kind} = 'percent' THEN (2 * least({value}, 100) * {subtotal} + 100) div 200 ELSE {value} END")


def clamp(requested: str, cap: str) -> Column:
    """The request, at most the cap, and the cap at least nothing."""
    return F.least(F.col(requested), F.greatest(F.col(cap), F.lit(0)))
