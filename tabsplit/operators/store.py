"""The shared store: typed reading of string tables, keyed upserts, and the state changes of a bill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The host of workbooks and how a link names one; rows that a bounded read of a tab gives, with its header.
HOST, WORKBOOK = "docs.google.com", r"/spreadsheets/d/([A-Za-z0-9_-]+)"
#: The only tab of a workbook that nobody has used, and the tab that tells a store.
FRESH, META = "Sheet1", "META"
BOUNDS = {"meta": 20, "users": 1000, "items": 1000, "claims": 5000}


def coerce_items(rows: DataFrame) -> DataFrame:
    """Item rows with an id; names default, numbers default to 0."""
    named = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("Unnamed item"))
    cells = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("quantity", "unit_price", "total_price")}
    return rows.where(F.coalesce("item_id", F.lit("")) != "").withColumn("name", named).withColumns(cells)


def filter_users(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("user_id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))


def first_meta(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in row order."""
    return rows.groupBy(*keys).agg(F.min_by("value", "row_no").alias("value"))


def lenient_discount(kind: Column, value: Column) -> Column:
    amount = value.try_cast("double")
    return F.when(kind.isin("amount", "percent") & (amount > 0), F.struct(kind.alias("type"), amount.alias("value")))


def lenient_amount(value: Column) -> Column:
    amount = value.try_cast("double")
    return F.when(amount >= 0, amount)


def strict_discount(kind: Column, value: Column) -> Column:
    """status ok, none or error, with type and value: errors are told, not dropped."""
    blank = (F.coalesce(kind, F.lit("")) == "") & (F.coalesce(value, F.lit("")) == "")
    amount = value.try_cast("double")
    bad = ~F.coalesce(kind.isin("amount", "percent"), F.lit(False)) | amount.isNull() | (amount < 0) | ((kind == "percent") & (amount > 100))
    status = F.when(blank, "none").when(bad, "error").when(amount == 0, "none").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", kind).alias("type"), F.when(status == "ok", amount).alias("value"))


def upsert(existing: DataFrame, wanted: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """The store after an upsert, with what was done to each row: kept (not asked for), same, update or append.

    Of existing rows with one key the last counts; rows are never deleted.
    """
    last = existing.groupBy(*keys).agg(F.max_by(F.struct(*cells), "row_no").alias("old"))
    new = wanted.select(*keys, F.struct(*cells).alias("new"))
    joined = last.join(new, keys, "full")
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "append").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return joined.select(*keys, action.alias("action"), F.coalesce("new", "old").alias("row")).select(*keys, "action", "row.*")


def explode_claims(claims: DataFrame) -> DataFrame:
    """Claim rows as stored: shared names with quantity 0, and individual quantities."""
    shared = claims.where("mode = 'shared' AND named").select("bill_id", "item_id", "user_id", F.lit("0").alias("quantity"), "mode")
    return shared.union(claims.where("mode = 'individual'").select("bill_id", "item_id", "user_id", F.col("claimed").cast("string").alias("quantity"), "mode"))


def nest_claims(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Every item with its claims gathered: names of a shared claim and quantities by user, in order; orphans are dropped."""
    rows = items.select("bill_id", "item_id").join(stored, ["bill_id", "item_id"], "left")
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("mode") == "shared", F.col("user_id")))), ",")
    amounts = F.array_join(F.array_sort(F.collect_list(F.when(F.col("mode") == "individual", F.concat("user_id", F.lit("="), "quantity")))), ",")
    return rows.groupBy("bill_id", "item_id").agg(names.alias("shared_with"), amounts.alias("quantities"))


def cascade(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those of deleted keys."""
    return rows.join(gone, keys, "left_anti")


def cap_requested(claims: DataFrame, ask: Column) -> DataFrame:
    """A request cut to what others leave, at least 0."""
    others = F.sum("claimed").over(Window.partitionBy("bill_id", "item_id")) - F.col("claimed")
    return claims.withColumn("granted", F.greatest(F.least(ask, F.col("qty") - others), F.lit(0)))


def join_key(*cells: str) -> Column:
    """Cells as one key, set apart by a character that no cell holds."""
    return F.concat_ws("\0", *(F.col(c).cast("string") for c in cells))


def bounded(rows: DataFrame, key: str, order: str | list[str], bound: int) -> DataFrame:
    """The rows that a read of `bound` rows gives of each key, the first of which is the header."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)))
    return rows.withColumn("_place", place).where(F.col("_place") < bound).drop("_place")


def schema_check(rows: DataFrame, key: str, tab: Column, required: list[str], version: Column) -> DataFrame:
    """Per key whether every required tab is there, and whether a row says the version."""
    have = rows.groupBy(key).agg(F.collect_set(F.when(tab.isin(*required), tab)).alias("_have"), F.bool_or(version).alias("versioned"))
    return have.select(key, (F.size("_have") == len(required)).alias("complete"), "versioned")


def init_action(tabs: Column, versioned: Column, filled: Column) -> Column:
    """ready for a store of our version, create for a fresh workbook, whose one tab has its first name and no filled cell, and
    refuse for any other: content that is there is never replaced."""
    fresh = (F.size(tabs) == 1) & (F.get(tabs, F.lit(0)) == FRESH) & ~filled
    return F.when(F.array_contains(tabs, META), F.when(versioned, "ready").otherwise("refuse")).when(fresh, "create").otherwise("refuse")


def workbook_id(url: Column) -> Column:
    """The id of the workbook that a link names, if it is a link to the trusted host, whatever its port, case and blanks around."""
    link = rf"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?i:{HOST.replace('.', '[.]')})(?::[0-9]*)?{WORKBOOK}"
    found = F.regexp_extract(url, link, 1)
    return F.when(found != "", found)


def bounded_tabs(tabs: dict[str, DataFrame], key: str, bounds: dict[str, int]) -> dict[str, DataFrame]:
    """The rows of every tab that a bounded read of each gives."""
    return {name: bounded(rows, key, "row_no", bounds[name]) for name, rows in tabs.items()}
