"""Sources and sinks: panels from the star schema, wide files, guarded CSV and JSON, upserts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corrolla.sources.shared import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_panel(spark: SparkSession, sf_dir: str, unit: str = "week", hours: int = 0) -> DataFrame:
    """(symbol, date, close): mean extended price of each brand and week or month, settled: lineitem is read once. Days may
    begin some hours later."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    day = F.col("l_shipdate") - F.make_dt_interval(hours=F.lit(hours)) if hours else F.col("l_shipdate")
    by = rows.groupBy(F.col("p_brand").alias("symbol"), F.date_trunc(unit, day).cast("date").alias("date"))
    return settled(by.agg(F.avg("l_extendedprice").alias("close")), "panel")


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close): mean order total of each nation and month."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("c_nationkey").cast("string").alias("symbol")
    return rows.groupBy(key, F.date_trunc("month", "o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def read_wide(df: DataFrame, date_col: str = "date") -> DataFrame:
    """A wide frame, one column a symbol, as (date, symbol, close) without missing cells; NaN counts as missing."""
    names = [c for c in df.columns if c != date_col]
    long = df.unpivot([F.col(date_col).alias("date")], [F.col(f"`{c}`").cast("double").alias(c) for c in names], "symbol", "close")
    return long.where(F.col("close").isNotNull() & ~F.isnan("close"))


def to_wide(panel: DataFrame, symbols: list[str]) -> DataFrame:
    """(date, symbol, close) as one column a symbol; the symbols are given, so no pass is needed to find them."""
    return panel.groupBy("date").pivot("symbol", symbols).agg(F.first("close"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; fields that don't parse become null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def good_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where two text columns hold numbers, neither blank nor NaN, as doubles."""
    out = df.select(*[safe_float(F.col(c)).alias(c) for c in (x, y)])
    return out.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def safe_float(c: Column) -> Column:
    """A number, or null where it doesn't parse or is NaN."""
    v = c.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def as_documents(df: DataFrame) -> DataFrame:
    """Each row as JSON; nulls and NaN become null members."""
    return nan_to_null(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def write_rows(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", decimals: int | None = None) -> None:
    """Parquet, CSV (header; doubles to `decimals` places) or JSON lines; mode append adds rows."""
    if decimals is not None:
        df = df.withColumns({n: F.round(n, decimals) for n, t in df.dtypes if t == "double"})
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if kind == "csv" else getattr(writer, kind)(path)


def latest_by_key(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: of all versions of a key the last one; ties go to the row that compares largest, so the result is one row."""
    others = [c for c in rows.columns if c not in (*keys, version)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, *others)).alias("_m"))
    return best.select(*keys, "_m.*").select(rows.columns)


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with the value that a dimension (one row a key) has for their key, or the default."""
    return rows.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def joined_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of either side, once, with the columns of both."""
    return left.join(right, key, "full_outer")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one or more lines each, with a declared schema; members that don't fit it become null."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def enough_rows(counts: DataFrame, least: int = 50) -> DataFrame:
    """symbols with enough observations (symbol, n_obs) to be taken."""
    return counts.where(F.col("n_obs") >= least)


def newest(rows: DataFrame, by: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(by)).limit(n)


def daily_balance(deals: DataFrame, day: str, order: str, amount: str, account: str) -> DataFrame:
    """The running sum of deals at the end of each day, by account."""
    w = Window.partitionBy(account).orderBy(order)
    run = deals.withColumn("_b", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(account, day).agg(F.max_by("_b", order).alias("balance"))
