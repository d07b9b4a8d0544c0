"""Test tables with known defects: every n-th row is bad in a known way.

Each generator takes a DataFrame of row numbers (``id``), by default a range, so a
table of any size is made in parallel.  Values that do not matter come from a hash
of the row number, and are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The lists that rules on generated tables name.
DEPARTMENTS = ("HR", "Finance", "Engineering")
GENDERS = ("Male", "Female", "Other")
CATEGORIES = ("Electronics", "Clothing", "Books", "Furniture")
# Own values; no count depends on them.
CITIES = ("Alder", "Birch", "Cedar", "Elm", "Hazel")
COUNTRIES = ("Northland", "Southland", "Westland")
EPOCH = "2026-07-01 00:00:00"


def numbers(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(1, count + 1)


def _every(n: int) -> Column:
    return F.col("id") % n == 0


def _draw(salt: str, n: int) -> Column:
    """A number from 0 to n - 1, fixed by the row number."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))


def _pick(salt: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_draw(salt, len(values)) + 1).cast("int"))


def _money(column: Column) -> Column:
    return column.cast("decimal(10,2)")


def _recent(salt: str) -> Column:
    """Within the thirty days before the fixed epoch."""
    seconds = _draw(salt, 30 * 86400).cast("int")
    return F.lit(EPOCH).cast("timestamp_ntz") - F.make_dt_interval(secs=seconds)


def _id() -> Column:
    return F.when(_every(10000), F.lit(1)).otherwise(F.col("id")).cast("int")


def _named(prefix: str) -> Column:
    return F.when(~_every(5000), F.concat(F.lit(prefix), F.col("id")))


def _email(domain: str, n: int, prefix: str = "user", bad: str = "bademail.com") -> Column:
    good = F.concat(F.lit(prefix), F.col("id"), F.lit(f"@{domain}"))
    return F.when(_every(n), F.lit(bad)).otherwise(good)


def employees(ids: DataFrame) -> DataFrame:
    salary = F.lit(65000) + _draw("salary", 3_500_000) / 100
    return ids.select(
        _id().alias("id"),
        _named("Employee_").alias("name"),
        F.when(_every(8000), 15).when(_every(9000), 70).otherwise(18 + _draw("age", 48)).cast("int").alias("age"),
        _email("test.com", 7000).alias("email"),
        F.when(_every(6000), "Gaming").otherwise(_pick("dept", DEPARTMENTS)).alias("department"),
        _money(F.when(_every(3000), F.lit(200000)).otherwise(salary)).alias("salary"),
        _pick("label", ("A", "B")).alias("label"),
        _recent("created").alias("created_at"),
        (F.col("id") + 100).cast("int").alias("user_id"),
        F.when(_every(4000), -10).otherwise(50 + _draw("score", 51)).cast("int").alias("score"),
        F.lit("US").alias("country"),
    )


def customers(ids: DataFrame) -> DataFrame:
    return ids.select(
        _id().alias("customer_id"),
        _named("Customer_").alias("customer_name"),
        _email("test.com", 7000).alias("email"),
        F.concat(F.lit("555"), F.lpad((F.col("id") % 99999).cast("string"), 5, "0")).alias("phone"),
        F.when(_every(8000), 15).when(_every(9000), 110).otherwise(18 + _draw("age", 83)).cast("int").alias("age"),
        F.when(_every(6000), "Unknown").otherwise(_pick("gender", GENDERS)).alias("gender"),
        _pick("city", CITIES).alias("city"),
        _pick("country", COUNTRIES).alias("country"),
        F.when(_every(3000), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .otherwise(_recent("created")).alias("created_at"),
    )


def products(ids: DataFrame) -> DataFrame:
    price = F.round(F.lit(10) + _draw("price", 500_000) / 100, 2)
    return ids.select(
        _id().alias("product_id"),
        _named("Product_").alias("product_name"),
        F.when(_every(6000), "Gaming").otherwise(_pick("category", CATEGORIES)).alias("category"),
        _money(F.when(_every(7000), F.lit(-100)).when(_every(9000), F.lit(200000)).otherwise(price)).alias("price"),
        F.when(_every(8000), -5).otherwise(F.floor(_draw("stock", 1000))).cast("int").alias("stock"),
        _email("company.com", 7500, "supplier", "supplier.com").alias("supplier_email"),
    )
