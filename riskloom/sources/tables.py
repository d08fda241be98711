"""Readers of rows and the frames that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_blank_separated(spark: SparkSession, path: str, names: list[str], codes: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Lines of values parted by blanks, with column names and, for some columns, a label for each code (others stay)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])
    for name, labels in (codes or {}).items():
        known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        rows = rows.withColumn(name, F.coalesce(F.try_element_at(known, F.col(name)), F.col(name)))
    return rows


def with_random_dates(df: DataFrame, name: str = "origination_dt", first: str = "2018-01-01", last: str = "2022-12-31", seed: int = 0) -> DataFrame:
    """Adds dates drawn uniformly between two days."""
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date"))
    return df.withColumn(name, F.date_add(F.lit(first).cast("date"), F.floor(F.rand(seed) * (days + 1)).cast("int")))


#: A binary-target frame of lineitem; the same text runs in Spark and in DuckDB.
MODEL_FRAME = """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_returnflag = 'R' AS INT) AS y,
    CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, NULLIF(CAST(l_discount AS DOUBLE), CAST(0 AS DOUBLE)) AS d_miss, CAST(l_tax AS DOUBLE) AS x,
    CAST(l_extendedprice AS DOUBLE) / CAST(1000 AS DOUBLE) AS price, l_linestatus AS seg, CAST(1 + l_linenumber % 3 AS DOUBLE) AS w, l_shipdate AS t,
    ROUND(CAST(l_quantity AS DOUBLE) / CAST(51 AS DOUBLE), 6) AS s, ROUND((CAST(l_quantity AS DOUBLE) + CAST(l_tax AS DOUBLE) * CAST(100 AS DOUBLE)) / CAST(61 AS DOUBLE), 6) AS sb
FROM lineitem"""
TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MODEL_FRAME.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
