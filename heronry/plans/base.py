"""Registration of queries and their SQL twins, and the test tables they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, TimestampType

from heronry.functions.calendar import iso

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; local timestamps become instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def both(name: str, sql: str, duck: str | None = None, tables: str = "") -> None:
    """A query that is one SQL statement; `duck` where the dialects differ."""
    names = tables.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    text = duck or sql
    for n in names:
        text = text.replace("{" + n + "}", n)
    query(name, text)(run)


def shown(value: Column, kind: DataType) -> Column:
    """A value as text: arrays joined by |, structs as JSON, instants in ISO form, null as ~."""
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        text = F.array_join(value, "|")
    elif isinstance(kind, (ArrayType, StructType)):
        text = F.to_json(value)
    elif isinstance(kind, TimestampType):
        text = iso(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("~"))
