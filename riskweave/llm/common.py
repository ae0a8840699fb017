"""What the operators share: the word rule, tables, frozen intermediates, spread joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import checkpoint_root

#: A word is a longest run of characters that are none of these (tab to carriage return, space).
BLANKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for a null."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+")
    return F.filter(parts, lambda w: w != "")


def freeze(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that all executors share."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(wanted: str, columns: list[str]) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def spread_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join on a key that may hold a third of all left rows; nulls match nulls.

    The left rows of a key go to ``salts`` tasks and each right row is repeated as often, so that
    no task holds a key alone. The right side has one row a key.
    """
    names = [*left.columns, *right.columns]
    salt, known, other = (free_name(x, names) for x in ("salt", "known", "known_right"))
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    dealt = dealt.withColumn(known, F.col(key).isNotNull())
    held = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = held.withColumnRenamed(key, other)
    on = (dealt[salt] == held[salt]) & dealt[key].eqNullSafe(held[other])
    return dealt.join(held, on, "left").drop(held[salt]).drop(salt, known, other)


#: A database in the shared folder for tables between the steps of an operator.
SCRATCH = "llm_scratch"


def stored(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Written as a Parquet table in the shared folder and read back: compact, lineage cut.

    With ``bucket`` the table is bucketed by that column.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH} LOCATION '{checkpoint_root(spark)}/{SCRATCH}'")
    table_name = f"{SCRATCH}.{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd")
    if bucket:
        writer = writer.bucketBy(partitions(spark), bucket)
    writer.saveAsTable(table_name)
    return spark.table(table_name)


def scratch_tables(spark: SparkSession) -> set[str]:
    """The tables that :func:`stored` has made in this session."""
    if not spark.catalog.databaseExists(SCRATCH):
        return set()
    return {t.name for t in spark.catalog.listTables(SCRATCH) if not t.isTemporary}


def release(spark: SparkSession, names: set[str]) -> None:
    """Drops such tables, when the results that need them have been written."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {SCRATCH}.{name}")


def once(name: str, value: Column) -> Column:
    """A value that later expressions read as a column, so that it is not worked out again."""
    return F.explode(F.array(value)).alias(name)
