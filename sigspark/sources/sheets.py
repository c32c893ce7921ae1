"""Ad-hoc datasets and sheet-like export and import."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.money import to_cents, to_yuan_text


def dataset_from_sql(spark: SparkSession, sql: str) -> tuple[DataFrame, list[str]]:
    """Dataset and its dimension names."""
    df = spark.sql(sql)
    return df, df.columns


def _mapped(c: Column, pairs: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.get(F.array(table[c.cast("string")]), F.lit(0))


def to_sheet(df: DataFrame, labels: Mapping[str, Mapping[str, str]], money: Sequence[str]) -> DataFrame:
    """Codes to labels and cents to a two-decimal text, column by column."""
    out = df
    for c, pairs in labels.items():
        out = out.withColumn(c, _mapped(F.col(c), pairs))
    for c in money:
        out = out.withColumn(c, to_yuan_text(F.col(c)))
    return out


def from_sheet(df: DataFrame, labels: Mapping[str, Mapping[str, str]], money: Sequence[str]) -> DataFrame:
    out = df
    for c, pairs in labels.items():
        out = out.withColumn(c, _mapped(F.col(c), {v: k for k, v in pairs.items()}))
    for c in money:
        out = out.withColumn(c, to_cents(F.col(c).cast("double")))
    return out


def export_table(df: DataFrame, path: str, labels: Mapping[str, Mapping[str, str]], money: Sequence[str]) -> None:
    to_sheet(df, labels, money).write.mode("overwrite").option("header", True).csv(path)


def import_table(
    spark: SparkSession, path: str, schema: str, labels: Mapping[str, Mapping[str, str]], money: Sequence[str],
) -> DataFrame:
    return from_sheet(spark.read.option("header", True).schema(schema).csv(path), labels, money)
