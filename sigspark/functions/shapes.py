"""Names, list cells, JSON, schema and array helpers."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thing-model types and the column types they are stored as.
THING_TYPES = {
    "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "enum": T.IntegerType(),
    "bool": T.BooleanType(), "text": T.StringType(), "date": T.TimestampType(), "struct": T.StringType(), "array": T.StringType(),
}


def to_snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def rename_all(df: DataFrame, rule) -> DataFrame:
    return df.select(*[F.col(c).alias(rule(c)) for c in df.columns])


def list_cell(c: Column, kind: str = "string") -> Column:
    """Comma-joined cell to array; an empty cell is an empty array."""
    parts = F.when(F.length(c) > 0, F.split(c, ",")).otherwise(F.array().cast("array<string>"))
    return parts if kind == "string" else F.transform(parts, lambda x: x.try_cast(kind))


def join_cell(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


def in_list_cell(value: Column, cell: Column) -> Column:
    return F.array_contains(F.split(cell, ","), value.cast("string"))


def properties(df: DataFrame, params: str, things: DataFrame, keys: list[str]) -> DataFrame:
    """Message properties by identifier, one row each, typed by the thing model; unknown ones drop out.

    ``things`` has ``identifier`` and ``data_type`` (plus ``keys`` that scope it, e.g. the product).
    """
    spread = df.withColumn("__m", F.from_json(params, "map<string,string>")).select(
        *[c for c in df.columns if c != params], F.explode("__m").alias("identifier", "text"))
    typed = spread.join(things, [*keys, "identifier"], "inner")
    number = typed["text"].try_cast("double")
    return typed.withColumn(
        "number", F.when(typed["data_type"].isin("int", "enum"), number.try_cast("int").cast("double"))
        .when(typed["data_type"].isin("float", "double"), number)
    ).withColumn("flag", F.when(typed["data_type"] == "bool", typed["text"].isin("true", "1")))


def thing_schema(fields: Mapping[str, str]) -> T.StructType:
    """Table schema of a product from its property types."""
    return T.StructType([T.StructField(k, THING_TYPES[v]) for k, v in fields.items()])


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two field lists (name, type, length): add, drop, lengthen, retype."""
    both = old.alias("o").join(new.alias("n"), F.col("o.name") == F.col("n.name"), "full_outer")
    change = (
        F.when(F.col("o.name").isNull(), "add").when(F.col("n.name").isNull(), "drop")
        .when(F.col("o.type") != F.col("n.type"), "retype").when(F.col("n.length") > F.col("o.length"), "lengthen")
    )
    return both.select(F.coalesce("o.name", "n.name").alias("name"), change.alias("change")).filter(F.col("change").isNotNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def array_moving_average(c: Column, size: int) -> Column:
    """Means over full windows of an array."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(c) - size + 1, F.lit(1)))
    means = F.transform(starts, lambda i: F.aggregate(F.slice(c, i, size), F.lit(0.0), lambda a, x: a + x) / size)
    return F.when(F.size(c) >= size, means).otherwise(F.array().cast("array<double>"))


def split_text(df: DataFrame, text: str, budget: int) -> DataFrame:
    """Pieces of at most ``budget`` whitespace tokens with their length and token count.

    Whitespace tokens stand in for a model's tokenizer.
    """
    words = F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")
    starts = F.when(F.size("__w") > 0, F.sequence(F.lit(0), F.floor((F.size("__w") - 1) / budget).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda p: F.slice("__w", p * budget + 1, budget))        # each word goes into one piece
    rest = [c for c in df.columns if c != text]
    pieces = df.withColumn("__w", words).select(*rest, F.posexplode(cut).alias("piece", "__p"))
    return pieces.select(*rest, "piece", F.array_join("__p", " ").alias("content"), F.size("__p").alias("tokens")).withColumn("content_length", F.length("content"))
