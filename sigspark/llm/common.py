"""What the operators of this subpackage share: Arrow row maps, stored tables, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.session import fresh_dir

Step = Callable[..., Sequence[pa.Array]]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = fresh_dir(df.sparkSession, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def present(text: Column | str) -> Column:
    """A text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % divisor


def carried(df: DataFrame, carry: Iterable[str] | None, made: Sequence[T.StructField]) -> list[str]:
    """Columns to keep; a made column replaces one of the same name, whatever its case."""
    names = {f.name.lower() for f in made}
    return [c for c in (df.columns if carry is None else carry) if c.lower() not in names]


def arrow_map(
    df: DataFrame, inputs: Sequence[Column], made: Sequence[T.StructField], make: Callable[[], Step],
    carry: Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with new columns computed batch by batch.

    ``make()`` runs once per task and returns a step from the input arrays to the new arrays. Carried columns
    stay in Arrow. Rows, their order and their number do not change.
    """
    keep = carried(df, carry, made)
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    fields = [source.schema.fields[i] for i in range(len(keep))] + list(made)
    n, names = len(keep), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *step(*batch.columns[n:])], names=names)

    return source.mapInArrow(run, T.StructType(fields))


KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(),
}


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(KINDS[kind[1:]]) if kind[0] == "*" else KINDS[kind], True)


def words(data: bytes) -> list[bytes]:
    """Runs of bytes other than space and the five ASCII controls from tab to carriage return."""
    return data.split()


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """Left join on ``on`` (one row of ``right`` per value) with each value of ``left`` dealt to ``salts`` tasks."""
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [on, "__salt"], "left").drop("__salt")
