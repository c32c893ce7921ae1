"""Session settings and the few cluster knobs the library reads."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()                                     # applications whose workers have the package
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",     # call sites of every Column are slow to collect
}


def local_session(cpus: str | int = "*", app: str = "sigspark", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else one beside the tables of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_sigspark"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that jobs run from any working folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root, buffer = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.writestr(os.path.relpath(path, os.path.dirname(root)), open(path).read())
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{fresh_dir(spark, 'code')}/sigspark.zip")
    stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    stream.write(buffer.getvalue())
    stream.close()
    sc.addPyFile(at.toString())
    _SHIPPED.add(sc.applicationId)


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The rows written to the shared folder, a folder for each value of ``by``, and read again: cuts the lineage and survives
    lost executors."""
    path = fresh_dir(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
