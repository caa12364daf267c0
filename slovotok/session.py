"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the cluster names, else (local mode only) a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="slovotok-ckpt-")
    sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of strings that a side may hold to be broadcast after its size has been measured.
BROADCAST_BYTES = 32 << 20


def small_enough(df: DataFrame, column: str, bytes_most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a materialised table may be broadcast: measured, not estimated."""
    from pyspark.sql import functions as F

    held = df.agg(F.coalesce(F.sum(F.octet_length(F.col(column)) + 64), F.lit(0)).alias("b")).first()["b"]
    return held <= bytes_most


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once an application, so that they need not have it installed."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="slovotok-ship-")) / "slovotok.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def shipped(f):
    """The query, with the package shipped before it is built."""
    from functools import wraps

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
