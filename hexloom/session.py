"""Session helpers shared by every operator: code shipping, shared storage and small conf-independent utilities."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows (of a few numbers each) that a file of a staged table holds at least, if its size is known beforehand.
FILE_ROWS = 20_000

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Functions of mapInArrow are pickled by reference, so each Python worker has to be able to import the package.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="hexloom-")
    archive = os.path.join(folder, "hexloom_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="hexloom-shared-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, partition_by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor loses nothing of it.

    rows: how many rows it has at most, where that is known. A small table is then written in few files, instead of
    one for each shuffle partition; the number of files follows the rows, and large tables keep all partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        files = max(parallelism(spark), -(-rows // FILE_ROWS))
        if files < shuffle_partitions(spark):
            df = df.coalesce(files)
    path = f"{shared_dir(spark)}/hexloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have release_staged() delete a folder, too."""
    _written.append((spark, path))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release_staged() -> None:
    """Delete what stage() has written; results that still read it must be saved before."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
