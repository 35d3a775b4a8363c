"""Session helpers: table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[str] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def skip_empty(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for mapInPandas without its empty frames: their text columns have no Arrow type to go by."""

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (frame for frame in run(batches) if len(frame))

    return filled


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session without that setting gets a folder of its own; on a cluster
    the setting is required, because a machine-local folder would be lost with its host.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a reliable cut of the lineage.

    Unlike ``localCheckpoint`` it survives the loss of executors; unlike ``checkpoint``
    the files are columnar and compressed, and later reads prune columns and partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if partition_by:
        keep = [c for c in df.columns if c not in partition_by]
        return spark.read.parquet(path).select(*keep, *partition_by)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, as a bigint column ``name``, without putting all of them into one task.

    Rows are ranged and sorted once and written, so that places and counts are of the same
    parts; only one count for each part is gathered.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part").agg((F.max("_id") - F.shiftleft("_part", 33) + 1).alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_before")


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of ``counts`` with the largest ``n`` (positive), at most ``most`` of them; rows of nearly equal ``n`` come all or not at all.

    A histogram of about a thousand classes of ``n`` says from which on they are few enough, so
    executors send that many at most, where ordering and limiting would send so many from each partition.
    """
    size = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    classes = sorted(((r.size, r["count"]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)
    total, least = 0, None
    for at, count in classes:
        total += count
        if total > most:
            break
        least = at
    return counts.where(size >= least) if least is not None else counts.limit(0)


def release(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote in this process; its frames can't be read afterwards."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
