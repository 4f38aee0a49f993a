"""Session-level helpers: reading tables, cutting lineage, hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate results: ``spark.checkpoint.dir`` of the session. Where the
    setting is missing a temporary folder is made on a local master; on a cluster, whose
    executors don't share the driver's disk, that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gneiss-checkpoint-"))
    return sc.getCheckpointDir()


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


#: Tables written by ``cut`` and frames held by ``keep`` in each application, for ``release``.
_cuts: dict[str, list[str]] = {}
_kept: dict[str, list[DataFrame]] = {}


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table into the shared checkpoint folder and read it from there, which
    drops its lineage. The folder is replicated storage, so the result survives the loss of any
    executor. ``instead_of`` is an earlier result of ``cut`` that nothing needs any more once
    ``df`` is written, such as the round before in a loop; its table is removed."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4_raw").parquet(at)  # read once or twice soon: speed counts
    mine = _cuts.setdefault(spark.sparkContext.applicationId, [])
    mine.append(at)
    if instead_of is not None:
        gone = {x.rsplit("/", 2)[1] for x in instead_of.inputFiles()}
        for old in [p for p in mine if p.rsplit("/", 1)[1] in gone]:
            _remove(spark, old)
            mine.remove(old)
    return spark.read.schema(df.schema).parquet(at)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Give back what queries of this application hold: tables of ``cut`` are removed, frames of
    ``keep`` unpersisted. Results that still read them must have been written before. Returns
    the number of both."""
    app = spark.sparkContext.applicationId
    cuts, kept = _cuts.pop(app, []), _kept.pop(app, [])
    for p in cuts:
        _remove(spark, p)
    for df in kept:
        df.unpersist()
    return len(cuts) + len(kept)


def keep(df: DataFrame) -> DataFrame:
    """Cache ``df`` for reuse inside one query. Lineage stays, so a lost block is recomputed."""
    _kept.setdefault(df.sparkSession.sparkContext.applicationId, []).append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: A key is hot when it holds more than this share of the rows; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 500
SALTS = 48


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, least: int = 100_000) -> DataFrame:
    """Keys holding more than ``share`` of all rows of ``df`` and at least ``least`` rows.
    By construction there are at most ``1 / share`` of them, so they may be broadcast."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (
        counts.where(F.col("_n") >= least)
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("_n") > F.col("_total") * F.lit(share))
        .select(*keys)
    )


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot: DataFrame | None = None, least: int = 100_000) -> DataFrame:
    """Equi-join in which the rows of hot left keys are spread over ``SALTS`` partitions and
    the matching right rows are repeated that often. ``right`` should hold few rows a key. The
    salt is a hash of the row, so a task that runs again sends its rows the same way."""
    hot = hot_keys(left, on, least=least) if hot is None else hot
    mark = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    spread = left.join(mark, list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    ).drop("_hot")
    copied = right.join(mark, list(on), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return spread.join(copied, [*on, "_salt"], how).drop("_salt")


def hash128(*cols: Column) -> Column:
    """128-bit fingerprint of the columns as a struct of two independent 64-bit hashes."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("gneiss"), *cols).alias("b"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers (once an application). Those of a local
    master that was started elsewhere need it too."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gneiss-ship-')}/gneiss", "zip", root.parent, root.name)
    sc.addPyFile(made)
    _shipped.add(sc.applicationId)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table scan over at least as many partitions as there are cores, for work that
    costs much more than moving the rows. A scan with enough splits stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)
