"""Sinks: a document store on Parquet with manifests, incremental updates and staged swaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.aggregates import fingerprint


class Store:
    """Tables in a folder, each as generations ``name/g-<id>``; pointers ``name/CURRENT/<number>`` hold
    a generation's name, and the one with the highest number is what readers see. A write fills a new
    generation and then adds a pointer in one step, so readers never see half of it or nothing, and a
    failed write leaves the old state. Two writers can't take the same number: the later one tries
    the next."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}/CURRENT")
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []

    def generation(self, name: str) -> str | None:
        known = self._pointers(name)
        return self.spark.read.text(f"{self.root}/{name}/CURRENT/{known[-1]}").first()[0] if known else None

    def read(self, name: str) -> DataFrame | None:
        g = self.generation(name)
        return None if g is None else self.spark.read.parquet(f"{self.root}/{name}/{g}")

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> str:
        g = f"g-{uuid.uuid4().hex}"
        w = df.write.mode("error")
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{self.root}/{name}/{g}")
        self.swap(name, g)
        return g

    def swap(self, name: str, generation: str) -> None:
        """Make ``generation`` what readers see. The pointer is written aside and renamed to the next
        free number, which fails where another writer has taken it."""
        fs, staged = self._fs(f"{self.root}/{name}/.staged-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(generation.encode()))
        out.close()
        fs.mkdirs(self._fs(f"{self.root}/{name}/CURRENT")[1])
        for _ in range(100):
            known = self._pointers(name)
            _, p = self._fs(f"{self.root}/{name}/CURRENT/{int(known[-1]) + 1 if known else 1:020}")
            if not fs.exists(p) and fs.rename(staged, p):
                return
        raise OSError(f"pointer of {name} was not swapped")

    def upsert(self, name: str, rows: DataFrame, key: str) -> str:
        """New rows replace those of the same key."""
        old = self.read(name)
        kept = rows if old is None else old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
        return self.write(name, kept)

    def delete(self, name: str, keys: DataFrame, key: str) -> str | None:
        old = self.read(name)
        return None if old is None else self.write(name, old.join(keys.select(key).distinct(), key, "left_anti"))


def manifest(items: DataFrame, doc: str, cols: list[str]) -> DataFrame:
    """Fingerprint of every document and, with NULL document, of the whole corpus."""
    by = fingerprint(items, [doc], cols)
    whole = fingerprint(by.withColumn("_all", F.lit(1)), ["_all"], [doc, "fingerprint"]).select(F.lit(None).cast("string").alias(doc), "fingerprint")
    return by.select(F.col(doc).cast("string").alias(doc), "fingerprint").unionByName(whole)


def incremental(items: DataFrame, known: DataFrame | None, text: str, encode) -> DataFrame:
    """``(text_hash, vector)`` for all distinct texts: those of ``known`` are reused, each new
    text is encoded once."""
    h = items.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("_t")).dropDuplicates(["text_hash"])
    if known is None:
        return h.select("text_hash", encode("_t").alias("vector"))
    fresh = h.join(known.select("text_hash"), "text_hash", "left_anti").select("text_hash", encode("_t").alias("vector"))
    return known.join(h.select("text_hash"), "text_hash", "left_semi").select("text_hash", "vector").unionByName(fresh)
