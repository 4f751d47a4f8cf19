"""Session construction and the shared-storage checkpoint helper."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("vecspan")


def get_spark(app: str = "vecspan", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VECSPAN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def capabilities(spark: SparkSession) -> DataFrame:
    """name, value: what the session has to work with. Also logged."""
    sc = spark.sparkContext
    found = {
        "master": sc.master, "spark": spark.version, "parallelism": str(sc.defaultParallelism), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "executor_memory": sc.getConf().get("spark.executor.memory", "1g"), "checkpoint": str(bool(sc._jsc.sc().getCheckpointDir().isDefined())).lower(),
    }
    log.info("capabilities: %s", found)
    return spark.createDataFrame(sorted(found.items()), "name string, value string")


class Timers:
    """Named timings of a run's steps, in order."""

    def __init__(self) -> None:
        self.records: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.records.append((name, 1000 * (time.perf_counter() - began)))
            log.debug("%s: %.0f ms", *self.records[-1])

    def table(self, spark: SparkSession) -> DataFrame:
        """place, operation, ms of every record."""
        rows = [(k, name, ms) for k, (name, ms) in enumerate(self.records)]
        return spark.createDataFrame(rows, "place int, operation string, ms double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: operations, total and mean time in ms."""
        ms = [x for _, x in self.records]
        return spark.createDataFrame([(len(ms), sum(ms), sum(ms) / max(1, len(ms)))], "operations long, total_ms double, mean_ms double")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir. Only a local master, whose executors are this process,
    may leave it unset; it gets a temporary folder."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not where and current.isDefined():
        where = current.get()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="vecspan-checkpoint-")
    if not current.isDefined():
        sc.setCheckpointDir(where)
    return where


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a file where Spark's readers find it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


class Stash:
    """Tables written once to shared storage and read back: lineage ends there, a lost executor costs nothing. They go with
    drop(), with drop_since() of a mark set before, or at exit."""

    _made: list[Stash] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/vecspan-{uuid.uuid4().hex}"
        self._made.append(self)
        atexit.register(self.drop)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self in self._made:
            self._made.remove(self)
            atexit.unregister(self.drop)
            _remove(self.spark, self.root)

    @classmethod
    def mark(cls) -> int:
        return len(cls._made)

    @classmethod
    def drop_since(cls, mark: int) -> None:
        """Drops what was made after the mark: the tables behind a result that is itself written by now."""
        for stash in cls._made[mark:]:
            stash.drop()
