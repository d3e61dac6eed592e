"""Session set-up and the shared folder that loops write their rounds to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, AQE with skew joins, Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName("threadloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    A session without that setting (tests, a laptop) gets a folder of this machine, which is
    enough as driver and executors are then one process.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="threadloom-")
    return f"file://{own}"


#: Whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Tables that an operator writes between its jobs.

    Each ``put`` writes Parquet to the shared folder and reads it again, so lineage ends there
    and no executor's loss takes the rows with it. ``drop`` removes a table no later plan reads;
    what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0
        self.seen: dict = {}
        self._paths: dict[int, str] = {}
        atexit.register(self._delete, self.base)

    def put(self, df: DataFrame, **observed: Column) -> DataFrame:
        """``df`` as a table. Named aggregates are taken while it is written and left in ``self.seen``."""
        path = f"{self.base}/{self._n}"
        self._n += 1
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            if observed:
                watch = Observation()
                df.observe(watch, *[c.alias(k) for k, c in observed.items()]).write.parquet(path)
                self.seen = watch.get
            else:
                df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Removes all tables of this stage."""
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        try:
            jvm, jsc = self.spark._jvm, self.spark._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone by the time the driver ends
            pass
