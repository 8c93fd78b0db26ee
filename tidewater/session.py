"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def build_session(app: str = "tidewater", cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-tidewater-", dir="/tmp")
    return f"file://{_OWN_DIRS[app]}"


class Scratch:
    """Tables written in the shared folder: lineage is cut there, and lost executors cost no recomputation beyond them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class bounded_batches:  # noqa: N801
    """Rows that go to Python at once, unless the user has asked for fewer: texts are long.

    Called, it holds for the session's plans from then on, as a plan that is run later needs;
    as `with bounded_batches(...)` the setting is put back at the end of the block.
    """

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, rows: int = 512):
        self.spark, self.before = spark, spark.conf.get(self.KEY, None)
        if not 0 < int(self.before or 10_000) <= rows:
            spark.conf.set(self.KEY, str(rows))

    def __enter__(self) -> bounded_batches:
        return self

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


def columns_of(df: DataFrame) -> list[str]:
    """Its columns' names, quoted so that dots in them do no harm."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
