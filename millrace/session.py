"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, adaptive execution, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a temporary one only if none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-checkpoint-"))


def spread(frame: DataFrame) -> DataFrame:
    """Rows over all cores if the source came in fewer splits than there are; else as they are.

    A large table has many splits and isn't moved; a small one in a single file is worked on by all
    tasks instead of one.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() * 2 <= cores else frame


class SharedTables:
    """Intermediate tables in the shared checkpoint folder, deleted when the application ends.

    A written table cuts lineage like a checkpoint, but is columnar, and any number of them is read
    back as one scan, so that the plans of an iterative operator stay the same size in every round.
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        frame.write.parquet(f"{self.folder}/{name}")
        return self.get(frame.schema, name)

    def get(self, schema: StructType, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}" for name in names))


def cut(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared checkpoint folder and drop its lineage.

    The files are replicated or shared storage, so a lost executor costs nothing but a reread.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
