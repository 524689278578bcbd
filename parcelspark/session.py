"""Session helpers: building a session, the shared folder, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("parcelspark").config("spark.driver.memory", memory)
    for k, v in (CONF | {"spark.sql.shuffle.partitions": str(partitions or cores)} | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="parcelspark-")
            atexit.register(shutil.rmtree, _LOCAL_DIRS[app][7:], True)
        at = _LOCAL_DIRS[app]
    return at.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    A stage that several later stages read is computed once, and a lost executor costs a file read, not the lineage.
    """
    spark = df.sparkSession
    at = table_path(spark, tag)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more; what else lies in the shared folder stays."""
    for df in tables:
        spark = df.sparkSession
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if at.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") == shared_dir(spark).split(":", 1)[-1].lstrip("/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
