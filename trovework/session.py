"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trovework")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "6g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset (tests) a new local one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="trovework-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: write it once to the shared folder and read it back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder, not yet there, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as a parquet table, so that later reads can prune columns and push filters down."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sample_by_hash(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most limit rows, those first by a hash of key. Rows beyond twice the share that is needed are filtered where they are read."""
    from pyspark.sql import functions as F

    n = df.count()
    h = F.xxhash64(F.lit(17), key)
    if n > 4 * limit:
        df = df.where(F.pmod(h, F.lit(1_000_003)) < int(1_000_003 * (2 * limit + 100) / n))
    return df.orderBy(h).limit(limit)
