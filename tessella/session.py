"""Session helpers: configuration, table reading, size-checked broadcasts and cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a side of a join is broadcast; each caller's rows are under about 200 bytes.
BROADCAST_ROWS = 200_000


def session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one of our own only where it is unset
    and all executors are on this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), "tessella-shared")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there,
    the result survives the loss of executors and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing reads any more, so that a job's steps do not add up on disk."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("cut-"):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a broadcast of ``small`` only if it has at most ``rows`` rows, else by shuffle.
    ``small`` should be cheap to count, e.g. come from :func:`cut`."""
    if small.count() <= rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each ``key``. Only keys that stand more than once are gathered with
    their other columns, so whole texts are not shuffled for the few rows delivered twice. A null
    key is a key."""
    k = F.coalesce(F.xxhash64(key), F.lit(0))  # equal keys have equal hashes: what is single by hash is single
    twice = cut(df.select(k.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    x = df.withColumn("_h", k)
    return sized_join(x, twice, ["_h"], "left_anti").unionByName(sized_join(x, twice, ["_h"], "left_semi").dropDuplicates([key])).drop("_h")
