"""What the library asks of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WRITTEN: list[str] = []
BUCKETED: dict[str, str] = {}  # names of tables by their place
CODEC = "spark.sql.parquet.compression.codec"


def use_checkpoints(spark: SparkSession) -> None:
    """Takes the folder that the session names in spark.checkpoint.dir. Where none is named, a session on one machine (tests) gets a temporary one; on a
    cluster that is an error, as such a folder would be lost with its machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder, so that lost executors lose no work and plans stay short."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str | list[str] | None = None) -> DataFrame:
    """Writes the rows as a table to the shared checkpoint folder and reads them from there: like cut_lineage, but later reads take only the columns they use.

    With ``by`` the table is parted into buckets of those columns, one for each partition of a shuffle, so that later joins and groups by it don't shuffle it again.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    name = f"table_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    WRITTEN.append(path)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [by] if isinstance(by, str) else by
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    BUCKETED[path] = name
    return spark.table(name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder, deleted with the written tables."""
    use_checkpoints(spark)
    WRITTEN.append(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def packing(spark: SparkSession) -> SparkSession:
    """A session like this one for frames of long texts that repeat each other: written as Parquet they are packed by zstd, a small part of the usual. Where the
    caller has chosen a codec it is this session itself, of which nothing is changed either way.
    """
    known = spark.conf.getAll
    if CODEC in known:
        return spark
    own = spark.newSession()
    for k, v in known.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set(CODEC, "zstd")
    return own


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that this process has written. Frames that rest on them can't be read afterwards."""
    while WRITTEN:
        at = WRITTEN.pop()
        if name := BUCKETED.pop(at, None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _shuffled(df: DataFrame) -> bool:
    """Does the plan of a frame hold an exchange?"""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """At least as many partitions as cores; a frame that has them, by its files or its plan, is not shuffled.

    Frames behind a shuffle are taken as they are: the engine has sized them, and asking for their number would run them.
    """
    if df.isStreaming or _shuffled(df):
        return df
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(2 * least)


def parts_for(df: DataFrame, inputs: int = 4) -> int:
    """Partitions for a shuffle of all rows of a frame read from files: one for so many that it is read in, so that tasks keep their size at any
    size of the input, and no fewer than the session's; the session's alone for a frame behind a shuffle. More would compress worse.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if df.isStreaming or _shuffled(df):
        return usual
    return max(usual, df.rdd.getNumPartitions() // inputs)
