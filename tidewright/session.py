"""Session and checkpoint helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir.

    Only a local session that names none (a test) gets a temporary folder; a
    folder of one machine is no use to a cluster.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewright-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's switch that drops the shuffle files of a query when the query is over; a later retry makes them again.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_large(df: DataFrame) -> DataFrame:
    """As ``cut``, for large results: the shuffle files that they were made from go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        return cut(df.select("*"))  # the switch is read as a frame is made
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """As ``cut``, for loops that join what the round before gave.

    A checkpoint keeps the size that its plan was estimated at. Of a join that is the
    product of both sides, so in a loop its digits multiply each round until
    they fill the driver's heap. Here the size counts as unknown.
    """
    spark, done = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a partition of a small scan that a CPU-heavy step follows.

    Only a scan with fewer splits than cores is shuffled, so at most
    spark.sql.files.maxPartitionBytes a core; the texts of a larger input stay
    where the splits of its files put them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
