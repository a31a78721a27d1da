"""Session defaults and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def get_session(app: str = "loomwatch", master: str | None = None, shuffle: int = 8) -> SparkSession:
    """A UTC session with adaptive execution on; on a cluster the launcher's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Zone-less timestamps become UTC instants, so that unix_micros accepts them."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. A session on one machine without one (a test) gets
    a new one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if of_context.isDefined():
        return of_context.get()
    if spark.sparkContext.master.startswith("local["):
        made = "file://" + tempfile.mkdtemp(prefix="loomwatch-")
        spark.sparkContext.setCheckpointDir(made)
        return made
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, for what several steps read: the optimiser changes equal plans apart, and would work them out once a step."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/loomwatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it; a cluster without that path gets the package
    by its own means (a wheel, or spark.submit.pyFiles)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # zone-less stamps are UTC everywhere
    # batches to Python are bounded by bytes, so that long texts don't fill a worker or the JVM's direct memory
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
