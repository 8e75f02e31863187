"""Session helpers: building a local session for tests/bench and locating the
shared folder for lineage cuts and scratch files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench (never by library code)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("errata")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Bytes of estimated size up to which a join side is broadcast unasked.
BROADCAST_BYTES = 256 * 1024


def bound_broadcasts(spark: SparkSession) -> None:
    """Lower the session's threshold for unasked broadcasts where it is higher.
    Spark takes a written table for as large as its files, an exploded one for
    as large as its input and a shuffled one for its compressed blocks; catalog
    tables are up to a hundred times that in memory, so under the default of
    10 MB they would be collected in the driver.  Fixed tables carry a hint."""
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        # with a default of its own, get() does not give Spark's; the second key has none and then follows the first
        given = spark.conf.get(key) if key == "spark.sql.autoBroadcastJoinThreshold" else spark.conf.get(key, None)
        m = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", (given or "").strip().lower())
        if m and int(m[1]) * 1024 ** " kmgtp".index(m[2] or " ") > BROADCAST_BYTES:
            spark.conf.set(key, str(BROADCAST_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  A purely local
    session (one JVM) without the setting gets a folder of its own; on any
    other master the setting is required, since a driver's folder is not
    visible to the executors."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        d = tempfile.mkdtemp(prefix="errata-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables and
    small files that a job writes and reads back."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "errata-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str, compression: str | None = None):
    """Cut lineage by writing ``df`` as a parquet table under the shared
    checkpoint folder and reading it back.  Unlike ``checkpoint()`` the
    re-read table claims no partitioning, so adaptive re-planning downstream
    never meets a stale partition count."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)
