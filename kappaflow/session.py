"""Session helpers.

The library never creates a hidden session: every operator takes DataFrames
and returns DataFrames.  These helpers only exist for tests, the bench and
the command-line plans.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that matter at cluster scale.  AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splits hot partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "kappaflow", extra: dict | None = None) -> SparkSession:
    """A session with the settings above.  Master, memory and partitions are
    left to ``spark-submit`` and its configuration unless given here."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """The one-machine session of tests, bench and tools."""
    return build_session(f"local[{cpus}]", None if cpus == "*" else int(cpus),
                         extra={"spark.driver.memory": memory})


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a single-process session (``local[...]``) without that setting gets a
    folder of its own; on a cluster a missing setting is an error, because a
    machine-local folder would lose its files with the machine."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    configured = tempfile.mkdtemp(prefix="kappaflow-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written table, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
