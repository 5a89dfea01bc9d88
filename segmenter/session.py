"""Session helpers.

Library code never creates its own session; it receives one. ``build_session``
exists for tests, ``bench.py`` and local runs. ``checkpoint_dir`` reads the
cluster's ``spark.checkpoint.dir`` and only falls back to a fresh scratch folder
when the setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # windows-1251 and other legacy charsets for the CSV scan.
    "spark.sql.legacy.javaCharsets": "true",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``segmenter`` importable in Python workers (once per application).

    Deployments normally pass the package with ``--py-files``; this does the
    same from a running session: the package is zipped in memory, written to
    the shared checkpoint folder and added with ``addPyFile``, so worker-side
    code never depends on the driver's working directory.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    target = f"{scratch_path(spark, 'pkg')}/segmenter.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "segmenter", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system). Only
    when it is unset, as in tests, a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors do not share local ones")
        configured = tempfile.mkdtemp(prefix="segmenter-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a written intermediate table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back.

    Survives executor loss (unlike cached or local-checkpointed blocks), pins
    non-deterministic columns such as partition ids, and later passes read
    only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame of ``cut_lineage`` that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    spark = df.sparkSession
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables").toUri().getPath()
    for folder in folders:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if p.toUri().getPath().startswith(base + "/"):
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage_observed(df: DataFrame, name: str, *metrics) -> tuple[DataFrame, dict]:
    """``cut_lineage`` that also returns aggregate ``metrics`` (Columns)
    computed while the table is written -- no separate pass over the data."""
    from pyspark.sql import Observation

    spark = df.sparkSession
    obs = Observation(f"{name}_metrics")
    path = scratch_path(spark, name)
    df.observe(obs, *metrics).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), obs.get


def checkpoint_partitions(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder, for stages whose
    next step walks each physical partition in order (the partitions are kept
    one to one, which a re-read Parquet table does not guarantee)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Partition count for an explicit repartition of ``df``: about
    ``target_bytes`` per partition of input, never fewer than
    ``spark.sql.shuffle.partitions`` (AQE does not resize a repartition with an
    explicit count, so it is sized here). The input size is the sum of the
    plan's leaf relations with a known size -- estimates of joins and of
    in-memory relations are unreliable without cost-based statistics."""
    base = shuffle_partitions(df.sparkSession)
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            size = int(str(leaves.apply(i).stats().sizeInBytes()))
            if size < (1 << 60):
                total += size
    except Exception:  # estimate unavailable: keep the configured count
        return base
    return int(max(base, -(-total // target_bytes)))
