"""Table writes in the shared folder; committed versions are in ``keyed_table``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataQualityError
from ..session import scratch_path


def load_corpus(corpus: DataFrame, path: str | None = None, dim: int | None = None) -> DataFrame:
    """Full refresh of the recommendation corpus with a vector-width check.

    Every vector must have the same width (``dim`` if given). The check is one
    aggregation; the write replaces the table; the table is read back.
    """
    spark = corpus.sparkSession
    stats = corpus.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
                       F.count_if(F.col("embedding").isNull()).alias("nulls")).first()
    if stats["nulls"] or stats["lo"] != stats["hi"] or (dim is not None and stats["lo"] != dim):
        raise DataQualityError(f"vector widths {stats['lo']}..{stats['hi']}, nulls {stats['nulls']}")
    path = path or scratch_path(spark, "recommendations")
    corpus.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def create_tables(spark, base: str) -> dict[str, str]:
    """The four stored tables as empty Parquet tables with their schemas,
    created only where absent (idempotent). Returns name -> path."""
    from ..schemas import LAST_SEEN_SCHEMA, MESSAGES_SCHEMA, MUTES_SCHEMA, USERS_SCHEMA

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, schema in (("users", USERS_SCHEMA), ("messages_history", MESSAGES_SCHEMA),
                         ("muted_users", MUTES_SCHEMA), ("last_message_time", LAST_SEEN_SCHEMA)):
        path = f"{base.rstrip('/')}/{name}"
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            spark.createDataFrame([], schema).write.parquet(path)
        out[name] = path
    return out
