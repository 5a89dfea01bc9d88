"""Split long texts into parts of at most N characters, preferring to break
before a newline (the newline starts the next part); a part with no newline in
reach is cut hard at N. Concatenating the parts gives the text back.

One regular expression per text (longest run of <= N characters followed by a
newline or the end, else N characters), exploded with positions: JVM only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MESSAGE_PART_LIMIT


def chunk_pattern(max_len: int) -> str:
    return rf"(?s).{{1,{max_len}}}(?=\n|\z)|.{{1,{max_len}}}"


def chunk_text(df: DataFrame, text_col: str, id_col: str, max_len: int = MESSAGE_PART_LIMIT) -> DataFrame:
    parts = F.regexp_extract_all(F.col(text_col), F.lit(chunk_pattern(max_len)), 0)
    return (df.select(id_col, F.posexplode(parts).alias("chunk_no", "chunk"))
            .select(id_col, F.col("chunk_no").cast("int").alias("chunk_no"), "chunk"))
