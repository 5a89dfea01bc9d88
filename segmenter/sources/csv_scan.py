"""Fault-tolerant CSV scan with a quarantine of broken lines.

Each file is read as lines (so blank lines are seen, and nothing is skipped
silently), decoded per file (UTF-8 when every line is valid UTF-8, else the
caller's fallback charset, undecodable bytes replaced), and each physical line
is parsed alone with ``from_csv`` against the header of its own file. A line is
accepted when it has exactly that header's field count and at least one
non-empty field; everything else goes to the reject table with its file, 1-based
line number, raw text and reason.

The input is planned and read once: its lines are written to the shared folder
with their file, split and row id. Counts, charset, headers and line numbers all
come from that table, so they agree whatever splits a later planning would make.
Line numbers need no per-file window: row ids are consecutive inside a split, and
a count per split gives its first line number.

Files are aligned by column name. The result has the names of all headers, in
order of first appearance (files by path); a column that a file lacks is null,
and of a name repeated in one header the first counts. Lines of a file whose
header has fewer than two names are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataQualityError
from ..schemas import NA_TOKENS
from ..session import cut_lineage

CSV_GLOB = "*.[cC][sS][vV]"


@dataclass
class ScanResult:
    accepted: DataFrame
    rejected: DataFrame
    header: list[str]


# Charsets every JVM has; others (windows-1251, ...) need the legacy switch.
_STANDARD_CHARSETS = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}


def _allow_charset(spark: SparkSession, charset: str) -> None:
    if charset.upper() not in _STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    # A byte the charset lacks becomes the replacement character.
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def stored_lines(spark: SparkSession, path: str, glob: str | None = CSV_GLOB) -> DataFrame:
    """All lines of the input (bytes, file, block, _mid), read once and kept."""
    reader = spark.read.format("text")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return cut_lineage(reader.load(path)
                       .select(F.col("value").cast("binary").alias("bytes"),
                               F.col("_metadata.file_path").alias("file"),
                               F.col("_metadata.file_block_start").alias("block"),
                               F.monotonically_increasing_id().alias("_mid")), "csv-lines")


def split_starts(lines: DataFrame, fallback_charset: str) -> DataFrame:
    """One row per split (file, block): its first row id, the number of lines
    before it in its file, and the file's charset check and header names."""
    stats = (lines.groupBy("file", "block")
             .agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("_first"),
                  F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("utf8"),
                  F.min_by("bytes", "_mid").alias("first_line")))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")
                             .rowsBetween(Window.unboundedPreceding, -1))
    per_file = stats.groupBy("file").agg(F.bool_and("utf8").alias("file_utf8"),
                                         F.min_by("first_line", "block").alias("first_line"))
    names = F.transform(F.split(_decoded("first_line", "file_utf8", fallback_charset), ","),
                        lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return cut_lineage(stats.select("file", "block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
                       .join(per_file.select("file", "file_utf8", names.alias("names")), "file"), "csv-splits")


def _decoded(col: str, is_utf8: str, fallback_charset: str) -> Column:
    return F.when(F.col(is_utf8), F.decode(col, "UTF-8")).otherwise(F.decode(col, fallback_charset))


def _header(starts: DataFrame) -> tuple[list[str], list[int]]:
    """All column names in order of first appearance, and the distinct header
    widths (both bounded by the layouts in use, not by the data)."""
    files = starts.where("_before = 0").select("file", "names")
    usable = files.where(F.size("names") >= 2)
    names = (usable.select("file", F.posexplode("names").alias("at", "name"))
             .groupBy("name").agg(F.min(F.struct("file", "at")).alias("first")).orderBy("first").collect())
    if not names:
        raise DataQualityError("bad header" if files.head(1) else "empty file")
    widths = usable.select(F.size("names").alias("w")).distinct().orderBy("w").collect()
    return [r["name"] for r in names], [r["w"] for r in widths]


def _fields(width: int) -> Column:
    """A line parsed as ``width`` fields: (array of fields, whether the count is another)."""
    ddl = ", ".join(f"_c{i} STRING" for i in range(width)) + ", _bad STRING"
    p = F.from_csv(F.col("line"), ddl, {"columnNameOfCorruptRecord": "_bad",
                                        "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"})
    return F.struct(F.array(*[p[f"_c{i}"] for i in range(width)]).alias("f"), p["_bad"].isNotNull().alias("bad"))


def read_csv_robust(spark: SparkSession, path: str, fallback_charset: str = "windows-1251",
                    glob: str | None = CSV_GLOB, header: list[str] | None = None) -> ScanResult:
    """S1 + S2 + S4: accepted rows (header names, all STRING) and rejected lines.
    A ``header`` given replaces the first line of every file."""
    _allow_charset(spark, fallback_charset)
    stored = stored_lines(spark, path, glob)
    starts = split_starts(stored, fallback_charset)
    if header:
        starts = starts.withColumn("names", F.array(*[F.lit(h) for h in header]))
    columns, widths = _header(starts)
    lines = (stored.join(starts, ["file", "block"])
             .withColumn("line_no", F.col("_before") + F.col("_mid") - F.col("_first") + 1).where("line_no > 1")
             .select("file", "line_no", "names", _decoded("bytes", "file_utf8", fallback_charset).alias("line")))
    parsed = F.lit(None)
    for w in widths:
        parsed = F.when(F.size("names") == w, _fields(w)).otherwise(parsed)
    p = lines.select("file", "line_no", "line", "names", parsed.alias("p"))
    bad = F.coalesce(F.col("p.bad"), F.lit(True))
    any_value = F.coalesce(F.exists("p.f", lambda x: F.coalesce(F.length(x) > 0, F.lit(False))), F.lit(False))
    accepted = p.where(~bad & any_value).select(
        *[F.when(F.array_contains("names", c), F.try_element_at("p.f", F.array_position("names", F.lit(c)).cast("int"))).alias(c)
          for c in columns])
    reason = (F.when(F.size("names") < 2, F.lit("bad header")).when(bad, F.lit("field count"))
              .otherwise(F.lit("empty row")))
    rejected = p.where(bad | ~any_value).select("file", "line_no", F.col("line").alias("raw"), reason.alias("reason"))
    return ScanResult(accepted, rejected, columns)


def null_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """S3: the default NA tokens (after trimming) become null in string columns."""
    toks = tokens or NA_TOKENS
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")).isin(*toks), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def check_usable(result: ScanResult, min_rows: int = 2) -> int:
    """At least ``min_rows`` accepted rows, else DataQualityError. Counts no
    further than that."""
    n = result.accepted.limit(min_rows).count()
    if n < min_rows:
        raise DataQualityError(f"only {n} usable rows")
    return n


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in an explicit order (a top-n, not an unordered head)."""
    return df.orderBy(*order_by).limit(n)


def is_csv_name(name: str) -> bool:
    """Upload names accepted by the scan."""
    return name.lower().endswith(".csv")
