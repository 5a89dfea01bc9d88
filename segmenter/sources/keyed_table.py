"""Keyed tables on Parquet with committed versions.

Layout under the table's folder:

    data/<write>/_bucket=<k>/...    files of one write, by hash bucket of the key
    versions/<number>.json          one manifest per version, never changed

A manifest names, for every bucket, the writes that hold its rows. A change
writes new files, for the buckets it touches only, and commits by moving a
manifest to the next version's name, which fails if that exists. So a change is
there whole or not at all, the loser of two writers starts again from the
winner's version, and a reader keeps the version it opened: nothing it reads is
changed or removed.

A manifest also keeps, per writer, the last epoch it applied. A change that
names a writer and an epoch (a micro-batch) adds nothing when it comes again.

Rows are range-partitioned on (bucket, key, order columns) and sorted when they
are written: a hot key spreads over many files, and row-group statistics prune
within a file. Reading or deleting a key opens its bucket's files only.

What the driver holds is the manifest: one entry per bucket and write, however
many rows there are; ``compact`` brings it back to one write per bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ConflictError
from ..operators.upsert import delete_keys, upsert
from ..session import partitions_for

BUCKET = "_bucket"


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    order: tuple[str, ...]
    buckets: int
    schema: str
    writes: dict[int, tuple[str, ...]] = field(default_factory=dict)  # bucket -> writes that hold its rows
    epochs: dict[str, int] = field(default_factory=dict)              # writer -> last applied epoch

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(**{**d, "order": tuple(d["order"]), "writes": {int(b): tuple(w) for b, w in d["writes"].items()}})


class KeyedTable:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    @classmethod
    def create(cls, spark: SparkSession, base: str, schema: StructType, key: str, order: Sequence[str] = (), buckets: int = 64) -> KeyedTable:
        """The table at ``base``, as version 0 without rows where it doesn't exist."""
        table = cls(spark, base)
        if not table._exists(table._manifest_path(0)):
            try:
                table._commit(Manifest(0, key, tuple(order), buckets, schema.json()))
            except ConflictError:
                pass  # another writer has just created it
        return table

    # --- files ---

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _exists(self, name: str) -> bool:
        p = self._path(name)
        return p.getFileSystem(self._conf).exists(p)

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        fs = p.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _manifest_path(self, version: int) -> str:
        return f"{self.base}/versions/{version:012d}.json"

    def _bucket_path(self, write: str, bucket: int) -> str:
        return f"{self.base}/data/{write}/{BUCKET}={bucket}"

    # --- versions ---

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the newest by default."""
        if version is None:
            version = max(int(n[:-5]) for n in self._names(f"{self.base}/versions") if n.endswith(".json") and n[0].isdigit())
        p = self._path(self._manifest_path(version))
        stream = p.getFileSystem(self._conf).open(p)
        try:
            return Manifest.from_json(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, m: Manifest) -> None:
        """Make ``m`` its version, or raise ConflictError if that exists."""
        draft = self._path(f"{self.base}/versions/_draft-{uuid.uuid4().hex}")
        fs = draft.getFileSystem(self._conf)
        out = fs.create(draft, True)
        try:
            out.write(bytearray(m.to_json().encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), self._conf)
        try:  # without an overwriting option the rename fails on an existing name
            files.rename(fs.makeQualified(draft), fs.makeQualified(self._path(self._manifest_path(m.version))), options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._exists(self._manifest_path(m.version)):
                raise ConflictError(f"version {m.version} of {self.base} exists") from None
            raise

    def _change(self, step: Callable[[Manifest], Manifest], writer: str | None, epoch: int | None, attempts: int = 10) -> int:
        """Apply ``step`` to the newest version and commit; again from the
        newest where another writer was first. Returns the version."""
        for _ in range(attempts):
            m = self.manifest()
            if writer is not None and m.epochs.get(writer, -1) >= epoch:
                return m.version
            new = step(m)
            if writer is not None:
                new = replace(new, epochs={**new.epochs, writer: epoch})
            if new == m:
                return m.version
            try:
                self._commit(replace(new, version=m.version + 1))
                return m.version + 1
            except ConflictError:
                continue
        raise ConflictError(f"{attempts} other changes of {self.base} came first")

    # --- reading ---

    def _frame(self, m: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        paths = [self._bucket_path(w, b) for b in (sorted(m.writes) if buckets is None else buckets) for w in m.writes.get(b, ())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._frame(self.manifest(version))

    def _bucket(self, m: Manifest, key) -> F.Column:
        kind = StructType.fromJson(json.loads(m.schema))[m.key].dataType
        return F.pmod(F.xxhash64(key.cast(kind)), F.lit(m.buckets)).cast("int")

    def read_key(self, value, version: int | None = None) -> DataFrame:
        """The rows of one key (or of the null key), from its bucket alone."""
        m = self.manifest(version)
        bucket = self.spark.range(1).select(self._bucket(m, F.lit(value)).alias("b")).first()["b"]
        return self._frame(m, [bucket]).where(F.col(m.key).eqNullSafe(F.lit(value)) if value is None else F.col(m.key) == F.lit(value))

    # --- writing ---

    def _write(self, m: Manifest, rows: DataFrame) -> tuple[str, list[int]]:
        """(write, buckets that have rows in it)."""
        write = uuid.uuid4().hex
        keys = [BUCKET, m.key, *m.order]
        placed = rows.withColumn(BUCKET, self._bucket(m, F.col(m.key)))
        (placed.repartitionByRange(partitions_for(rows), *keys).sortWithinPartitions(*keys)
         .write.partitionBy(BUCKET).parquet(f"{self.base}/data/{write}"))
        names = self._names(f"{self.base}/data/{write}")
        return write, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))

    def _touched(self, m: Manifest, keys: DataFrame, key: str) -> list[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        return sorted(r["b"] for r in keys.select(self._bucket(m, F.col(key)).alias("b")).distinct().collect())

    def _rewrite(self, m: Manifest, touched: Sequence[int], rows: DataFrame) -> Manifest:
        """``m`` with the touched buckets' rows replaced."""
        write, full = self._write(m, rows)
        writes = {b: w for b, w in m.writes.items() if b not in set(touched)}
        return replace(m, writes={**writes, **{b: (write,) for b in full}})

    def append(self, rows: DataFrame, writer: str | None = None, epoch: int | None = None) -> int:
        """Add rows."""
        def step(m: Manifest) -> Manifest:
            write, full = self._write(m, rows.select(StructType.fromJson(json.loads(m.schema)).names))
            return replace(m, writes={**m.writes, **{b: (*m.writes.get(b, ()), write) for b in full}})
        return self._change(step, writer, epoch)

    def replace_all(self, rows: DataFrame, writer: str | None = None, epoch: int | None = None) -> int:
        """A full refresh; readers of earlier versions keep theirs."""
        def step(m: Manifest) -> Manifest:
            return self._rewrite(m, list(m.writes), rows.select(StructType.fromJson(json.loads(m.schema)).names))
        return self._change(step, writer, epoch)

    def upsert(self, changes: DataFrame, version: str = "_version", columns: Sequence[str] | None = None, defaults: dict | None = None,
               writer: str | None = None, epoch: int | None = None) -> int:
        """K1, K3: as ``operators.upsert.upsert``; only touched buckets are rewritten."""
        def step(m: Manifest) -> Manifest:
            touched = self._touched(m, changes, m.key)
            return self._rewrite(m, touched, upsert(self._frame(m, touched), changes, m.key, version, columns, defaults)) if touched else m
        return self._change(step, writer, epoch)

    def delete(self, keys: DataFrame, key: str | None = None, writer: str | None = None, epoch: int | None = None) -> int:
        """K4: drop the rows of some keys; only their buckets are read and rewritten."""
        def step(m: Manifest) -> Manifest:
            touched = [b for b in self._touched(m, keys, key or m.key) if b in m.writes]
            return self._rewrite(m, touched, delete_keys(self._frame(m, touched), keys, m.key, key or m.key)) if touched else m
        return self._change(step, writer, epoch)

    def compact(self, most: int = 1) -> int:
        """Bring buckets of more than ``most`` writes together in one; the rows stay."""
        def step(m: Manifest) -> Manifest:
            crowded = sorted(b for b, w in m.writes.items() if len(w) > most)
            return self._rewrite(m, crowded, self._frame(m, crowded)) if crowded else m
        return self._change(step, None, None)
