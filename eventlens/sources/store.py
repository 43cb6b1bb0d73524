"""Tables as key buckets of delta files under one manifest.

A commit writes, for each table, the rows that changed, split into buckets by a hash of the key, and
then a manifest that names the folders of every bucket of every table. The manifest becomes visible
by one rename, so a round shows in all tables at once or not at all, and a writer that is killed
leaves the version before it as it was. Buckets without changes keep their files; nothing is copied.
Readers take the newest row of a key, and only in buckets that have more than one folder; those are
folded into one by ``compact``. ``vacuum`` deletes folders that no kept manifest names.

One writer at a time, as a streaming query is. No table format with MERGE is assumed; all files are
reached through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that a stored row has besides its own.
COMMIT, GONE, BUCKET = "_commit", "_gone", "_bucket"
BUCKETS, MOST_FOLDERS = 32, 8


@dataclass(frozen=True)
class Manifest:
    """``files``: table to bucket to folders, oldest first; ``schemas``: table to its own columns."""

    number: int = 0
    info: dict = field(default_factory=dict)
    files: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


def _print(df: DataFrame):
    """Hash of all columns of a row."""
    columns = [
        F.to_json(f"`{f.name}`") if isinstance(f.dataType, (T.VariantType, T.MapType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    return F.xxhash64(*columns, nulls)


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows of new that are new or differ, keys that are gone)``; only hashes are joined."""
    before = old.select(*keys, _print(old).alias("_was"))
    changed = new.withColumn("_is", _print(new)).join(before, keys, "left")
    upserts = changed.where(~F.col("_is").eqNullSafe(F.col("_was"))).select(*new.columns)
    return upserts, before.join(new.select(*keys), keys, "left_anti").select(*keys)


class Store:
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def numbers(self) -> list[int]:
        """Complete versions, oldest first."""
        names = self._names(f"{self.root}/manifest")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """The given or newest version; an empty one before the first."""
        done = self.numbers()
        if number == 0 or not done:
            return Manifest()
        name = self._path(f"{self.root}/manifest/{number or done[-1]:09d}.json")
        stream = self.fs.open(name)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _publish(self, manifest: Manifest) -> int:
        name = f"{self.root}/manifest/{manifest.number:09d}.json"
        draft = self._path(f"{self.root}/manifest/draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(draft, self._path(name)):
            raise RuntimeError(f"version {manifest.number} was written by someone else")
        return manifest.number

    def bucket_of(self, table: str):
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame) -> dict[str, str]:
        """Write stored rows and return the folder of each bucket that got any."""
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self.bucket_of(table)).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(folder)
        named = [n for n in self._names(folder) if n.startswith(f"{BUCKET}=")]
        return {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in named}

    def read(self, table: str, number: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, of the wanted buckets only; None where the table was never written."""
        return self._rows(self.manifest(number), table, buckets)

    def _rows(self, manifest: Manifest, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        if table not in manifest.schemas:
            return None
        own = T.StructType.fromJson(json.loads(manifest.schemas[table]))
        stored = T.StructType([*own.fields, T.StructField(COMMIT, T.LongType()), T.StructField(GONE, T.BooleanType())])
        wanted = None if buckets is None else set(map(str, buckets))
        files = {b: f for b, f in manifest.files.get(table, {}).items() if wanted is None or b in wanted}
        single = [f[0] for f in files.values() if len(f) == 1]
        several = [x for f in files.values() if len(f) > 1 for x in f]
        parts = []
        if single:
            parts.append(self.spark.read.schema(stored).parquet(*single))
        if several:
            rows = self.spark.read.schema(stored).parquet(*several)
            keys = self.keys[table]
            rest = [c for c in stored.names if c not in keys]
            newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), COMMIT).alias("_newest"))
            parts.append(newest.select(*keys, "_newest.*"))
        if not parts:
            return self.spark.createDataFrame([], own)
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return every.where(~F.col(GONE)).select(*own.names)

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame | None]], info: dict) -> int:
        """Write a new version. ``changes``: table to its upserted rows, one per key, and the keys that
        are gone. Tables and buckets without changes keep their files."""
        last = self.manifest()
        number = last.number + 1
        files = {t: {b: list(f) for b, f in of.items()} for t, of in last.files.items()}
        schemas = dict(last.schemas)
        for table, (upserts, gone) in changes.items():
            rows = upserts.withColumns({COMMIT: F.lit(number).cast("bigint"), GONE: F.lit(False)})
            if gone is not None:
                marks = {COMMIT: F.lit(number).cast("bigint"), GONE: F.lit(True)}
                rows = rows.unionByName(gone.select(*self.keys[table]).withColumns(marks), allowMissingColumns=True)
            for bucket, folder in self._write(table, rows).items():
                files.setdefault(table, {}).setdefault(bucket, []).append(folder)
            schemas[table] = upserts.schema.json()
        return self._publish(Manifest(number, info, files, schemas))

    def compact(self, table: str, most: int = MOST_FOLDERS) -> list[int]:
        """Fold buckets of more than ``most`` folders into one folder each; returns these buckets."""
        last = self.manifest()
        crowded = sorted(int(b) for b, f in last.files.get(table, {}).items() if len(f) > most)
        if crowded:
            rows = self._rows(last, table, crowded)
            marks = {COMMIT: F.lit(last.number).cast("bigint"), GONE: F.lit(False)}
            made = self._write(table, rows.withColumns(marks))
            kept = {b: f for b, f in last.files[table].items() if int(b) not in crowded}
            files = {**last.files, table: {**kept, **{b: [f] for b, f in made.items()}}}
            self._publish(Manifest(last.number + 1, last.info, files, last.schemas))
        return crowded

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders and manifests that the newest ``keep`` versions do not need."""
        done = self.numbers()
        needed = {
            folder for n in done[-keep:] for of in self.manifest(n).files.values() for f in of.values() for folder in f
        }
        deleted = 0
        for table in self.keys:
            for name in self._names(f"{self.root}/{table}"):
                for part in self._names(f"{self.root}/{table}/{name}"):
                    folder = f"{self.root}/{table}/{name}/{part}"
                    if part.startswith(f"{BUCKET}=") and folder not in needed:
                        self.fs.delete(self._path(folder), True)
                        deleted += 1
        for n in done[:-keep]:
            self.fs.delete(self._path(f"{self.root}/manifest/{n:09d}.json"), False)
        return deleted
