"""Keeping a chunk table current: what to skip, replace and prune; versions of the table on disk."""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint(config: dict, code: dict[str, bytes] | None = None) -> str:
    """sha256 over code files by name and the settings that change results."""
    h = hashlib.sha256()
    for name in sorted(code or {}):
        h.update(name.encode())
        h.update(code[name])
    h.update(json.dumps(config, sort_keys=True).encode())
    return h.hexdigest()


def changed(files: DataFrame, state: DataFrame, print_now: str) -> DataFrame:
    """files(source_path, file_hash) that aren't in state(source_path, file_hash, pipeline_fingerprint) as they are now."""
    now = files.withColumn("pipeline_fingerprint", F.lit(print_now))
    return now.join(state, ["source_path", "file_hash", "pipeline_fingerprint"], "left_anti")


def unchanged(files: DataFrame, state: DataFrame, print_now: str) -> DataFrame:
    now = files.withColumn("pipeline_fingerprint", F.lit(print_now))
    return now.join(state, ["source_path", "file_hash", "pipeline_fingerprint"], "left_semi")


def vanished(state: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct source paths of the table that no file has now; files that failed count as there."""
    return state.select("source_path").distinct().join(files.select("source_path"), "source_path", "left_anti")


def upserted(table: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The table with every file of `fresh` replaced and every path of `gone` left out. A chunk id of `fresh` counts once; what stays isn't shuffled by it."""
    kept = table.join(fresh.select("source_path").distinct(), "source_path", "left_anti")
    if gone is not None:
        kept = kept.join(gone.select("source_path"), "source_path", "left_anti")
    return kept.unionByName(fresh.dropDuplicates(["chunk_id"]), allowMissingColumns=True)


def stats(discovered: DataFrame, skipped: DataFrame, failed: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """One row of counters."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    out = one(discovered, "files_discovered")
    parts = [one(skipped, "files_skipped"), one(failed, "files_failed"), fresh.agg(F.countDistinct("source_path").alias("files_processed"), F.count(F.lit(1)).alias("chunks_written")), one(gone, "files_pruned")]
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    return out


def distinct_subdivisions(chunks: DataFrame, track_type: str) -> DataFrame:
    """One row: the sorted distinct subdivisions of chunks of the track type; blank ones don't count."""
    named = F.when((F.col("document_type") == track_type) & (F.col("subdivision") != ""), F.col("subdivision"))
    return chunks.select(named.alias("s")).distinct().agg(F.array_sort(F.collect_list("s")).alias("subdivisions"))


class VersionedTable:
    """A Parquet table in buckets by source path; numbered pointers name the folder of each bucket, and the highest is current.

    An upsert writes only the buckets that its paths fall in. A version appears by creating one small
    file under a number that nobody has used, so readers see a whole version or the one before, a writer
    that comes second is told, and a crash leaves the last version as it was. Folders of older versions
    stay until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        p, store = self._file(folder)
        return [s.getPath().getName() for s in store.listStatus(p)] if store.exists(p) else []

    def version(self) -> str | None:
        """The number of the current version; None before the first."""
        return max((n for n in self._listed(f"{self.path}/versions") if n.isdigit()), default=None)

    def _manifest(self, version: str) -> dict:
        p, store = self._file(f"{self.path}/versions/{version}")
        stream = store.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, after: str | None, manifest: dict) -> str:
        """Make the manifest the version after `after`; fails if another writer was first."""
        now = f"{int(after or 0) + 1:012d}"
        p, store = self._file(f"{self.path}/versions/{now}")
        tmp, _ = self._file(f"{self.path}/versions/.{now}-{uuid.uuid4().hex}")
        out = store.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if store.exists(p) or not store.rename(tmp, p):
            store.delete(tmp, False)
            raise RuntimeError(f"version {now} of {self.path} was written by someone else")
        return now

    def _bucket(self, buckets: int) -> F.Column:
        return F.pmod(F.xxhash64("source_path"), F.lit(buckets)).cast("int")

    def _folders(self, manifest: dict, some: set[int] | None = None) -> DataFrame:
        kind = T.StructType.fromJson(manifest["schema"])
        found = [f"{self.path}/{folder}/__bucket={b}" for b, folder in manifest["folders"].items() if some is None or int(b) in some]
        return self.spark.read.schema(kind).parquet(*found) if found else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame | None:
        now = self.version()
        return self._folders(self._manifest(now)) if now else None

    def count(self) -> int:
        """Rows of the current version, counted without reading a column; 0 before the first."""
        table = self.read()
        return 0 if table is None else table.count()

    def _write(self, df: DataFrame, buckets: int) -> dict[str, str]:
        """Write df and give the folder of each bucket that got a row."""
        folder = f"data-{uuid.uuid4().hex}"
        bucket = df.withColumn("__bucket", self._bucket(buckets))
        bucket.repartition("__bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        return {n.removeprefix("__bucket="): folder for n in self._listed(f"{self.path}/{folder}") if n.startswith("__bucket=")}

    def replace(self, df: DataFrame) -> str:
        after = self.version()
        return self._publish(after, {"schema": df.schema.jsonValue(), "buckets": self.buckets, "folders": self._write(df, self.buckets)})

    def upsert(self, fresh: DataFrame, gone: DataFrame | None = None) -> str:
        """Replace every file of `fresh` and drop those of `gone`; fresh is read twice."""
        after = self.version()
        if after is None:
            return self.replace(fresh.dropDuplicates(["chunk_id"]))
        old = self._manifest(after)
        paths = fresh.select("source_path") if gone is None else fresh.select("source_path").unionByName(gone.select("source_path"))
        touched = {r[0] for r in paths.select(self._bucket(old["buckets"])).distinct().collect()}  # at most a row a bucket
        if not touched:
            return after
        made = upserted(self._folders(old, touched), fresh, gone)
        folders = {b: f for b, f in old["folders"].items() if int(b) not in touched} | self._write(made, old["buckets"])
        return self._publish(after, {"schema": made.schema.jsonValue(), "buckets": old["buckets"], "folders": folders})

    def reset(self, schema) -> str:
        return self.replace(self.spark.createDataFrame([], schema))

    def vacuum(self) -> None:
        """Delete what the current version doesn't use; without one nothing is deleted."""
        now = self.version()
        if now is None:
            raise RuntimeError(f"{self.path} has no current version")
        used = set(self._manifest(now)["folders"].values())
        for name in self._listed(self.path):
            if name.startswith("data-") and name not in used:
                p, store = self._file(f"{self.path}/{name}")
                store.delete(p, True)
        for name in self._listed(f"{self.path}/versions"):
            if name.isdigit() and name < now:
                p, store = self._file(f"{self.path}/versions/{name}")
                store.delete(p, False)


@contextlib.contextmanager
def staged(store: VersionedTable, df: DataFrame | None) -> Iterator[DataFrame | None]:
    """df as a table in a folder of its own beside the store's, deleted afterwards; so it is worked out once."""
    if df is None:
        yield None
        return
    path = f"{store.path}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield store.spark.read.schema(df.schema).parquet(path)
    finally:
        p, files = store._file(path)
        files.delete(p, True)
