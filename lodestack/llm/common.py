"""What several operators share: tables in the shared folder, numbering, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the word contracts define it: blank and the five controls from tab on.
WORD_BREAKS = r"[\x20\x09-\x0D]+"

#: Rows of a bucket of numbered(), on average.
BUCKET_ROWS = 50_000

_roots: dict[str, str] = {}
_paths: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The application's own folder under spark.checkpoint.dir.

    Where that is unset, a temporary one if all of Spark runs on this machine, and else an error: other
    machines wouldn't see it. The folder goes when the driver's Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = f"file://{tempfile.mkdtemp(prefix='lodestack-')}"
        _roots[app] = f"{base.rstrip('/')}/lodestack-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs that nothing refers to any more, rather than when memory runs short."""
    gc.collect()
    spark._jvm.System.gc()


def trimmed() -> None:
    """Give memory that this process has freed back to the machine; a worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def fresh_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def mark() -> int:
    """Where the list of folders made so far ends."""
    return len(_paths)


def dropped(spark: SparkSession, since: int, *names: str, but: int = 0) -> None:
    """Delete the folders of these names that were made since a mark, but for the last `but` of them; nothing may read them any more."""
    gone = [p for p in _paths[since:] if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] in names]
    for path in gone[: len(gone) - but]:
        _remove(spark, path)
        _paths.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and losing executors costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Add `name`: the row's number from 0 within its group, whole groups never meeting in one task.

    rows: how many df has. They are dealt to buckets of BUCKET_ROWS on average by a hash of the order
    columns, numbered there, and moved up by the rows of the buckets before; the table of counts has at
    most groups x buckets rows. Rows equal in all order columns may swap numbers. df is read twice, so
    pass a written table.
    """
    b, buckets = "__bucket", max(256, rows // BUCKET_ROWS)
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*group, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1
    return df.withColumn(name, local).join(base, [*group, b]).withColumn(name, F.col(name) + F.col("__base")).drop(b, "__base")


#: Of all rows, a key with more than one in HOT_SHARE is hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 10_000, 1_000


def looked_up(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, in which a key is unique; no key's rows of left meet in one task.

    rows: how many left has. The entries of hot keys, fewer than HOT_SHARE, are broadcast; all others are
    joined by a shuffle, where a key has rows / HOT_SHARE rows at most. Keys are not null. Pass written tables.
    """
    many = left.groupBy(key).count().where(F.col("count") > max(HOT_ROWS, rows // HOT_SHARE)).select(key)
    keys = many.collect()  # fewer than HOT_SHARE
    if not keys:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(keys, many.schema))
    columns = left.join(right, key, how).columns
    one = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return one.select(columns).unionByName(left.join(hot, key, "left_anti").join(right, key, how).select(columns))


#: Keys that are sent to all tasks rather than met by a shuffle, at most.
BROADCAST_KEYS = 500_000


def picked(left: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows of left whose key is among keys, a written table, or (left_anti) isn't; few keys spare left the shuffle."""
    return left.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


#: Edges that are joined to trees in one task.
EDGES_TOGETHER = 250_000


def _trees(edges: DataFrame, parts: int) -> DataFrame:
    """Star edges (u, v), v the smallest node, of the components that edges(u, v) have within each of so many parts by u."""

    def join(table: pa.Table) -> pa.Table:
        up: dict = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        return pa.table({"u": pa.array(nodes, table.schema.field("u").type), "v": pa.array(map(root, nodes), table.schema.field("v").type)})

    part = F.pmod(F.xxhash64("u"), F.lit(parts)).alias("part")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    return edges.select(part, "u", "v").groupBy("part").applyInArrow(lambda t: join(t), kinds)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges(u, v): (node, root) of every node, root the smallest reachable.

    Parts of EDGES_TOGETHER edges become trees in one task each. Where that is more than one part,
    alternating large-star and small-star steps follow, each two joins on aggregated minima, until the
    edges no longer change; every step is written to the shared folder. Neighbour lists are never gathered,
    and the edges of a hub stay where they are. Loops and repeated edges are allowed; nulls are not.
    """
    def size(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    began = mark()
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    parts = -(-e.count() // EDGES_TOGETHER)
    if parts:
        e = written(_trees(e, parts), name)
    was = size(e) if parts > 1 else (0,)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = looked_up(both, least, "u", 2 * was[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = looked_up(large, least, "u", was[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        e = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        now = size(e)
        dropped(edges.sparkSession, began, name, but=1)
        if now == was:
            break
        was = now
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
