"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. A group's documents are dealt to cells by a hash, so that no
group, however large, is handled in one piece. Each round joins the cells with how their group is
spread over shards now and moves cells to the shard where most of their neighbours are, as far as
that shard's quota has room; the quotas are wide at first and tighten round by round. Shards that are
over their share in the end give up whole groups (of groups too large for that, cells), and these and
the documents without links fill what room there is, the larger ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written

#: Cells that a group can be split into.
CELLS = 4_096
#: Buckets in which moves are accepted and the line is summed.
BUCKETS = 1024


def _bucket(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


#: Groups up to a shard's quota over this move whole.
WHOLE = 8
#: By what share of its quota a shard may be overfull, round by round; the last is repeated.
SLACK = (1.0, 0.5, 0.25, 0.125)


def _spot(quota: int) -> Column:
    """The bucket in which a group moves: of one too large to move whole, each cell's own."""
    return F.when(F.col("all") * WHOLE > F.lit(quota), _bucket(F.col("grp"), F.col("sub"))).otherwise(_bucket(F.col("grp")))


def propagate(cells: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """cells(grp, sub, bytes, all, shard) after label propagation under quotas of bytes a shard that tighten; all: the group's bytes."""
    for turn in range(rounds):
        limit = int(quota * (1 + SLACK[min(turn, len(SLACK) - 1)]))
        load = cells.groupBy("shard").agg(F.sum("bytes").alias("load"))
        spread = cells.groupBy("grp", "shard").agg(F.sum("bytes").alias("here"), F.max("all").alias("all"))
        split = spread.where("here < all")
        room = F.greatest(F.lit(limit) - F.col("load"), F.lit(0))
        # a shard that can take the rest of the group comes first, then where most of it is
        fits = F.col("all") - F.col("here") <= room
        rank = F.struct(fits.alias("fits"), F.when(fits, F.col("here")).otherwise(room).alias("gain"), F.xxhash64("grp", "shard").alias("tie"))
        best = split.join(F.broadcast(load), "shard").groupBy("grp").agg(F.max_by("shard", rank).alias("to"))  # load: a row a shard
        moves = cells.join(best, "grp").where("shard <> to").select("grp", "sub", "bytes", "to", _spot(quota).alias("b"))
        taken = moves.groupBy("to", "b").agg(F.sum("bytes").alias("inn")).withColumn("cum", F.sum("inn").over(Window.partitionBy("to").orderBy("b")))
        accepted = taken.join(F.broadcast(load.withColumnRenamed("shard", "to")), "to", "left").where(F.col("cum") <= F.greatest(F.lit(limit) - F.coalesce(F.col("load"), F.lit(0)), F.lit(0))).select("to", "b")
        go = moves.join(F.broadcast(accepted), ["to", "b"]).select("grp", "sub", "to")  # at most shards x BUCKETS rows
        cells = written(cells.join(go, ["grp", "sub"], "left").select("grp", "sub", "bytes", "all", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved")), "cells")
        if cells.where("moved").isEmpty():
            break
        cells = cells.drop("moved")
    return cells.select("grp", "sub", "bytes", "all", "shard")


def relieve(cells: DataFrame, quota: int) -> DataFrame:
    """cells with a null shard where one gives them up.

    An overfull shard gives up buckets of whole groups until it is within its quota; groups that could
    move whole but are still split, as no shard had room for the rest, are given up by all.
    """
    spread = cells.groupBy("grp", "shard").agg(F.sum("bytes").alias("here"), F.max("all").alias("all"))
    split = spread.where((F.col("here") < F.col("all")) & (F.col("all") * WHOLE <= quota)).select("grp").distinct().withColumn("split", F.lit(True))
    spot = written(cells.join(split, "grp", "left").withColumn("b", _spot(quota)), "spots")
    sums = spot.where("split is null").groupBy("shard", "b").agg(F.sum("bytes").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("shard").orderBy("b")) - F.col("sum")  # shards x BUCKETS rows
    excess = F.sum("sum").over(Window.partitionBy("shard")) - quota
    leave = sums.withColumn("before", before).withColumn("excess", excess).where("before < excess").select("shard", "b", F.lit(True).alias("leaves"))
    stays = F.col("leaves").isNull() & F.col("split").isNull()
    return spot.join(F.broadcast(leave), ["shard", "b"], "left").select("grp", "sub", "bytes", "all", F.when(stays, F.col("shard")).alias("shard"))


def fill(df: DataFrame, rooms: list[int], columns: list[str]) -> DataFrame:
    """(columns, shard): df(columns, size) stands in line and is cut in proportion to rooms.

    An item goes where its middle byte lies, so each shard is within one item's size of its share. The
    place in line is by a hash, in as many buckets as keep a bucket's rows few.
    """
    order = F.xxhash64(*columns)
    df = df.withColumn("b", _bucket(*map(F.col, columns)))
    sums = df.groupBy("b").agg(F.sum("size").alias("sum"))
    total = F.sum("sum").over(Window.partitionBy())
    start = sums.select("b", (F.sum("sum").over(Window.orderBy("b")) - F.col("sum")).alias("start"), total.alias("total"))  # a row a bucket
    local = F.sum("size").over(Window.partitionBy("b").orderBy(order, *columns).rowsBetween(Window.unboundedPreceding, 0))
    share = (F.col("start") + local - F.col("size") / 2) / F.greatest(F.col("total"), F.lit(1))
    span, at, to = max(1, sum(rooms)), 0, F.lit(len(rooms) - 1)
    if len(rooms) > 1:
        to = F
        for k, room in enumerate(rooms[:-1]):
            at += room
            to = to.when(F.col("share") < at / span, F.lit(k))
        to = to.otherwise(F.lit(len(rooms) - 1))
    return df.join(F.broadcast(start), "b").withColumn("share", share).select(*columns, "size", to.cast("int").alias("shard"))


def _filled(df: DataFrame, rooms: list[int], columns: list[str], mean: float, name: str) -> DataFrame:
    """fill() with what is above the mean first and the rest into the room left; rooms are brought down in place."""
    out = None
    for part in (df.where(F.col("size") > mean), df.where(F.col("size") <= mean)):
        cut = written(fill(part, [max(x, 0) for x in rooms], columns), name)
        for r in cut.groupBy("shard").agg(F.sum("size").alias("load")).collect():  # a row a shard
            rooms[r["shard"]] -= r["load"]
        out = cut if out is None else out.unionByName(cut)
    return out


def shard(docs: DataFrame, shards: int = 16, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is `bytes`.

    Size: UTF-8 bytes of the text plus 1; a null text has size 1, checksum 0 and is linked to other nulls,
    not to empty texts. Rows with the same id are rows of their own, in adjoining slots. An empty table
    gives none; other columns are ignored. grown_shard is null: adding a shard deals everything anew.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("grp"),
        F.pmod(F.xxhash64(id_col), F.lit(CELLS)).cast("int").alias("sub"),
    )
    base = written(base, "sizes")
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    quota, mean = max(1, -(-total // shards)), total / max(1, rows)
    cells = base.groupBy("grp", "sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    linked = cells.groupBy("grp").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("all")).where("rows > 1")
    cells = written(cells.join(linked, "grp").select("grp", "sub", "bytes", "all", F.pmod("sub", F.lit(shards)).alias("shard")), "cells")
    done = written(relieve(propagate(cells, shards, quota, rounds), quota), "relieved")
    loads = {r["shard"]: r["load"] for r in done.where("shard is not null").groupBy("shard").agg(F.sum("bytes").alias("load")).collect()}  # a row a shard
    rooms = [quota - loads.get(k, 0) for k in range(shards)]
    # what was given up stays together: a group that moves whole is one item, of a larger one each cell
    item = F.when(F.col("all") * WHOLE > quota, F.col("sub")).otherwise(F.lit(-1))
    loose = done.where("shard is null").withColumn("item", item)
    items = loose.groupBy("grp", "item").agg(F.sum("bytes").alias("size"))
    typical = items.agg(F.coalesce(F.avg("size"), F.lit(0.0))).first()[0]
    placed = _filled(items, rooms, ["grp", "item"], typical, "placed").drop("size")
    kept = done.where("shard is not null").select("grp", "sub", "shard").unionByName(loose.select("grp", "sub", "item").join(placed, ["grp", "item"]).select("grp", "sub", "shard"))
    dealt = written(base.join(kept, ["grp", "sub"], "left").select(id_col, "size", "text_crc32", "shard"), "dealt")
    free = _filled(dealt.where("shard is null").drop("shard"), rooms, [id_col, "text_crc32"], mean, "free")
    out = written(dealt.where("shard is not null").unionByName(free), "shards")
    out = numbered(out, ["shard"], [id_col, "text_crc32"], "slot", rows)
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
