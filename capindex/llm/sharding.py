"""Sharding by extendible hashing: a directory indexed by hash-prefix bits.

Rows fall into buckets by the leading bits of a hash of their id. A bucket over its byte limit splits on the next
bit, the others stay, until every bucket fits; so a shard's name is the bit string that its rows share, and later
rows are placed by looking up the directory.

Bits come from three hashes in turn: of the id, of the text (rows that share an id), and of a row number (equal rows).
A single row over the limit is a shard of its own.

Scale: rows are staged as (id, bytes, hashes). Byte counts of fine cells (``SPARE`` bits more than the mean shard
needs) are one aggregation with partial sums; all splits are then decided on the cells, level by level, without
touching rows again. Only the rows of cells that are still too large are counted again, ``MORE`` bits deeper. Cells
and directory stay DataFrames; the driver sees a total and a count per level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import broadcast_if_small, stage, text_or_empty

BITS = 60
SPARE, MORE = 3, 8
SHARD_BYTES = 1 << 20


def _bits(text: Column) -> Column:
    """The first 60 bits of the md5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def _top(h: str, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _cells(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    return rows.groupBy("root", _top("h", depth).alias("cell")).agg(
        F.sum("n_bytes").alias("bytes"), (F.min("h") == F.max("h")).alias("one")).withColumn(
        "deeper", (F.col("bytes") > limit) & ~F.col("one")).withColumn("depth", F.lit(depth))


def _directory(levels: list[DataFrame], limit: int) -> DataFrame:
    """(root, level, cell, shard, depth, shard_bytes, stuck) of each cell that is not counted deeper.

    A node of the prefix tree is a shard if it fits and its parent does not, or if it holds one hash only.
    """
    cells = levels[0]
    for more in levels[1:]:
        cells = cells.unionByName(more)
    cells = cells.where(~F.col("deeper")).select("root", F.col("depth").alias("level"), "cell", "bytes", "one")
    paths = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumn(
        "p", F.expr("shiftright(cell, level - d)"))
    nodes = paths.groupBy("root", "d", "p").agg(F.sum("bytes").alias("node_bytes"))
    fits = paths.join(nodes, ["root", "d", "p"]).where(F.col("node_bytes") <= limit)
    best = fits.groupBy("root", "level", "cell").agg(F.min(F.struct("d", "p", "node_bytes")).alias("s"))
    out = cells.join(best, ["root", "level", "cell"], "left")
    depth, p = F.coalesce("s.d", "level"), F.coalesce("s.p", "cell")
    bits = F.when(depth == 0, "").otherwise(F.lpad(F.bin(p), depth, F.lit("0")))
    return out.select("root", "level", "cell", F.concat("root", bits).alias("shard"), depth.alias("depth"),
                      F.coalesce("s.node_bytes", "bytes").alias("shard_bytes"), F.col("s").isNull().alias("stuck"))


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (root, h, n_bytes, ...) with shard, depth, shard_bytes and stuck (over the limit, one hash)."""
    largest = rows.groupBy("root").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, largest / limit)))) + SPARE)
    levels = [stage(_cells(rows, depth, limit), "shard-cells")]
    while levels[-1].where("deeper").count() and depth < BITS:
        over = broadcast_if_small(levels[-1].where("deeper").select("root", "cell"), 32)
        rest = rows.withColumn("cell", _top("h", depth)).join(over, ["root", "cell"], "left_semi").drop("cell")
        depth = min(BITS, depth + MORE)
        levels.append(stage(_cells(rest, depth, limit), "shard-cells"))
    directory = broadcast_if_small(stage(_directory(levels, limit), "shard-directory"), 64)
    depths = sorted({r[0] for r in directory.select("level").distinct().collect()}) or [depth]
    out = rows.withColumn("__at", F.array(*[F.struct(F.lit(d).alias("level"), _top("h", d).alias("cell")) for d in depths]))
    if len(depths) == 1:
        out = out.withColumn("__at", F.col("__at")[0])
    else:
        out = out.withColumn("__at", F.explode("__at"))
    return out.select("*", "__at.*").drop("__at").join(directory, ["root", "level", "cell"]).drop("level", "cell")


def shard(df: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key, n_bytes of its text, its shard, the shard's depth and shard_bytes.

    Null keys hash as the empty string; null texts have 0 bytes. An empty table has no shards. Shards hold at most
    ``limit`` bytes unless they hold a single row.
    """
    return _place(df, limit, key, text, key)


def _place(df: DataFrame, limit: int, key: str, text: str, tag: str) -> DataFrame:
    """``shard`` with the column ``tag`` of each row in place of its key."""
    if limit < 1:
        raise ValueError("limit must be at least one byte")
    body = text_or_empty(F.col(f"`{text}`"))
    rows = stage(df.select(
        F.col(f"`{tag}`").alias("key"), F.octet_length(body).cast("bigint").alias("n_bytes"), F.lit("").alias("root"),
        _bits(text_or_empty(F.col(f"`{key}`"))).alias("h"), _bits(body).alias("h1"),
        _bits(F.monotonically_increasing_id().cast("string")).alias("h2")), "shard-rows")
    done, rest = [], rows
    for follow in ("h1", "h2", None):
        placed = _split(rest, limit)
        if follow is None:
            done.append(placed)
            break
        placed = stage(placed, "shard-placed")
        # One row alone can't be split; several rows of one hash go on with the next hash.
        many = placed.where("stuck").groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard")
        many = stage(many, "shard-stuck")
        if not many.count():
            done.append(placed)
            break
        many = broadcast_if_small(many, 80)
        done.append(placed.join(many, "shard", "left_anti"))
        rest = placed.join(many, "shard", "left_semi").select("key", "n_bytes", F.col("shard").alias("root"),
                                                              F.col(follow).alias("h"), "h1", "h2")
    out = done[0].select("key", "n_bytes", "shard", "depth", "shard_bytes")
    for more in done[1:]:
        out = out.unionByName(more.select("key", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes"))
    return out.select(F.col("key").alias(tag), "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes")


def write_shards(df: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """``df`` as Parquet, one folder per shard (``shard=<bits>``), each row once, whether or not keys repeat or are null.

    Rows are numbered in a staged copy and joined with their places by number. A column of the name ``shard`` is left out.
    """
    row = "__row"
    while row in df.columns:
        row += "_"
    rows = stage(df.withColumn(row, F.monotonically_increasing_id()), "shard-numbered")
    places = _place(rows, limit, key, text, row).select(row, F.concat(F.lit("b"), "shard").alias("shard"))
    out = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "shard"]).join(places, row).drop(row)
    out.repartition("shard").write.partitionBy("shard").parquet(path)
