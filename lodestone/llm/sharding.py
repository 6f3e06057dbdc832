"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Documents and virtual nodes have positions on one ring; a document belongs to the next virtual node clockwise, and goes
on clockwise past shards that are full. The bounds are the exact equal shares, so counts differ by one at most. Only
counts of documents between neighbouring virtual nodes, whose number is a parameter, reach the driver; from these follow
the runs of ring order that each shard takes. A document's rank in ring order then gives both its shard and its slot.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.rows import packed, unpacked

SHARDS = 8
VIRTUAL_NODES = 128
#: Rows of one sorting unit; their number grows with the input, not their size.
CELL_ROWS = 5_000
LAW = "rows"
RING_BITS = 60


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in ascending order, and their shards. A shard's positions don't depend on how many others there are."""
    shard = np.repeat(np.arange(shards), virtual_nodes)
    at = np.array([int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:15], 16) for s in range(shards) for v in range(virtual_nodes)], dtype=np.int64)
    order = np.lexsort((shard, at))
    return at[order], shard[order]


def runs(counts: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, shard, first slot) of each run of ring order, from the counts per arc, the owner of each virtual node and each shard's bound."""
    left, used, first, shards, slots, at = bounds.copy(), np.zeros_like(bounds), [], [], [], 0
    for arc, n in enumerate(counts):
        node = arc
        while n > 0:
            shard = owner[node % len(owner)]
            take = min(n, left[shard])
            if take > 0:
                first.append(at)
                shards.append(shard)
                slots.append(used[shard])
                left[shard] -= take
                used[shard] += take
                at, n = at + take, n - take
            node += 1
    return np.array(first, dtype=np.int64), np.array(shards, dtype=np.int32), np.array(slots, dtype=np.int64)


def position_of(doc_id: str, text: str) -> Column:
    """A document's place on the ring, RING_BITS bits of a digest of its id; texts place documents without one, so that these spread too."""
    digest = F.coalesce(F.md5(F.col(doc_id).cast("string")), F.md5(F.concat(F.lit("text:"), F.coalesce(F.col(text).cast("string"), F.lit("")))))
    return F.conv(F.left(digest, F.lit(RING_BITS // 4)), 16, 10).cast("long")


def equal_bounds(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def assign(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with shard_ and slot_, size_ (UTF-8 bytes plus 1) and crc_ added, or replaced; needs doc_id and text.

    Of the input's columns only ``columns`` go along, if given. With ``slack`` each shard may hold that share above the equal one, and fewer documents move when shards are added;
    counts may then differ by more than one. A null text has size 1; rows without an id are placed by their text. Repeated
    rows are separate documents at one place, in any order. Very long texts stay whole. No rows give no rows.
    """
    place_of = position_of("doc_id", "text")
    position, owner = ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(position, at.to_numpy(), "left").astype(np.int32))

    held = {x.arc: x.n for x in docs.select(arc(place_of).alias("arc")).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    counts = np.array([held.get(i, 0) for i in range(len(position) + 1)], dtype=np.int64)
    rows = int(counts.sum())
    bounds = equal_bounds(rows, shards) if not slack else np.full(shards, math.ceil((1 + slack) * rows / shards), dtype=np.int64)
    first, shard, slot = runs(counts, owner, bounds)

    @F.pandas_udf("shard int, slot long")
    def place(rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(first, rank.to_numpy(), "right") - 1
        return pd.DataFrame({"shard": shard[at], "slot": slot[at] + rank.to_numpy() - first[at]})

    fine = max(0, math.ceil(math.log2(max(1, rows / CELL_ROWS))))
    coarse = min(fine, 10)

    def top(bits: int) -> Column:
        return F.shiftright("at", RING_BITS - bits) if bits else F.lit(0).cast("long")

    cells = docs.select(place_of.alias("at")).groupBy(top(coarse).alias("part"), top(fine).alias("cell")).agg(F.count("*").alias("n"))
    parts = cells.groupBy("part").agg(F.sum("n").alias("n")).withColumn("parts_before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    cells = cells.withColumn("cells_before", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = cells.join(parts, "part").select("cell", (F.col("parts_before") + F.col("cells_before")).alias("offset"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = packed(docs, columns, at=place_of, id=F.col("doc_id"), size=F.octet_length(text).cast("long") + F.lit(1).cast("long"), crc=F.crc32(text.cast("binary"))).withColumn("cell", top(fine))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("at", "id", "crc", "size"))).join(offsets, "cell")
    placed = ranked.withColumn("to", place(F.col("offset") + F.col("rank") - 1))
    return unpacked(placed, columns or docs.columns, size_=F.col("size"), crc_=F.col("crc"), shard_=F.col("to.shard"), slot_=F.col("to.slot"))
