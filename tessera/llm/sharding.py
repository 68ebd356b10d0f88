"""Resharding by minimum-cost flow: new shards of near equal bytes, with as few bytes moved as there can be.

A layout is a folder of block files and a manifest that says which shard each file belongs to. A block holds rows of one shard, dealt by a hash of id
and text, so blocks of a shard are alike. Resharding knows old shard sizes and new capacities:

1. The flow of bytes from old to new shards of the least total cost is found on the driver by successive shortest paths. Costs are those of one byte
   from shard to shard; by default staying costs nothing and moving one.
2. Each shard's blocks are laid along its flows. A block that lies in one flow goes there whole: its file stays where it is and only the manifest
   changes. The blocks that two flows meet in, fewer than there are flows, are split.
3. Only split files are rewritten: in one task each, documents are dealt by falling size to the part that still lacks most, so that parts
   come as near to their bytes as the block's smallest documents allow.
4. The new manifest is written, then files that were split are removed.

The driver holds one row for each block, of which there are at most MAX_BLOCKS since blocks grow with the table beyond that, and the flow, of which the size is
the number of old times that of new shards. A task holds two numbers for each document of one split block. Texts are shuffled when a layout is first written; afterwards only
those of split blocks are.

Edge cases
----------
* a null text has no bytes; a document's size is its bytes and one more, so empty texts count too;
* null ids, repeated ids and repeated rows: each row is placed for itself; rows equal in id and text share a block;
* fewer documents than shards, or one document larger than a shard: sizes are as near as whole documents allow, some shards stay empty;
* shards that hold a third of all rows have more blocks, not larger ones; shards that the new layout does not have give everything away;
* an empty table: a layout without blocks and an empty result; all columns are kept, whatever their names (but for those that begin with ``__tessera_``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .scratch import Scratch, shared_dir

#: Bytes of one block; smaller ones where a shard has fewer than BLOCKS, as long as they have some BLOCK_ROWS documents.
BLOCK_BYTES, BLOCKS, BLOCK_ROWS = 128 << 20, 64, 2000
MAX_BLOCKS = 1 << 20
#: Tasks that write blocks.
WRITERS = 1 << 15
SIZE, SHARD, SLOT, BLOCK, FILE, ROW, TO = (f"__tessera_{x}" for x in ("size", "shard", "slot", "block", "file", "row", "to"))


def least_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """How much goes from each source to each target, all supplies within the capacities at the least total cost (whole numbers, none negative).

    By default a source with the number of a target costs nothing there, and one for each unit elsewhere.
    """
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    if left.sum() > room.sum():
        raise ValueError("capacities are less than supplies")
    m, n = len(left), len(room)
    cost = 1 - np.eye(m, n, dtype=np.int64) if cost is None else np.asarray(cost, np.int64)
    flow, never = np.zeros((m, n), np.int64), np.int64(1) << 60
    while left.any():
        # Shortest paths from any source with something left; flows may be taken back.
        out, into = np.where(left > 0, 0, never), np.full(n, never)
        from_target, from_source = np.full(m, -1), np.full(n, -1)
        while True:
            through = out[:, None] + cost
            near = through.min(axis=0)
            better = near < into
            into[better], from_source[better] = near[better], through.argmin(axis=0)[better]
            back = np.where(flow > 0, into[None, :] - cost, never)
            near = back.min(axis=1)
            better = near < out
            if not better.any():
                break
            out[better], from_target[better] = near[better], back.argmin(axis=1)[better]
        j = int(np.where(room > 0, into, never).argmin())
        end, path = j, []
        while True:
            i = int(from_source[j])
            path.append((i, j, 1))
            if from_target[i] < 0:
                break
            j = int(from_target[i])
            path.append((i, j, -1))
        amount = min(int(left[i]), int(room[end]), *(int(flow[a, b]) for a, b, sign in path if sign < 0))
        for a, b, sign in path:
            flow[a, b] += sign * amount
        left[i] -= amount
        room[end] -= amount
    return flow


@dataclass(frozen=True)
class Block:
    file: str
    shard: int
    rows: int
    bytes: int


@dataclass(frozen=True)
class Layout:
    """The blocks under ``root``, in the order in which their documents are numbered within a shard, as the manifest of that version has them."""

    spark: SparkSession
    root: str
    version: int
    folders: tuple[str, ...]
    schema: StructType
    blocks: tuple[Block, ...]

    def sizes(self, shards: int) -> list[int]:
        out = [0] * shards
        for b in self.blocks:
            out[b.shard] += b.bytes
        return out

    def _read(self, *paths: str) -> DataFrame:
        kept = StructType([*self.schema.fields, StructField(SIZE, LongType())])
        found = self.spark.read.schema(kept).option("recursiveFileLookup", "true").parquet(*paths)
        return found.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))

    def documents(self) -> DataFrame:
        """All documents with their columns, SHARD and SLOT, their number within the shard from 0."""
        if not self.blocks:
            return self.spark.createDataFrame([], self.schema).select("*", F.lit(0).alias(SHARD), F.lit(0).cast("long").alias(SLOT))
        base, rows = {}, []
        for b in self.blocks:
            rows.append((b.file, b.shard, base.get(b.shard, 0)))
            base[b.shard] = base.get(b.shard, 0) + b.rows
        # At most MAX_BLOCKS rows and as many split parts.
        placed = F.broadcast(self.spark.createDataFrame(rows, f"{FILE} string, {SHARD} int, __tessera_base long"))
        found = self._read(*self.folders).join(placed, FILE)
        return found.select(*(F.col(f"`{c}`") for c in self.schema.names), SHARD, (F.col("__tessera_base") + F.col(ROW)).alias(SLOT))

    def saved(self) -> Layout:
        rows = [(b.file, b.shard, b.rows, b.bytes) for b in self.blocks]
        table = self.spark.createDataFrame(rows, "file string, shard int, rows long, bytes long").coalesce(1)
        # One file appears at once or not at all.
        table.write.mode("overwrite").parquet(f"{self.root}/manifest/version={self.version}")
        return self

    def then(self, blocks: list[Block], *folders: str) -> Layout:
        return Layout(self.spark, self.root, self.version + 1, (*self.folders, *folders), self.schema, tuple(sorted(blocks, key=lambda b: b.shard))).saved()

    def written(self, rows: DataFrame, parts: int) -> tuple[str, list[Block]]:
        """Writes rows with their SIZE, SHARD and BLOCK, a file for each block; returns the folder and its blocks."""
        at = f"{self.root}/blocks/{self.version + 1:06d}"
        Scratch.save(rows.repartition(min(parts, WRITERS), SHARD, BLOCK).sortWithinPartitions(SHARD, BLOCK), at, SHARD, BLOCK)
        kept = StructType([StructField(SIZE, LongType()), StructField(SHARD, IntegerType()), StructField(BLOCK, IntegerType())])
        found = self.spark.read.schema(kept).parquet(at).groupBy(F.col("_metadata.file_path").alias("file"), SHARD, BLOCK)
        listed = found.agg(F.count("*").alias("rows"), F.sum(SIZE).alias("bytes")).orderBy(SHARD, BLOCK, "file").collect()
        return at, [Block(r["file"], r[SHARD], r["rows"], r["bytes"]) for r in listed]


def write_shards(docs: DataFrame, shard: Column, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> Layout:
    """Writes ``docs`` as a layout; ``shard`` is each row's shard, numbered from 0."""
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    empty = Layout(spark, root, 0, (), docs.schema, ())
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + 1
    rows = docs.select("*", size.alias(SIZE), shard.cast("int").alias(SHARD))
    sizes = {r[SHARD]: (r["n"], r["b"]) for r in rows.groupBy(SHARD).agg(F.count("*").alias("n"), F.sum(SIZE).alias("b")).collect()}
    if not sizes:
        return empty.then([])
    block_bytes = max(block_bytes, 2 * sum(b for _, b in sizes.values()) // MAX_BLOCKS)
    blocks = [max(1, -(-b // block_bytes), min(BLOCKS, n // block_rows)) for n, b in (sizes.get(k, (0, 0)) for k in range(max(sizes) + 1))]
    number = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.element_at(F.array(*map(F.lit, blocks)), F.col(SHARD) + 1).cast("long")).cast("int")
    at, found = empty.written(rows.withColumn(BLOCK, number), sum(blocks[k] for k in sizes))
    return empty.then(found, at)


def open_layout(spark: SparkSession, root: str, schema: StructType) -> Layout:
    """The layout of the last manifest under ``root``; what a run without a manifest of its own left is not part of it."""
    found = spark.read.parquet(f"{root}/manifest")
    version = found.agg(F.max("version")).first()[0]
    rows = found.filter(F.col("version") == version).select("file", "shard", "rows", "bytes").collect()
    blocks = [Block(*r) for r in rows]
    folders = sorted({b.file.rsplit("/", 3)[0] for b in blocks})
    return Layout(spark, root, int(version), tuple(folders), schema, tuple(blocks))


def plan_blocks(blocks: tuple[Block, ...], flow: np.ndarray) -> tuple[list[Block], dict[str, list[tuple[int, int]]]]:
    """The blocks that stay whole, with their new shard, and for the others the parts (new shard, bytes) to be made of them."""
    whole, split = [], {}
    todo = {i: [[j, int(flow[i, j])] for j in sorted(np.flatnonzero(flow[i]).tolist(), key=lambda j: (j != i, j))] for i in range(len(flow))}
    for b in blocks:
        parts, left, flows = [], b.bytes, todo[b.shard]
        while left:
            take = min(left, flows[0][1])
            parts.append((flows[0][0], take))
            left -= take
            flows[0][1] -= take
            if not flows[0][1]:
                flows.pop(0)
        if len(parts) == 1:
            whole.append(Block(b.file, parts[0][0], b.rows, b.bytes))
        else:
            split[b.file] = parts
    return whole, split


def deal(sizes: np.ndarray, amounts: list[int]) -> np.ndarray:
    """A part for each document: by falling size, each goes to the part that still lacks most."""
    left, out = list(amounts), np.zeros(len(sizes), np.int64)
    for at in np.argsort(-sizes, kind="stable").tolist():
        k = max(range(len(left)), key=left.__getitem__)
        out[at] = k
        left[k] -= int(sizes[at])
    return out


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def reshard(layout: Layout, capacities: list[int], cost: np.ndarray | None = None) -> Layout:
    """The layout with as many shards as there are capacities (in bytes, one for each document added), moved from ``layout`` at the least cost."""
    spark, shards = layout.spark, max([len(capacities), *(b.shard + 1 for b in layout.blocks)])
    flow = least_cost_flow(layout.sizes(shards), capacities, cost)
    whole, split = plan_blocks(layout.blocks, flow)
    if not split:
        return layout.then(whole)
    number = {file: k for k, file in enumerate(split)}

    def dealt(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ROW)
        parts = split[rows[FILE].iloc[0]]
        to = np.array([j for j, _ in parts])[deal(rows[SIZE].to_numpy(), [n for _, n in parts])]
        return pd.DataFrame({FILE: rows[FILE], ROW: rows[ROW], TO: to.astype(np.int32)})

    rows = layout._read(*split)
    chosen = rows.select(FILE, ROW, SIZE).groupBy(FILE).applyInPandas(dealt, f"{FILE} string, {ROW} long, {TO} int")
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), f"{FILE} string, {BLOCK} int"))
    placed = rows.join(chosen, [FILE, ROW]).join(numbers, FILE).withColumnRenamed(TO, SHARD).drop(FILE, ROW)
    at, found = layout.written(placed, sum(map(len, split.values())))
    new = layout.then([*whole, *found], at)
    Scratch(spark, "split").drop(*split)
    return new


def resharded(docs: DataFrame, shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` laid out by the old ``shard`` and moved to ``shards`` of equal bytes: all columns, SHARD and SLOT."""
    layout = write_shards(docs, shard, None, id_col, text_col, **options)
    return reshard(layout, equal_capacities(sum(b.bytes for b in layout.blocks), shards)).documents()
