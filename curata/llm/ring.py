"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 64
#: Rows of one value that are numbered at a time.
BLOCK = 65_536


def _cell(key: list[Column], cell_bits: int, seed: int) -> Column:
    """The ring's cell on which a key lies, 0 to 2 ** cell_bits - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), BITS - cell_bits).cast("int")


def ring(spark: SparkSession, shards: int, vnodes: int, cell_bits: int, seed: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. Their number is a parameter and doesn't depend on data."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("int").alias("node"))
    cells = nodes.select(_cell([F.lit("vnode"), F.col("shard"), F.col("node")], cell_bits, seed).alias("cell"), "shard", "node")
    return [(x.cell, x.shard) for x in sorted(cells.collect())]


def deal(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each cell go: (cell, first rank, rank after the last, shard, slot of the first).

    Each cell's keys ask the next virtual node clockwise. A shard takes keys as long as it has room, in the order of
    the ring; what overflows asks one node further, until all are placed. capacity must hold all keys.
    """
    successor, at = {}, 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        successor[cell] = at % len(nodes)
    free, slots, taken = list(capacity), [0] * len(capacity), []
    waiting = [(cell, 0) for cell in sorted(counts)]
    for step in range(len(nodes)):
        left = []
        for cell, done in waiting:
            shard = nodes[(successor[cell] + step) % len(nodes)][1]
            n = min(free[shard], counts[cell] - done)
            if n:
                taken.append((cell, done, done + n, shard, slots[shard]))
                free[shard] -= n
                slots[shard] += n
            if done + n < counts[cell]:
                left.append((cell, done + n))
        waiting = left
        if not waiting:
            break
    merged = []
    for (_, shard), run in groupby(sorted(taken), key=lambda x: (x[0], x[3])):
        for x in run:
            if merged and merged[-1][0] == x[0] and merged[-1][3] == shard and merged[-1][2] == x[1] and merged[-1][4] + x[1] - merged[-1][1] == x[4]:
                merged[-1] = (*merged[-1][:2], x[2], *merged[-1][3:])
            else:
                merged.append(x)
    return merged


def assign_shards(docs: DataFrame, shards: int, vnodes: int = 64, cell_bits: int = 14, slack: float = 0.0, seed: int = 11, cell_rows: int = 1_000_000) -> DataFrame:
    """Puts each row of docs (doc_id, text) into a shard of a ring with bounded loads.

    The ring has 2 ** cell_bits cells; a row lies on the cell of its doc_id's hash, and each shard has vnodes virtual
    nodes. No shard takes more than its share of the rows times 1 + slack; at slack 0 the shares are whole numbers at
    most one apart, and all shards are full to the last row. Rows that overflow a full shard go on clockwise.

    The driver sees one count for each cell, at most 2 ** cell_bits of them, however many rows there are. Ranks are
    taken within a cell, so rows spread over that many groups whatever their source or text; cells of over cell_rows
    rows, as very many rows or one repeated doc_id make them, are ranked in parts by a hash of the rows' values. What is
    in the table decides where a row goes, not how it is laid out in files. Returns doc_id, size (UTF-8
    bytes of the text, null: none, plus 16), text_crc32 (of the UTF-8 text, null: of nothing), shard, slot (gapless from 0
    in its shard). Null doc_ids share one cell; repeated rows each get their own slot; texts of any length count
    whole; further columns are ignored, whatever their names; an empty table gives no rows.
    """
    if shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("shards and vnodes must be positive and slack not negative")
    spark = docs.sparkSession
    on_cell = _cell([F.col("doc_id")], cell_bits, seed)
    counts = {x.cell: x.n for x in docs.select(on_cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if slack:
        capacity = [-(-int(total * (1 + slack)) // shards) + 1] * shards
    else:
        capacity = [total // shards + (k < total % shards) for k in range(shards)]
    plan = deal(counts, ring(spark, shards, vnodes, cell_bits, seed), capacity)
    plan_df = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "p_cell int, p_from long, p_to long, shard int, p_slot long")

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), on_cell.alias("cell"))
    value = ["doc_id", "text_crc32", "size"]
    parts = [(cell, -(-n // cell_rows)) for cell, n in counts.items() if n > cell_rows]
    several = F.broadcast(spark.createDataFrame(parts or [(-1, 1)], "h_cell int, parts long"))
    # Rows equal in all that is returned are counted, not ranked one by one: where they lie in files doesn't matter.
    values = rows.groupBy("cell", *value).agg(F.count("*").alias("n")).join(several, F.col("cell") == F.col("h_cell"), "left")
    values = values.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), *value), F.coalesce("parts", F.lit(1)))).drop("h_cell", "parts")
    ahead = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = values.where(F.col("cell").isin([c for c, _ in parts])).groupBy("cell", "part").agg(F.sum("n").alias("own"))
    sizes = sizes.select(F.col("cell").alias("s_cell"), F.col("part").alias("s_part"), F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("cell", "part").orderBy(*value).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if parts:
        values = values.join(sizes, (F.col("cell") == F.col("s_cell")) & (F.col("part") == F.col("s_part")), "left")
        values = values.withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))
    # Each value's rows take the ranks from its first on; many rows of one value are spread in blocks.
    blocks = values.select("cell", *value, "n", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("block"))
    if parts:
        blocks = blocks.repartition("cell", *value, "block")
    ranked = blocks.select("cell", *value, F.explode(F.sequence(F.col("rank") + F.col("block"), F.col("rank") + F.least("n", F.col("block") + BLOCK) - 1)).alias("rank"))
    # A cell has one part, and one more for each overflow: the plan is bounded by the ring, not by the rows.
    placed = ranked.join(F.broadcast(plan_df), (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("p_slot") + F.col("rank") - F.col("p_from")).alias("slot"))
