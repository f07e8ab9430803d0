"""Token ids in binary files: range asymmetric numeral system over one shared frequency table.

A file row (a segment) holds whole documents in ascending order. Its ids are coded in independent blocks, each of which
is interleaved over a number of lanes that numpy steps through together; any block can be decoded on its own from the
checkpoint that the header keeps for it, and carries a checksum of its ids.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import written

#: Fixed values of the format: name, bits of a frequency, lower bound of a state, bits that leave a state at a time.
MAGIC, PRECISION, LOW, WORD_BITS = b"RNS1", 22, 1 << 32, 32
#: Parts at most: beyond, parts grow instead, since each is one task and is read as a stream.
MOST_PARTS = 100_000
#: Segments whose starts, 24 bytes each, may be sent to all tasks.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Layout:
    """lanes: ids coded in one step; block: steps of a block; segment_ids: ids of a segment, before it ends at a document."""

    lanes: int = 512
    block: int = 512
    segment_ids: int = 1 << 19


class Table:
    """Frequencies that sum to 2 ** PRECISION; every counted id has at least one."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        self.ids, self.frequencies = ids.astype(np.int64), frequencies.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint64)
        self.place = np.full(int(self.ids.max()) + 1 if len(ids) else 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The symbol of each slot; only decoding needs it."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint16 if len(self.ids) <= 0x10000 else np.uint32), self.frequencies.astype(np.int64))
        return self._slots

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray) -> Table:
        """Scales counts (over 0) to the precision; the largest take up what rounding leaves."""
        if not len(ids):
            return Table(ids, counts)
        if len(ids) == 1:  # a frequency of the whole range would not fit a state
            ids, counts = np.append(ids, ids[0] + 1), np.append(counts, 1)
        whole = 1 << PRECISION
        if len(ids) > whole // 2:
            raise ValueError("too many different ids for the precision")
        f = np.maximum(1, np.floor(counts / counts.sum() * (whole - len(ids))).astype(np.int64))
        order = np.argsort(-counts, kind="stable")
        rest = whole - int(f.sum())
        if rest > 0:
            f[order[0]] += rest
        for k in order:
            if rest >= 0:
                break
            taken = min(int(f[k]) - 1, -rest)
            f[k] -= taken
            rest += taken
        return Table(ids, f)


def encode_block(symbols: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Final state per lane, and the words that left the states in the order in which decoding wants them."""
    steps = -(-len(symbols) // lanes)
    state, out = np.full(lanes, LOW, np.uint64), []
    # Looked up for the whole block at once; a step is (x // f << PRECISION) + x % f + start with one division.
    f, start = np.take(table.frequencies, symbols), np.take(table.starts, symbols)
    most, rest, word = f << np.uint64(64 - PRECISION), np.uint64(1 << PRECISION) - f, np.uint64(WORD_BITS)
    for k in range(steps - 1, -1, -1):
        at = slice(k * lanes, min((k + 1) * lanes, len(symbols)))
        x = state[: at.stop - at.start]
        (full,) = (x >= most[at]).nonzero()
        if len(full):
            held = x[full]
            out.append(held.astype("<u4"))  # the low 32 bits
            x[full] = held >> word
        more = x // f[at]
        more *= rest[at]
        x += more
        x += start[at]
    return state, np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")


def decode_block(state: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    """The n symbols of a block."""
    lanes, at, out = len(state), 0, np.empty(n, np.int64)
    state, mask, low, bits, word = state.astype(np.uint64), np.uint64((1 << PRECISION) - 1), np.uint64(LOW), np.uint64(PRECISION), np.uint64(WORD_BITS)
    slots, frequencies, starts, words = table.slots, table.frequencies, table.starts, words.astype(np.uint64)
    for begin in range(0, n, lanes):
        own = out[begin : begin + lanes]
        x = state if len(own) == lanes else state[: len(own)]
        slot = x & mask
        own[:] = slots.take(slot.view(np.int64))
        x >>= bits
        x *= frequencies.take(own)
        x += slot
        x -= starts.take(own)
        (few,) = (x < low).nonzero()
        if len(few):
            more = x.take(few)
            more <<= word
            more |= words[at : at + len(few)]
            x[few] = more
            at += len(few)
    return out


def write_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], table: Table, layout: Layout) -> bytes:
    """Header (magic, size and JSON of counts and checkpoints), then doc_ids and lengths, then the blocks."""
    symbols, step = table.place[ids], layout.lanes * layout.block
    blocks, body, at = [], [], 0
    for begin in range(0, len(ids), step):
        own = symbols[begin : begin + step]
        lanes = min(layout.lanes, len(own))
        state, words = encode_block(own, table, lanes)
        raw = state.astype("<u8").tobytes() + words.tobytes()
        blocks.append([begin, len(own), lanes, at, len(raw), zlib.crc32(ids[begin : begin + step].astype("<u4").tobytes())])
        body.append(raw)
        at += len(raw)
    known = [d for d in doc_ids if d is not None]  # null ones come first
    sizes = zlib.compress(np.array(lengths, "<u8").tobytes() + np.diff(np.array(known, "<i8"), prepend=np.int64(0)).astype("<i8").tobytes())
    head = json.dumps({"ids": len(ids), "documents": len(lengths), "nulls": len(lengths) - len(known), "sizes": len(sizes), "blocks": blocks}, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, sizes, *body])


def read_header(data: bytes) -> tuple[dict, list[int | None], np.ndarray, int]:
    """The header, the documents' ids and lengths, and where the blocks begin."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of this format")
    (size,) = struct.unpack_from("<I", data, 4)
    head = json.loads(data[8 : 8 + size])
    at = 8 + size
    raw, n = zlib.decompress(data[at : at + head["sizes"]]), head["documents"]
    doc_ids = np.cumsum(np.frombuffer(raw, "<i8", offset=8 * n)).tolist()
    return head, [None] * head["nulls"] + doc_ids, np.frombuffer(raw, "<u8", n).astype(np.int64), at + head["sizes"]


def read_block(data: bytes, block: list[int], base: int, table: Table) -> np.ndarray:
    """The ids of one block, found by its checkpoint alone; a wrong checksum is an error."""
    _, n, lanes, at, size, check = block
    raw = data[base + at : base + at + size]
    ids = table.ids[decode_block(np.frombuffer(raw, "<u8", lanes), np.frombuffer(raw, "<u4", offset=8 * lanes), n, table)]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a block does not match its checksum")
    return ids


def read_segment(data: bytes, table: Table) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """All ids of a segment, and the ids and lengths of its documents."""
    head, doc_ids, lengths, base = read_header(data)
    parts = [read_block(data, b, base, table) for b in head["blocks"]]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), doc_ids, lengths


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, partition_bytes: int) -> DataFrame:
    """part, place, doc_id, n_tokens, ids of each row of docs, in ascending doc_id order along part and place; written."""
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    parts = min(MOST_PARTS, max(1, -(-int(total) // partition_bytes)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, done = tokens.encoder(tokenizer_path, keeps_space=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                ids, n = list(own.encode(rows.column(1).to_pylist(), end_id, at_once=4_000_000)), rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), rows.column(0), pa.array([len(x) // own.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["part", "place", "doc_id", "n_tokens", "ids"])
                done += n

    first = F.col("doc_id").asc_nulls_first()
    # The texts' heads are part of the ranges, so that one doc_id on many rows is dealt to many parts.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, first, F.left("text", F.lit(64)).asc_nulls_first()).sortWithinPartitions(first, F.asc_nulls_first("text"))
    return written(dealt.mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids binary"), "ids", "zstd")


def _array(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def fit_table(rows: DataFrame) -> Table:
    """The frequencies of all ids of all documents; the driver gets one count per id of the vocabulary."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1, np.int64)
        for batch in batches:
            n, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in range(0, len(n), 500):
                own = np.bincount(_array(b"".join(raw[i : i + 500]), int(n[i : i + 500].sum())), minlength=len(total))
                own[: len(total)] += total
                total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = rows.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return Table.of(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


SEGMENT = "part int, first_place long, documents long, n_ids long, data binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, layout: Layout = Layout(), partition_bytes: int = 16 << 20) -> None:
    """Writes the ids of docs (doc_id, text; null: empty) in ascending doc_id order below path.

    path/segments holds the segments, in order along part and first_place (the first document's place in its part), and
    path/table the shared frequencies. Documents are dealt to parts by ranges of doc_id; null doc_ids come first and
    repeated ones stand together, by text. Further columns are ignored, whatever their names. Parts are read and coded as a stream, segment by segment; a document longer than a
    segment has one to itself, in several blocks. An empty table gives empty files.
    """
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer_path, end_id, partition_bytes)
    table = fit_table(rows)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(table.ids, table.frequencies, strict=True)], "id long, frequency long").write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((table.ids, table.frequencies))

    def code(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, at, held, size = Table(*shared.value), None, [], 0

        def told():
            data = write_segment(np.concatenate([x for *_, x in held]), [d for d, *_ in held], [n for _, n, _ in held], own, layout)
            values = ((at[0], pa.int32()), (at[1] - len(held) + 1, pa.int64()), (len(held), pa.int64()), (size, pa.int64()), (data, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["part", "first_place", "documents", "n_ids", "data"])

        for batch in batches:
            for part, place, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size >= layout.segment_ids or at != (part, place - 1)):
                    yield told()
                    held, size = [], 0
                at = (part, place)
                held.append((doc, n, _array(raw, n)))
                size += n
        if held:
            yield told()

    # A scan keeps the order of rows within a file, so each task sees unbroken runs of a part.
    rows.select("part", "place", "doc_id", "n_tokens", "ids").mapInArrow(code, SEGMENT).write.option("compression", "uncompressed").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str) -> DataFrame:
    """What write() wrote, decoded: doc_id, start (ids of all documents before it), ids (little-endian, 32 bits each)."""
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    sizes = segments.select("part", "first_place", "n_ids")
    before = Window.partitionBy("part").orderBy("first_place").rowsBetween(Window.unboundedPreceding, -1)
    # Running sums in two levels: runs of 512 parts, then the parts of each run.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("in_part")).withColumn("run", F.floor(F.col("part") / 512))
    ahead = lambda window, order: window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy("run").agg(F.sum("in_part").alias("in_run")).select("run", F.coalesce(F.sum("in_run").over(ahead(Window.partitionBy(F.lit(0)), "run")), F.lit(0)).alias("before_run"))
    within = F.coalesce(F.sum("in_part").over(ahead(Window.partitionBy("run"), "part")), F.lit(0))
    parts = parts.withColumn("within", within).join(runs, "run").select("part", (F.col("before_run") + F.col("within")).alias("before_part"))
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "first_place", (F.col("in_part") + F.col("before_part")).alias("begin"))
    table = spark.read.parquet(f"{path}/table").toPandas().sort_values("id")
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["frequency"].to_numpy(np.int64)))

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Table(*shared.value)
        for batch in batches:
            for part, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, doc_ids, lengths = read_segment(data, own)
                ends, n, raw = np.cumsum(lengths), len(lengths), ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([place] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array([raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())], ["part", "first_place", "doc_id", "in_segment", "ids"])

    # One narrow row per segment; if even those are many, decoded rows meet them by a shuffle.
    starts = F.broadcast(starts) if segments.count() <= BROADCAST_ROWS else starts
    found = segments.select("part", "first_place", "data").mapInArrow(decode, "part int, first_place long, doc_id long, in_segment long, ids binary")
    return found.join(starts, ["part", "first_place"]).select("doc_id", (F.col("begin") + F.col("in_segment")).alias("start"), "ids")
