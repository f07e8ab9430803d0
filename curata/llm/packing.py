"""Packing of token sequences: first-fit decreasing with a tournament tree, independently in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .arrow import release

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class CapacityTree:
    """Bins of one size in a row under a tournament tree of their free space; every bin is empty at first."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, length: int) -> tuple[int, int]:
        """Puts length into the leftmost bin with room for it; its number and what room it had."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        had = free[at]
        free[at] = had - length
        place = at - self.leaves
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return place, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each length, given in falling order."""
    tree = CapacityTree(max(1, len(lengths)), capacity)
    return [(place, capacity - had) for place, had in map(tree.first_fit, lengths)]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int) -> DataFrame:
    """Cuts each document's ids (null text: only end_id) into pieces of at most length ids; the last one is the rest.
    Adds row, the number of the document's row: its task's and its place in the task."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        own, row = tokens.encoder(tokenizer_path, keeps_space=False), TaskContext.get().partitionId() << 40
        size = own.dtype.itemsize
        step = length * size
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "row"]
        out: list[tuple] = []
        held = 0

        def told():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist(), end_id), strict=True):
                    total = len(ids) // size
                    for k in range(0, len(ids), step):
                        piece = ids[k : k + step]
                        out.append((doc, k // size, len(piece) // size, piece, total, row))
                        held += len(piece)
                        if held > 2_000_000:
                            yield told()
                            out, held = [], 0
                    row += 1
        if out:
            yield told()
            out = []
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, f"{PIECES}, row long")


def _wide(ids, n: int):
    """Binary values of 16- or 32-bit ids, n ids in all, as 32-bit ones."""
    import numpy as np
    import pyarrow as pa

    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    lengths = np.fromiter((len(x) for x in (v.as_buffer() for v in ids)), np.int64, len(ids))
    raw = np.frombuffer(b"".join(v.as_buffer() for v in ids), np.uint8)
    if not n or len(raw) == 4 * n:
        return ids
    data = raw.view("<u2").astype("<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(2 * lengths)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, group_bytes: int = 8 << 20, seed: int = 7) -> DataFrame:
    """Packs the tokens of all docs (doc_id, text) into sequences of at most length ids.

    Pieces are dealt to random groups of about group_bytes each, counting a text's bytes and 64 for each row, so that a
    group always fits one task, whatever one document, doc_id or source holds; in each group first-fit decreasing fills
    its sequences. Returns one row per piece: doc_id, start, length, ids (little-endian, 32 bits each), doc_tokens,
    sequence_id, offset. A null text is empty and gives its end id alone; null and repeated doc_id are allowed, every row
    is packed and dealt on its own; further columns are ignored; an empty table gives no rows. Ties in length go by
    doc_id, start and row, so a rerun over the same files packs alike.
    """
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // group_bytes))
    pieces = token_pieces(docs, tokenizer_path, end_id, length).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups)))

    def fill(group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        lengths = group.column("length").to_pylist()
        at = np.array(first_fit_decreasing(lengths, length), dtype="int64").reshape(-1, 2)
        sequence = (np.int64(group.column("bucket")[0].as_py()) << 32) + at[:, 0]
        group = group.set_column(group.schema.get_field_index("ids"), "ids", _wide(group.column("ids"), sum(lengths)))
        return group.drop_columns(["bucket", "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(at[:, 1]))

    return pieces.groupBy("bucket").applyInArrow(fill, PACKED)
