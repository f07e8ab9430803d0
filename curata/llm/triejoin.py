"""Near-duplicate join of word-shingle sets through prefix trees.

Three rounds, each on what the one before has left, find all similar pairs without ever sending all sets about:

1. Every set sends its lowest hashes, packed, to buckets that tell which of them occur in another set. A set of which too
   few do is similar to none. Nothing needs an order by frequency here, so nothing depends on the size of the corpus.
2. The sets that are left are counted whole. Now the frequency of each of their shingles is known, and with it the global
   order, rare first. A set of which fewer than the similarity's share occur elsewhere goes; of the others the head, one
   element of which any similar set must share, is kept.
3. The heads that share an element make a trie that all of them traverse together, with what each has shared on the path
   so far. First each set meets the lowest one that the tries of two of its elements bring up, which
   joins most copies; then the tries of all elements whose sets are still apart bring up the rest. Whole sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .arrow import release
from .common import written

#: Rows of up to 40 bytes that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: What stands for the owner of a shingle that several sets of a block have.
MANY = 0xFFFFFFFF


@dataclass(frozen=True)
class Settings:
    """percent: Jaccard similarity of linked sets; extra: percent of a set that it sends in the first round beyond its
    prefix; block: sets with one element that a task compares at a time, and partners of one set; few: an element of more
    sets brings whole sets along, so that the task itself decides; gathered: shingles that a task packs at a time, more
    where there are so many buckets that few would go to each; bucket_bytes: text, or sets, whose shingles make one bucket."""

    percent: int = 80
    extra: int = 10
    block: int = 512
    few: int = 64
    gathered: int = 1 << 18
    bucket_bytes: int = 8 << 20

    def spare(self, n: int) -> int:
        return max(1, -(-self.extra * n // 100))

    def sent(self, n: int) -> int:
        """How many of its lowest hashes a set of n sends. The first spare() elements that two similar sets share, in the
        order of hashes, lie among these in both: ahead of them stand at most the elements that the other one lacks."""
        return n - sh.least_partner(n, self.percent) + self.spare(n)

    def packed(self, buckets: int) -> int:
        return max(self.gathered, min(8 * self.gathered, 16 * buckets))

    def answered(self, n: int) -> int:
        """How many of them must occur in another set if any set is similar: spare() of the smallest possible partner."""
        return self.spare(sh.least_partner(n, self.percent))


def node_of(hashes: np.ndarray) -> bytes:
    """The id of a set, 128 bits: equal sets share it."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (sh.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _cut(order_by: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    edges = [0, *(np.flatnonzero(order_by[1:] != order_by[:-1]) + 1).tolist(), len(order_by)] if len(order_by) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _joined(column, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a binary column (null: none), one after the other, and the row of each."""
    raw = [b"" if v is None else v for v in column.to_pylist()]
    width = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(raw), dtype), np.repeat(np.arange(len(raw)), [len(x) // width for x in raw])


def _per_bucket(total: int, s: Settings) -> int:
    return max(1, -(-total // s.bucket_bytes))


def described(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, node (null for an empty set), n, and whether the set may be similar to another; one row for each of docs.

    A block of texts sends each shingle to its bucket once, and where several of its sets have it, it needs no answer, so
    a bucket gets at most one entry of a shingle from each block, however common it is. Blocks are numbered by task and
    place in it: docs should be read from files, so that a lost task's work is repeated alike."""
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    buckets = _per_bucket(int(total), s)
    most = s.packed(buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = f"doc_ids array<{kind}>, nodes array<binary>, sizes array<long>, owners array<int>, local array<int>"

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        ids, nodes, sizes, owners, own, place = [], [], [], [], [], {}

        def told():
            tokens = np.concatenate(own) if own else np.zeros(0, np.uint64)
            of = np.repeat(np.arange(len(own)), [len(x) for x in own]).astype(np.uint32)
            order = np.argsort(tokens, kind="stable")
            tokens, of = tokens[order], of[order]
            first = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            shared = np.repeat(np.diff(np.append(starts, len(tokens))) > 1, np.diff(np.append(starts, len(tokens))))
            local = np.bincount(of[shared], minlength=len(own)).astype(np.int32)
            of = np.where(shared, np.uint32(MANY), of)[starts].astype("<u4")
            tokens = tokens[starts]
            to = _bucket(tokens, buckets)
            order = np.argsort(to, kind="stable")
            to, tokens, of = to[order], tokens[order], of[order]
            cuts = _cut(to)
            n = len(cuts)
            doc = [pa.array([x], pa.list_(t)) for x, t in ((ids, ids_type), (nodes, pa.binary()), (sizes, pa.int64()), (owners, pa.int32()), (local.tolist(), pa.int32()))]
            blank = [pa.nulls(n, x.type) for x in doc]
            packed = [pa.array([None, *(x[a:b].tobytes() for a, b in cuts)], pa.binary()) for x in (tokens, of)]
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * (n + 1), pa.int64()), pa.array([block % buckets, *(int(to[a]) for a, _ in cuts)], pa.int32()), *(pa.concat_arrays([d, b]) for d, b in zip(doc, blank, strict=True)), *packed],
                ["block", "bucket", "doc_ids", "nodes", "sizes", "owners", "local", "tokens", "of"],
            )

        gathered = 0
        for batch in batches:
            ids_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = sh.shingles(text)
                n = len(hashes)
                node = node_of(hashes) if n else None
                if n and node not in place:
                    place[node] = len(own)
                    own.append(hashes[: s.sent(n)])
                    gathered += len(own[-1])
                ids.append(doc)
                nodes.append(node)
                sizes.append(n)
                owners.append(place[node] if n else -1)
                if gathered >= most or len(ids) >= most:
                    yield told()
                    ids, nodes, sizes, owners, own, place, gathered = [], [], [], [], [], {}, 0
                    block += 1
        if ids:
            yield told()
            ids, nodes, sizes, owners, own, place = [], [], [], [], [], {}
        release()

    def answer(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        tokens, row = _joined(rows.column("tokens"), "<u8")
        of, _ = _joined(rows.column("of"), "<u4")
        _, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
        known = (times[at] > 1) & (of != MANY)
        key, n = np.unique((row[known].astype(np.uint64) << np.uint64(32)) | of[known], return_counts=True)
        cuts = _cut(key >> np.uint64(32))
        blocks = rows.column("block").to_numpy()
        mine = rows.filter(pc.is_valid(rows.column("doc_ids"))).select(["block", "doc_ids", "nodes", "sizes", "owners", "local"])
        mine = mine.append_column("of", pa.nulls(mine.num_rows, pa.binary())).append_column("n", pa.nulls(mine.num_rows, pa.binary()))
        theirs = {"block": pa.array([int(blocks[int(key[a] >> np.uint64(32))]) for a, _ in cuts], pa.int64())}
        theirs |= {c: pa.nulls(len(cuts), mine.schema.field(c).type) for c in ("doc_ids", "nodes", "sizes", "owners", "local")}
        theirs |= {"of": pa.array([key[a:b].astype("<u4").tobytes() for a, b in cuts], pa.binary()), "n": pa.array([n[a:b].astype("<u4").tobytes() for a, b in cuts], pa.binary())}
        return pa.concat_tables([mine, pa.table(theirs).cast(mine.schema)])

    def decide(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = rows.filter(pc.is_valid(rows.column("doc_ids")))
        get = lambda c: own.column(c).combine_chunks().values
        found = get("local").to_numpy(zero_copy_only=False).astype(np.int64)
        of, _ = _joined(rows.column("of"), "<u4")
        n, _ = _joined(rows.column("n"), "<u4")
        np.add.at(found, of.astype(np.int64), n.astype(np.int64))
        owners, sizes = get("owners").to_numpy(zero_copy_only=False), get("sizes").to_numpy(zero_copy_only=False)
        open_ = [o >= 0 and bool(found[o] >= s.answered(k)) for o, k in zip(owners.tolist(), sizes.tolist(), strict=True)]
        return pa.table({"doc_id": get("doc_ids"), "node": get("nodes"), "n": get("sizes"), "open": pa.array(open_, pa.bool_())})

    sent = docs.select("doc_id", "text").mapInArrow(send, f"block long, bucket int, {held}, tokens binary, of binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, f"block long, {held}, of binary, n binary")
    return answers.groupBy("block").applyInArrow(decide, f"doc_id {kind}, node binary, n long, open boolean")


def _few(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """rows, marked for broadcast if they are few enough, or take few enough bytes by their size where that varies; else
    left to a shuffle."""
    if size is None:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= 40 * BROADCAST_ROWS else rows


def sets_of(docs: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """part, node, n, hashes (8 bytes each, rising) of the open sets of known, from the text of one document of each."""
    nodes = written(known.where("open").groupBy("node").agg(F.min("doc_id").alias("some_id"), F.max("n").alias("n")), "open")
    parts = _per_bucket(8 * int(nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), s)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = [x for x in map(sh.shingles, batch.slice(at, 500).column(0).to_pylist()) if len(x)]
                ids = [node_of(x) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x[:8], "little") % parts for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(list(map(len, own)), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["part", "node", "n", "hashes"])

    def once(rows):
        seen: set = set()
        return rows.take([k for k, x in enumerate(rows.column("node").to_pylist()) if not (x in seen or seen.add(x))])

    ids = written(nodes.select("some_id").distinct(), "ids")
    texts = docs.select("doc_id", "text").join(_few(ids), F.col("doc_id").eqNullSafe(F.col("some_id"))).select("text")
    schema = "part long, node binary, n long, hashes binary"
    return texts.mapInArrow(run, schema).groupBy("part").applyInArrow(once, schema)


def heads_of(sets: DataFrame, s: Settings) -> DataFrame:
    """node, n, s (how many elements occur in another set), head (the first of them in the global order, so many that a
    similar set must share one), of the sets where enough elements occur elsewhere.

    The parts' counts of each shingle meet in buckets; each part is told the classes of frequency of its own."""
    buckets = _per_bucket(8 * int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), s)

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size, part = [], 0, None

        def told():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            to = _bucket(tokens, buckets)
            order = np.argsort(to, kind="stable")
            to, tokens, n = to[order], tokens[order], n[order]
            cuts = _cut(to)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(cuts), pa.int64()), pa.array([int(to[a]) for a, _ in cuts], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (tokens, n.astype("<u4")))], ["part", "bucket", "tokens", "n"])

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (own != part or size >= s.packed(buckets)):
                    yield told()
                    held, size = [], 0
                part = own
                held.append(np.frombuffer(raw, "<u8"))
                size += len(held[-1])
        if held:
            yield told()

    def answer(rows):
        import pyarrow as pa

        tokens, row = _joined(rows.column("tokens"), "<u8")
        n, _ = _joined(rows.column("n"), "<u4")
        _, at = np.unique(tokens, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)[at] if len(at) else n.astype(np.int64)
        known = total > 1
        parts = rows.column("part").to_numpy()[row[known]]
        order = np.argsort(parts, kind="stable")
        parts, tokens = parts[order], tokens[known][order]
        classes = np.minimum(127, 4 * np.log2(total[known][order])).astype(np.uint8)
        cuts = _cut(parts)
        return pa.table({"part": pa.array([int(parts[a]) for a, _ in cuts], pa.int64()), "tokens": pa.array([tokens[a:b].tobytes() for a, b in cuts], pa.binary()), "classes": pa.array([classes[a:b].tobytes() for a, b in cuts], pa.binary())})

    def order(own, told):
        import pyarrow as pa

        tokens, _ = _joined(told.column("tokens"), "<u8")
        classes, _ = _joined(told.column("classes"), "u1")
        tokens, first = np.unique(tokens, return_index=True)
        classes = classes[first]
        out: list[tuple] = []
        for node, n, raw in zip(own.column("node").to_pylist(), own.column("n").to_pylist(), own.column("hashes").to_pylist(), strict=True):
            hashes = np.frombuffer(raw, "<u8")
            at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
            hit = tokens[at] == hashes if len(tokens) else np.zeros(len(hashes), bool)
            keys = sh.ordered(hashes[hit], classes[at[hit]]) if hit.any() else np.zeros(0, np.int64)
            needed = sh.least_partner(n, s.percent)
            if len(keys) >= needed:
                out.append((node, n, len(keys), keys[: len(keys) - needed + 1]))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        types = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table({name: pa.array(list(c), t) for name, c, t in zip(("node", "n", "s", "head"), columns, types, strict=True)})

    answers = sets.select("part", "hashes").mapInArrow(send, "part long, bucket int, tokens binary, n binary").groupBy("bucket").applyInArrow(answer, "part long, tokens binary, classes binary")
    return sets.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(order, "node binary, n long, s long, head array<long>")


class HeadTrie:
    """Heads that share an element, whole or from it on, as rising key sequences in a path-compressed trie.

    sizes: of the whole sets; left: how many elements of a set, of those that occur elsewhere, stand at the sequence's
    beginning or behind it.
    """

    def __init__(self, sequences: list[np.ndarray], sizes, left, percent: int):
        self.sequences, self.percent = sequences, percent
        self.sizes, self.left = np.asarray(sizes, np.int64), np.asarray(left, np.int64)
        self.root = self._build(sorted(range(len(sequences)), key=lambda k: sequences[k].astype(">i8").tobytes()))

    def _build(self, order: list[int]):
        s = self.sequences
        root: list = []
        work = [(root, order, 0)]
        while work:
            siblings, own, depth = work.pop()
            first, last = s[own[0]], s[own[-1]]
            most = min(len(first), len(last))
            apart = np.flatnonzero(first[depth:most] != last[depth:most])
            end = depth + int(apart[0]) if len(apart) else most
            children: list = []
            sizes = self.sizes[own]
            ends = [k for k in own if len(s[k]) == end]
            siblings.append((own[0], depth, end, int(sizes.min()), int(sizes.max()), int(self.left[own].max()), ends, children))
            run: list[int] = []
            for k in own[len(ends) :]:
                if run and s[k][end] != s[run[0]][end]:
                    work.append((children, run, end))
                    run = []
                run.append(k)
            if run:
                work.append((children, run, end))
        return root[0]

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number, numbers of sequences) that may be similar: all sequences go down the trie together, with what each has
        shared on the path so far, and those leave that can't reach the similarity with any set below.

        Up to the lower of the ends of path and probe, what both share is counted; beyond, the smaller rest bounds it."""
        m = len(self.sequences)
        lengths = np.array([len(x) for x in self.sequences])
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate(self.sequences)
        owner = np.repeat(np.arange(m), lengths)
        values, rank = np.unique(flat, return_inverse=True)
        by_value = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[by_value], np.arange(len(values) + 1))
        wide = np.int64(len(values) + 1)
        keyed = owner * wide + rank
        last_rank = rank[starts + lengths - 1]
        work = [(self.root, np.arange(m), np.zeros(m, np.int64))]
        while work:
            (one, depth, end, least, most, rest, ends, children), own, shared = work.pop()
            own_sizes = self.sizes[own]
            fits = (100 * most >= self.percent * own_sizes) & (100 * own_sizes >= self.percent * least)
            own, shared, own_sizes = own[fits], shared[fits], own_sizes[fits]
            if not len(own):
                continue
            if not end:  # the sequences differ from their first element on
                work += [(child, own, shared) for child in children]
                continue
            path = rank[starts[one] : starts[one] + end]
            seen = np.zeros(m, np.int64)
            for r in path[depth:]:
                seen[owner[by_value[cuts[r] : cuts[r + 1]]]] += 1
            shared = shared + seen[own]
            upto = np.minimum(path[-1], last_rank[own])
            reached = np.searchsorted(keyed, own * wide + upto, "right") - starts[own]
            passed = np.searchsorted(path, upto, "right")
            possible = lambda theirs, at: shared[at] + np.minimum(theirs - passed[at], self.left[own[at]] - reached[at])
            every = np.arange(len(own))
            go = every[possible(rest, every) >= sh.least_overlap(least, own_sizes, self.percent)]
            for k in ends:
                near = go[(possible(self.left[k], go) >= sh.least_overlap(int(self.sizes[k]), own_sizes[go], self.percent)) & (own[go] != k)]
                if len(near):
                    yield k, own[near]
            work += [(child, own[go], shared[go]) for child in children]


def candidates_of_group(element: int, rows: list[tuple], sides: list[int] | None, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[bytes, bytes]]:
    """Pairs of nodes of different components, whose first common element is this one, that may be similar.

    rows: (node, component, n, s, head), all with the element. sides: only rows of different sides are compared. sets:
    whole sets of the rows; then the pairs are links, and sets that links found here connect are not compared again."""
    heads = [r[4] for r in rows]
    at = [int(np.searchsorted(h, element)) for h in heads]
    trie = HeadTrie([h[a:] for h, a in zip(heads, at, strict=True)], [r[2] for r in rows], [r[3] - a for r, a in zip(rows, at, strict=True)], percent)
    _, component = np.unique(np.array([r[1].hex() for r in rows]), return_inverse=True)
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=lambda k: rows[k][0])] = np.arange(len(rows))
    side = None if sides is None else np.array(sides)
    out = []
    for k, near in trie.candidates():
        near = near[(rank[near] > rank[k]) & (component[near] != component[k])]
        if side is not None:
            near = near[side[near] != side[k]]
        near = np.array([p for p in near.tolist() if not at[k] or not at[p] or not len(np.intersect1d(heads[k][: at[k]], heads[p][: at[p]], assume_unique=True))], np.int64)
        if sets is not None and len(near):
            own, theirs = sets[k], np.concatenate([sets[p] for p in near])
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            sizes = np.array([len(sets[p]) for p in near])
            overlap = np.bincount(np.repeat(np.arange(len(near)), sizes), hit, len(near)).astype(np.int64)
            near = near[sh.alike(overlap, len(own), sizes, percent)]
            for p in near.tolist():
                component[component == component[p]] = component[k]
        out += [(rows[k][0], rows[p][0]) for p in near.tolist()]
    return out


def links_of_hub(hub: tuple[bytes, int, np.ndarray], others: list[tuple[bytes, int, np.ndarray]], percent: int) -> list[tuple[bytes, bytes]]:
    """The links of one set (node, size, hashes) with others, by whole sets."""
    node, size, hashes = hub
    overlap = lambda x: int((hashes[np.minimum(np.searchsorted(hashes, x), size - 1)] == x).sum())
    return [(node, other) for other, n, x in others if 100 * min(n, size) >= percent * max(n, size) and sh.alike(overlap(x), size, n, percent)]


def verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (hub, node) whose whole sets are similar, as a and b. A hub with many partners is met in blocks of s.block
    of them, or fewer where their sets take s.bucket_bytes."""
    held = pairs.join(_few(sets.select("node", "n"), F.lit(40)), "node")
    blocks = F.greatest(F.col("partners") / s.block, 8 * F.col("all") / s.bucket_bytes)
    sizes = held.groupBy("hub").agg(F.count("*").alias("partners"), F.sum("n").alias("all")).select("hub", F.ceil(blocks).cast("int").alias("blocks"))
    sizes = written(sizes, "hubs")
    theirs = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    own = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))
    met = written(theirs.unionByName(own), "pairs")
    rows = sets.select("node", "n", "hashes").join(_few(met), "node")

    def check(group):
        import pyarrow as pa

        entries = [(a, n, np.frombuffer(x, "<u8")) for a, n, x in zip(*(group.column(c).to_pylist() for c in ("node", "n", "hashes")), strict=True)]
        hub = group.column("hub")[0].as_py()
        first = [e for e in entries if e[0] == hub]
        found = links_of_hub(first[0], [e for e in entries if e[0] != hub], s.percent) if first else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return rows.groupBy("hub", "block").applyInArrow(check, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label (the lowest node that links reach) of all nodes of links (a, b), by rounds of taking the lowest label
    of neighbours and the label of one's label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        theirs = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = written(step.join(theirs, F.col("label") == F.col("at"), "left").select("node", "was", F.coalesce(F.least("label", "further"), "label").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels


def lowest_partners(rows: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """(hub, node) for rows (node, n, s, head): the lowest node that the trie of their whole heads brings up as possibly
    similar to each, if it is lower than its own. At most one a row."""
    trie = HeadTrie([r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows], percent)
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    best = rank.copy()
    for k, near in trie.candidates():
        best[near] = np.minimum(best[near], rank[k])
        best[k] = min(best[k], int(rank[near].min()))
    return [(rows[order[int(b)]][0], rows[k][0]) for k, b in enumerate(best) if b < rank[k]]


def first_meetings(heads: DataFrame, elements: DataFrame, s: Settings) -> DataFrame:
    """hub, node: each set with the lowest one that the tries of its most and of its least shared element bring up.

    Copies agree on these two as a rule, so that most meet here, in two tries a set instead of one for each element of its
    head. An element of many sets has a trie for each block of them; the element's lowest set is in all, which ties the
    blocks together."""
    shared = elements.groupBy("token").agg(F.count("*").alias("members"), F.min("node").alias("low")).where("members > 1")
    known = elements.select("node", "token").join(shared, "token")
    element = F.struct("members", "token", "low")
    chosen = known.groupBy("node").agg(F.max(element).alias("most"), F.min(element).alias("least"))
    chosen = chosen.select("node", F.explode(F.array_distinct(F.array("most", "least"))).alias("e")).select("node", "e.*")
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / s.block)).cast("int")).drop("members")
    own = written(chosen.select("node", "token", "block", "low"), "meetings")
    met = own.select("node", "token", "block").union(own.groupBy("token", "block").agg(F.min("low").alias("node")).select("node", "token", "block")).distinct()
    met = met.join(_few(heads.select("node", "n", "s", "head"), 64 + 8 * F.size("head")), "node")
    met = met.repartition("token", "block").sortWithinPartitions("token", "block")

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, rows, out = None, [], []

        def told():
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["hub", "node"])

        for batch in batches:
            get = {c: batch.column(c).to_pylist() for c in ("token", "block", "node", "n", "s")}
            own_heads = batch.column("head")
            for k, key in enumerate(zip(get["token"], get["block"], strict=True)):
                if key != now:
                    if len(rows) > 1:
                        out.extend(lowest_partners(rows, s.percent))
                    now, rows = key, []
                    if len(out) > 50_000:
                        yield told()
                        out = []
                rows.append((get["node"][k], get["n"][k], get["s"][k], own_heads[k].values.to_numpy()))
        if len(rows) > 1:
            out.extend(lowest_partners(rows, s.percent))
        yield told()

    return met.mapInArrow(meet, "hub binary, node binary").distinct()


def still_apart(heads: DataFrame, elements: DataFrame, labels: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """hub, node, sure: pairs of sets of different components (labels: node, label) that may be similar, or are (sure).

    Every element whose sets are not all of one component is looked at by a task; an element of more sets than a block
    by one for each pair of blocks of them. An element of many sets brings whole sets along and yields links only, so
    what it yields doesn't grow with the square of its sets."""
    few_labels = _few(labels)
    label = F.coalesce("label", "node").alias("label")
    t = heads.join(few_labels, "node", "left").select("node", label, "n", "s", "head")
    rows = elements.select("node", "n", "token").join(few_labels, "node", "left").select("node", label, "n", "token")
    open_ = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.sum("n").alias("all")).where("low <> high")
    blocks = F.ceil(F.greatest(F.col("members") / s.block, F.when(F.col("members") > s.few, 8 * F.col("all") / s.bucket_bytes).otherwise(0))).cast("int")
    open_ = open_.select("token", blocks.alias("blocks"), (F.col("members") > s.few).alias("whole"))
    met = elements.select("node", "token").join(_few(written(open_, "open-elements")), "token").select("node", "token", "blocks", "whole", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = written(met.select("node", "token", "whole", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "met")
    met = met.join(_few(t, 64 + 8 * F.size("head")), "node")
    wanted = _few(written(met.where("whole").select("node").distinct(), "whole-sets"))
    brought = met.where("whole").join(sets.join(wanted, "node", "left_semi").select("node", "hashes"), "node")
    met = met.where("NOT whole").withColumn("hashes", F.lit(None).cast("binary")).unionByName(brought)
    met = met.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, rows, sides, whole, out = None, [], [], [], []

        def told():
            return pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)), pa.array([p[2] for p in out], pa.bool_())], ["hub", "node", "sure"])

        def close():
            if len(rows) > 1:
                sure = whole[0] is not None
                found = candidates_of_group(now[0], rows, sides if now[1] != now[2] else None, s.percent, [np.frombuffer(x, "<u8") for x in whole] if sure else None)
                out.extend((a, b, sure) for a, b in found)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                get = {c: part.column(c).to_pylist() for c in ("token", "i", "j", "own", "node", "label", "n", "s", "hashes")}
                heads = part.column("head")
                for k, key in enumerate(zip(get["token"], get["i"], get["j"], strict=True)):
                    if key != now:
                        close()
                        now, rows, sides, whole = key, [], [], []
                        if len(out) > 50_000:
                            yield told()
                            out = []
                    rows.append((get["node"][k], get["label"][k], get["n"][k], get["s"][k], heads[k].values.to_numpy()))
                    sides.append(get["own"][k])
                    whole.append(get["hashes"][k])
        close()
        yield told()

    return met.mapInArrow(compare, "hub binary, node binary, sure boolean")


def similar_links(docs: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between different sets of known that together connect all similar ones."""
    sets = written(sets_of(docs, known, s), "sets")
    heads = written(heads_of(sets, s), "heads")
    elements = written(heads.select("node", "n", "s", F.posexplode("head").alias("pos", "token")), "elements")
    links = written(verified(written(first_meetings(heads, elements, s), "first"), sets, s), "links")
    found = written(still_apart(heads, elements, components(links), sets, s), "candidates")
    more = verified(found.where("NOT sure").select("hub", "node"), sets, s)
    return written(links.unionByName(more).unionByName(found.where("sure").select(F.col("hub").alias("a"), F.col("node").alias("b"))), "all-links")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    The set of a text is its distinct shingles of five words, A-Z lowered; with fewer words, the whole sequence is one
    shingle; without words it is empty and linked with nothing. Texts whose sets are similar are linked, and
    component_id is the lowest doc_id that links reach. Equal sets form one node, so copies cost nothing further.
    A null doc_id never gives its name to a component that has another; repeated rows are all returned; an empty table
    gives no rows; further columns are ignored, whatever their names; texts are read whole, whatever their length.
    """
    s = settings
    known = written(described(docs.select("doc_id", "text"), s), "described")
    labels = components(similar_links(docs, known, s))
    lowest = known.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Nodes that no link reaches name themselves, so that only linked ones meet by label.
    named = lowest.where(F.col("label") != F.col("node")).select("label", "low").unionByName(lowest.join(labels.select("label").distinct(), "label", "left_semi").where(F.col("label") == F.col("node")).select("label", "low"))
    named = named.groupBy("label").agg(F.min("low").alias("component_id"))
    names = lowest.join(named, "label", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    out = known.select("doc_id", "node", F.col("n").alias("n_shingles")).join(names, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def sql(percent: int = 80) -> str:
    """near_duplicates() of documents as DuckDB SQL."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS k FROM w WHERE len(words) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)
), r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
