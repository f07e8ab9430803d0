"""Groups of copies onto splits, one after the other in a fixed order, computed in parallel.

Each group goes to the split with most room, that is, whose target exceeds what it holds by most: that is where the sum
of squared distances from the targets grows least, whatever the group's size. Where a group goes depends on all groups
before it, yet the rooms soon forget how they came about: groups of one record level them. So a class is cut into chunks
of its order; the state at the start of each is guessed by pouring the records before it onto the splits, large groups
one by one; all chunks are placed at once from their guesses; and chunks whose start differs from where the one before
them ended are placed again from there. When none differs, the result is that of the sequential walk. Every round settles
at least the first chunk that was wrong, and as a rule all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: Chunks of a class at most, and groups of a chunk below that.
CHUNKS, CHUNK_GROUPS = 1 << 16, 50_000


def pour(room: list[int], amount: int, unit: int) -> list[int]:
    """The rooms after amount records in groups of unit each (the last may be smaller), each to the largest room (ties:
    the earlier). In closed form: the rooms' levels at which a group is taken are sorted, not the groups walked."""
    times, rest = divmod(amount, unit)

    def taken(level: int) -> list[int]:
        """How many groups each split takes at rooms above level."""
        return [max(0, -((level - r) // unit)) for r in room]

    low, high = min(room) - unit * (times + 1), max(room)
    while low < high:  # the lowest level above which no more than times groups fit
        middle = (low + high) // 2
        if sum(taken(middle)) <= times:
            high = middle
        else:
            low = middle + 1
    own = taken(low)
    left = times - sum(own)
    for k, r in enumerate(room):  # at the level itself, in order
        if left and r - own[k] * unit == low:
            own[k] += 1
            left -= 1
    out = [r - n * unit for r, n in zip(room, own, strict=True)]
    if rest:
        out[out.index(max(out))] -= rest
    return out


def walk(room: list[int], targets: Sequence[int], sizes: Sequence[int], left: int) -> tuple[list[int], list[int]]:
    """The split of each group and the rooms after them, from the rooms before them; left: groups of the class from here
    on. When as many groups are left as splits are empty, only empty ones are open."""
    room, out = list(room), []
    empty = sum(r == t for r, t in zip(room, targets, strict=True))
    for size in sizes:
        if empty and empty >= left:
            k = max((k for k, r in enumerate(room) if r == targets[k]), key=lambda k: (room[k], -k))
        else:
            k = room.index(max(room))
        empty -= room[k] == targets[k]
        room[k] -= size
        left -= 1
        out.append(k)
    return out, room


def _events(pdf, large: int) -> tuple[list[int], list[int]]:
    """A chunk's groups as records of small groups and large groups in turn: small[i] come ahead of large[i]."""
    small, big, ahead = [], [], 0
    for size in pdf.sort_values(["key", "known"])["size"]:
        if size >= large:
            small.append(ahead)
            big.append(int(size))
            ahead = 0
        else:
            ahead += int(size)
    return [*small, ahead], big


def place(groups: DataFrame, apportion, names: Sequence[str], chunk_groups: int = CHUNK_GROUPS) -> DataFrame:
    """class, key, known, split: the split of each group. groups: class, key (hexadecimal, their order in a class), known
    (false before true on equal keys) and size. apportion(total): the targets of a class, one per name."""
    n = len(names)
    start_of = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    totals = groups.groupBy("class").agg(F.sum("size").alias("total"), F.count("*").alias("n_groups"), F.min("size").alias("least"), F.max("size").alias("most"), F.bit_or("size").alias("bits"))
    sized = totals.withColumn("chunks", F.least(F.lit(CHUNKS), F.ceil(F.col("n_groups") / chunk_groups)))
    groups = settled(groups.join(sized.select("class", "chunks", "total"), "class").withColumn("chunk", F.shiftright(start_of * F.col("chunks"), 32)).drop("chunks"))
    state = settled(_guess(groups, totals, apportion, n))
    by_chunk = Window.partitionBy("class").orderBy("chunk")
    while True:
        ends = _walk(groups.join(state.where("again").select("class", "chunk"), ["class", "chunk"], "left_semi"), state.where("again"), None)
        state = state.drop("again").join(ends, ["class", "chunk"], "left").withColumn("ended", F.coalesce("new", "ended")).drop("new")
        true = F.coalesce(F.lag("ended").over(by_chunk), F.col("targets"))
        state = settled(state.withColumn("true", true).withColumn("again", F.col("start") != F.col("true")).withColumn("start", F.col("true")).drop("true"))
        if state.where("again").isEmpty():
            return _walk(groups, state, list(names))


def _guess(groups: DataFrame, totals: DataFrame, apportion, n: int) -> DataFrame:
    """class, chunk, left, targets, start (rooms), ended (null), again (true), one row per chunk: at most CHUNKS a class."""
    def chunk_events(key, pdf):
        import pandas as pd

        small, big = _events(pdf, max(2, int(pdf["total"].iloc[0]) // CHUNKS))
        return pd.DataFrame({"class": [key[0]], "chunk": [key[1]], "n": [len(pdf)], "small": [small], "big": [big]})

    # A large group has more than the CHUNKS-th part of the class, so there are no more than CHUNKS of them.
    events = groups.groupBy("class", "chunk").applyInPandas(chunk_events, "class string, chunk long, n long, small array<long>, big array<long>")

    def starts(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("chunk")
        of = pdf.iloc[0]
        bits = int(of["bits"])
        unit = int(of["least"]) if of["least"] == of["most"] else bits & -bits
        targets, left = [int(t) for t in apportion(int(of["total"]))], int(of["n_groups"])
        room, rows = list(targets), []
        for chunk, count, small, big in zip(pdf["chunk"], pdf["n"], pdf["small"], pdf["big"], strict=True):
            rows.append((key[0], int(chunk), left, targets, room))
            left -= int(count)
            for k, amount in enumerate(small):
                room = pour(room, int(amount), unit)
                if k < len(big):
                    room = walk(room, targets, [int(big[k])], n + 1)[1]
        return pd.DataFrame(rows, columns=["class", "chunk", "left", "targets", "start"])

    guessed = events.join(totals, "class").groupBy("class").applyInPandas(starts, "class string, chunk long, left long, targets array<long>, start array<long>")
    return guessed.withColumn("ended", F.lit(None).cast("array<long>")).withColumn("again", F.lit(True))


def _walk(groups: DataFrame, state: DataFrame, names: list[str] | None) -> DataFrame:
    """Each chunk walked from its start: the rooms at its end (column new), or with names the split of each group."""
    def run(own, of):
        import pandas as pd

        if own.empty or of.empty:
            return pd.DataFrame(columns=["class", "chunk", "new"] if names is None else ["class", "key", "known", "split"])
        own, of = own.sort_values(["key", "known"]), of.iloc[0]
        found, room = walk([int(r) for r in of["start"]], [int(t) for t in of["targets"]], own["size"].tolist(), int(of["left"]))
        if names is None:
            return pd.DataFrame({"class": [of["class"]], "chunk": [of["chunk"]], "new": [room]})
        return own[["class", "key", "known"]].assign(split=[names[k] for k in found])

    schema = "class string, chunk long, new array<long>" if names is None else "class string, key string, known boolean, split string"
    own = groups.select("class", "chunk", "key", "known", "size").groupBy("class", "chunk")
    return own.cogroup(state.select("class", "chunk", "left", "targets", "start").groupBy("class", "chunk")).applyInPandas(run, schema)
