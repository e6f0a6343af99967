"""Best-fit packing of documents into sequences by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so that a histogram of at most
`capacity` entries describes any corpus. The driver plans on that histogram:
large lengths are sorted, cut into groups of equal cardinality and rounded up
to the largest of their group; full configurations of these few sizes are
chosen; real lengths then take the rounded places, and small documents go
best-fit into the room that is left. The plan is a list of ranges, "items of
length L and rank a..b go to sequences s..s+b-a at offset o", whose size depends
on the capacity alone. Each item learns its rank among equal lengths from a
count kept while its partition is read, plus a prefix sum over partitions.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, map_arrow, read_table, staged
from .word_bpe import opened, vocabulary_path

#: Groups of large lengths, and the part of the capacity above which one is large.
GROUPS, LARGE = 48, 0.25
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, end rank, first sequence, offset) that place
    every item once. Sequences never overflow; offsets are gapless from 0."""
    left = {n: c for n, c in histogram.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: sequences (first, end)
    rooms: list[int] = []

    def free(room: int, first: int, end: int) -> None:
        if room > 0 and end > first:
            if not gaps[room]:
                bisect.insort(rooms, room)
            gaps[room].append((first, end))

    def put(length: int, count: int, first: int, offset: int) -> None:
        out.append((length, taken[length], taken[length] + count, first, offset))
        taken[length] += count
        left[length] -= count

    # Rounded sizes and, under each, the real lengths in falling order.
    big = sorted((n for n in left if n > large * capacity), reverse=True)
    share = max(1, -(-sum(left[n] for n in big) // groups))
    members: dict[int, list[list[int]]] = {}
    room_in_group, size = 0, 0
    for n in big:
        count = left[n]
        while count:
            if not room_in_group:
                room_in_group, size = share, n
            members.setdefault(size, []).append([n, k := min(count, room_in_group)])
            count, room_in_group = count - k, room_in_group - k
    stock = {s: sum(k for _, k in runs) for s, runs in members.items()}

    while stock:
        # The largest size left, then the fullest configuration of the others.
        chosen = _fullest(stock, capacity)
        need = Counter(chosen)
        times = min(stock[s] // k for s, k in need.items())
        for s, k in need.items():
            stock[s] -= k * times
            if not stock[s]:
                del stock[s]
        # Substitute real lengths: cut the `times` copies where a place's length changes.
        at, done = sequences, 0
        while done < times:
            runs = [_first_run(members[s], i) for s, i in _places(chosen)]
            step = min([times - done, *_steps(members, chosen)])
            offset = 0
            for s, n in zip(chosen, runs, strict=True):
                put(n, step, at + done, offset)
                offset += n
                _use(members[s], n, step)
            free(capacity - offset, at + done, at + done + step)
            done += step
        sequences += times

    # Small ones, largest first, each into the least room that holds it.
    for n in sorted((n for n in left if left[n] > 0), reverse=True):
        while left[n] and (i := bisect.bisect_left(rooms, n)) < len(rooms):
            room = rooms[i]
            first, end = gaps[room].pop()
            if not gaps[room]:
                rooms.pop(i)
            k = min(left[n], end - first)
            put(n, k, first, capacity - room)
            free(room, first + k, end)
            free(room - n, first, first + k)
        if left[n]:
            per = capacity // n
            whole, rest = divmod(left[n], per)
            for slot in range(per):
                if k := whole + (slot < rest):
                    put(n, k, sequences, slot * n)
            free(capacity - per * n, sequences, sequences + whole)
            if rest:
                free(capacity - rest * n, sequences + whole, sequences + whole + 1)
            sequences += whole + (rest > 0)
    return out


def best_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences among a few settings of the scheme."""
    tried = [plan(histogram, capacity, g, share) for g, share in ((groups, large), (4 * groups, large), (groups, 2 * large))]
    return min(tried, key=lambda p: max((first + end - begin for _, begin, end, first, _ in p), default=0))


def _fullest(stock: dict[int, int], capacity: int) -> list[int]:
    """The largest size, and the sizes that with it fill the capacity best
    within their stock: a bounded knapsack over a few sizes."""
    top = max(stock)
    room = capacity - top
    best: dict[int, tuple[int, ...]] = {0: ()}
    for s in sorted((s for s in stock if s <= room), reverse=True):
        have = stock[s] - (s == top)
        for total, used in list(best.items()):
            for k in range(1, min(have, (room - total) // s) + 1):
                best.setdefault(total + k * s, (*used, *[s] * k))
    return [top, *best[max(best)]]


def _places(chosen: list[int]) -> list[tuple[int, int]]:
    seen: Counter = Counter()
    out = []
    for s in chosen:
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def _first_run(runs: list[list[int]], nth: int) -> int:
    """Places of one size in a configuration share the first run while it lasts."""
    for n, k in runs:
        if k > 0:
            if nth < k:
                return n
            nth -= k
    raise AssertionError("a configuration needs more than the stock")


def _steps(members: dict[int, list[list[int]]], chosen: list[int]) -> list[int]:
    """How many copies each size allows before one of its places changes length."""
    out = []
    for s, need in Counter(chosen).items():
        live = [k for _, k in members[s] if k > 0]
        out.append(max(1, live[0] // need))
    return out


def _use(runs: list[list[int]], n: int, count: int) -> None:
    for run in runs:
        if run[0] == n and run[1] > 0:
            k = min(run[1], count)
            run[1] -= k
            count -= k
            if not count:
                break
    while runs and runs[0][1] == 0:
        runs.pop(0)


def pieces(docs: DataFrame, capacity: int, path: str, end_id: int = 1) -> DataFrame:
    """A row per piece of at most `capacity` tokens, with its partition and its
    rank there among pieces of its length."""

    def run(batches):
        bpe, end = opened(path), int(end_id).to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = bpe.encode_bytes(text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at : at + 4 * capacity]
                    n = len(raw) // 4
                    for c, v in zip(cols, (doc, i, at // 4, n, zlib.crc32(raw), part, seen[n]), strict=True):
                        c.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset per piece.

    Every row of docs is packed, repeated ones too; null text is empty and
    takes one token, the end. An empty table gives an empty result. Only
    documents longer than the capacity are cut.
    """
    spark = docs.sparkSession
    found = staged(pieces(docs, capacity, path or vocabulary_path()), "packing-pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    # A row per partition and length at most; the window runs over partitions of one length.
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranges = sorted(best_plan(histogram, capacity, groups, large))
    table = np.array(ranges, "int64").reshape(-1, 5)
    starts = table[:, 0] * (1 << 44) + table[:, 1]
    shared = spark.sparkContext.broadcast((starts, table[:, 1], table[:, 3], table[:, 4]))  # bounded by the capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches):
        starts, first, base, offset = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(base[at] + rank - first[at]), pa.array(offset[at])], names=names)

    ranked = found.join(before, ["part", "length"]).select(*names[:5], (F.col("before") + F.col("nth")).alias("rank"))
    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
