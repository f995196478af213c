"""Packing token documents into sequences of fixed length.

A packing only depends on how many pieces there are of each length, and a
sequence has at most 1,024 lengths. So the plan is made on that histogram,
whose size does not grow with the data: Martello and Toth's dominance criterion
fixes piece sets for whole classes of equal lengths, best fit decreasing packs
what is left, again class by class. Pieces then find their place by their rank
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.llm.bpe import _blocks
from threadgauge.llm.common import sole, written
from threadgauge.llm.tokens import REMEMBERED, library_coder

CAPACITY = 1024
END = 2
RANKED_AT_ONCE = 4096
# Characters of text that a worker cuts at once: what it holds beside them is some 40 times as large.
CUT_AT_ONCE = 1 << 20


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    coder = library_coder(path, REMEMBERED)
    for batch in batches:
        for at, texts in _blocks(batch, "text", CUT_AT_ONCE):
            ids, counts = coder.encode(texts, end)
            first = (counts - 1) % capacity + 1
            pieces = (counts - first) // capacity + 1
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[owner], capacity)
            begin = 4 * ((np.cumsum(counts) - counts)[owner] + start)
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at + owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def cut(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; a document is its ids and the end id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(partial(_cut, path=path, end=end, capacity=capacity), schema)


class _Stock:
    """Numbers of pieces by length, with the lengths that are left in order."""

    def __init__(self, counts: Mapping[int, int]):
        self.n = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, most: int, without: int | None = None) -> int | None:
        """The largest length up to ``most`` when one piece of length ``without`` is set aside."""
        at = bisect_left(self.sizes, most + 1) - 1
        if at >= 0 and self.sizes[at] == without and self.n[without] < 2:
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest(self, k: int, without: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - (s == without))
            if len(out) == k:
                break
        return out


def _dominant(stock: _Stock, size: int, capacity: int) -> list[int] | None:
    """Partners of a piece of length ``size`` in a set that dominates every other set with that piece, if one is known.

    A set dominates another when the other's pieces can be grouped so that each
    group is no longer than its own piece of the set. With room for no partner,
    for one at most, or with a partner that fills the sequence, the largest
    partner does. With room for two, the largest partner does if it is at least
    as long as the best two together.
    """
    room = capacity - size
    best = stock.largest(room, size)
    if best is None:
        return []
    if best == room:
        return [best]
    least = stock.smallest(3, size)
    if len(least) < 2 or least[0] + least[1] > room:
        return [best]
    if len(least) == 3 and sum(least) <= room:
        return None
    pair = 0
    for first in stock.sizes:
        spare = stock.n[first] - (first == size)
        if spare < 1 or first >= room:
            continue
        at = bisect_left(stock.sizes, room - first + 1) - 1
        while at >= 0:
            second = stock.sizes[at]
            if stock.n[second] - (second == size) - (second == first) > 0:
                pair = max(pair, first + second)
                break
            at -= 1
    return [best] if best >= pair else None


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) that use up ``counts`` pieces of each length from 1 to ``capacity``.

    Lengths from large to small: a dominating set is fixed as often as its
    lengths last, since taking pieces away never makes a larger partner or pair
    possible. A smaller instance can uncover further sets, so passes repeat
    until one fixes nothing. Best fit decreasing packs the rest.
    """
    stock, done = _Stock(counts), {}

    def fix(lengths: tuple[int, ...], n: int) -> None:
        done[lengths] = done.get(lengths, 0) + n

    fixed = True
    while fixed and stock.sizes:
        fixed = False
        for size in reversed(stock.sizes[:]):
            while size in stock.n:
                partners = _dominant(stock, size, capacity)
                if partners is None:
                    break
                fixed = True
                if not partners:
                    fix((size,), stock.n[size])
                    stock.take(size, stock.n[size])
                    continue
                other = partners[0]
                n = stock.n[size] // 2 if other == size else min(stock.n[size], stock.n[other])
                stock.take(size, 2 * n if other == size else n)
                if other != size:
                    stock.take(other, n)
                fix((size, other), n)
    for lengths, n in _best_fit(stock, capacity):
        fix(lengths, n)
    return sorted(done.items())


def _best_fit(stock: _Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing for whole classes: equal pieces go into equal open sequences together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in open_:
            rooms.insert(bisect_left(rooms, room), room)
            open_[room] = []
        open_[room].append((lengths, n))

    for size in reversed(stock.sizes):
        left = stock.n[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                fill = min(capacity // size, left)
                whole = left // fill
                put(capacity - fill * size, (size,) * fill, whole)
                left -= whole * fill
                continue
            room = rooms[at]
            lengths, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            used = min(n, left)
            if n > used:
                put(room, lengths, n - used)
            put(room - size, (*lengths, size), used)
            left -= used
    return [x for group in open_.values() for x in group]


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the pieces of each length go, by rank from 0."""
    out, used, base = [], {}, 0
    for lengths, n in sequences:
        offset = 0
        for size in lengths:
            out.append((size, used.get(size, 0), n, base, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        base += n
    return out


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their rank from 0 among pieces of their length; a frequent length is cut into hash buckets."""
    keys = ["length", "bucket"]
    sizes = pieces.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / RANKED_AT_ONCE).alias("buckets"))
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    ).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, keys)
    return ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("bucket", "first")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver,
    and the table of slots that comes back is bounded by ``capacity`` too, however
    many pieces there are. Equal rows have places of their own.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = np.array(sorted(slots(plan(counts, capacity))), dtype=np.int64).reshape(-1, 5)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return _ranked(pieces).mapInArrow(partial(_place, places=found), schema)


def _place(batches: Iterator[pa.RecordBatch], places: np.ndarray) -> Iterator[pa.RecordBatch]:
    sole("places", int)  # lets go of what an earlier operator remembered
    keys = places[:, 0] << 48 | places[:, 1]
    for batch in batches:
        rank = batch.column("rank").to_numpy()
        slot = places[np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, side="right") - 1]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], [*names, "sequence_id", "offset"]
        )


def best_fit_pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, capacity: int = CAPACITY
) -> DataFrame:
    """Every piece of every document with its sequence and place.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null
    and empty texts are the end id alone. Documents longer than ``capacity`` are
    cut so that only their first piece is shorter. Repeated rows are packed each;
    other columns are ignored; no rows give no rows.
    """
    return pack(written(cut(docs, path, id_col, text_col, end, capacity), "pieces"), capacity)
