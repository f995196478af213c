"""Stratified cluster bootstrap as Spark jobs (EST-1, EST-2).

Rows collapse to (stratum, cluster) units first. A stratum with m units gets m
draws per replicate. Units are laid out in blocks of a few thousand. How many
draws of a replicate fall into a block follows from a tree of binomial splits of
the stratum's blocks: each node deals its draws over its two halves, keyed by
seed and node, so every block finds its own numbers by walking from the root, and
together they are exactly multinomial(m, 1/m). No draw is a row: a task goes
through its blocks in order, keeps the nodes that the next block shares, and only
replicate totals over its blocks leave it. A stratum of any size spreads over its
blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.functions.hashing import hash60
from threadgauge.operators.spread import hash_rank  # noqa: F401  the order of units by which tests find them
from threadgauge.session import cut_lineage

BLOCK = 4096
REPLICATES = 2000
POINT = -1
# Numbers in a task's working arrays: replicates go through a block in pieces of a fraction of this size.
CELLS = 1 << 21
# Draws made at a time, and cells per unit's cell up to which a product with a full table is faster.
DRAWS = 1 << 17
DENSE = 24
# Fixed values of the draw stream: golden-ratio step and a 27-bit mixing factor.
STEP = 2654435769
MIX = 73244475


def collapse(rows: DataFrame, values: Sequence[str], entity: Sequence[str] = (), stratum: str = "stratum", cluster: str = "cluster") -> DataFrame:
    """Sums per (stratum, cluster, entity): the unit table (EST-1)."""
    return rows.groupBy(
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("cluster"), *entity,
    ).agg(*[F.sum(F.col(v).cast("double")).alias(v) for v in values])


class Splits:
    """Walks the trees of binomial splits for one task; the nodes above the last block are kept, so neighbours share them."""

    def __init__(self, seed: int, n_rep: int, block: int = BLOCK, fewer: int = 0):
        self.seed, self.n_rep, self.block, self.fewer = seed, n_rep, block, fewer
        self.tree: tuple[str, int] | None = None
        self.path: list[tuple[int, int, np.ndarray]] = []

    def counts(self, stratum: str, number: int, m: int) -> np.ndarray:
        """Draws of each replicate in block ``number`` of a stratum of ``m`` units."""
        block = self.block
        if self.tree != (stratum, m):
            self.tree, self.path = (stratum, m), [(0, -(-m // block), np.full(self.n_rep, max(m - self.fewer, 0), dtype=np.int64))]
        while not self.path[-1][0] <= number < self.path[-1][1]:
            self.path.pop()
        low, high, n = self.path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            share = (middle - low) * block / (min(high * block, m) - low * block)
            key = int(hashlib.md5(f"{self.seed}|split|{stratum}|{low}|{high}".encode()).hexdigest(), 16)
            left = np.random.Generator(np.random.Philox(key=key)).binomial(n, share)
            self.path[-1] = (low, high, n)
            # The right half stays below the left one, so the next block finds it.
            self.path.append((middle, high, n - left))
            if number < middle:
                self.path.append((low, middle, left))
            low, high, n = self.path[-1]
        return n


def split_counts(seed: int, stratum: str, number: int, m: int, n_rep: int, block: int = BLOCK, fewer: int = 0) -> np.ndarray:
    """Draws of each replicate in block ``number`` of a stratum of ``m`` units.

    All blocks below a node repeat the same draw for it, so the numbers of a
    replicate add up to m - fewer. More replicates do not change the first ones.
    """
    return Splits(seed, n_rep, block, fewer).counts(stratum, number, m)


def slot_counts(seed: int, stratum: str, number: int, size: int, reps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(replicates x slots): how often each slot of a block is drawn when ``n`` draws fall into it.

    Draws are 32-bit words that wrap around, some replicates at a time so that they stay in the processor's cache.
    """
    out = np.zeros((len(reps), size))
    if not len(reps) or not n.any():
        return out
    rest = f"|{stratum}|{number}".encode()
    base = np.frombuffer(b"".join([hashlib.md5(b"%d|%d%b" % (seed, r, rest)).digest()[:4] for r in reps.tolist()]), dtype=">u4").astype(np.uint32)
    steps = np.arange(n.max(), dtype=np.uint32) * np.uint32(STEP)
    at_once = max(1, DRAWS // len(steps))
    for first in range(0, len(reps), at_once):
        part = n[first : first + at_once]
        x = base[first : first + at_once, None] + steps
        y = np.empty_like(x)
        for _ in range(2):
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(MIX), out=x)
        np.right_shift(x, 16, out=y)
        np.bitwise_xor(x, y, out=x)
        if size & (size - 1):
            np.floor_divide(x, np.uint32(size), out=y)
            np.multiply(y, np.uint32(size), out=y)
            np.subtract(x, y, out=x)
        else:
            np.bitwise_and(x, np.uint32(size - 1), out=x)
        # Draws beyond a replicate's number go to a slot of their own.
        wide = size + 1 if part.min() < len(steps) else size
        if wide > size:
            np.copyto(x, np.uint32(size), where=np.arange(len(steps)) >= part[:, None])
        place = x + np.arange(len(part), dtype=np.int64)[:, None] * wide
        out[first : first + at_once] = np.bincount(place.ravel(), minlength=len(part) * wide).reshape(len(part), wide)[:, :size]
    return out


class _Totals:
    """Replicate totals of the cells a task has met: replicates x values per cell, at most about ``CELLS`` numbers unless one block has more."""

    def __init__(self, entity: list[str], values: list[str], n_rep: int):
        self.entity, self.values, self.width = entity, values, (n_rep + 1) * len(values)
        self.rows: dict[tuple, int] = {}
        self.sums = np.empty((0, self.width))

    def add(self, cells: list[tuple], totals: np.ndarray) -> None:
        """Adds (cells x values x replicates); a total that is not a number counts as missing."""
        new = [c for c in cells if c not in self.rows]
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            if len(self.rows) > len(self.sums):
                grown = np.empty((2 * len(self.rows), self.width))
                grown[: len(self.sums)] = self.sums
                self.sums = grown
            self.sums[len(self.rows) - len(new) : len(self.rows)] = np.nan
        at = [self.rows[c] for c in cells]
        held, totals = self.sums[at], totals.reshape(len(cells), self.width)
        both = held + totals
        gap = np.isnan(both)
        if gap.any():
            both[gap] = np.where(np.isnan(held), totals, held)[gap]
        self.sums[at] = both

    def full(self) -> bool:
        return len(self.rows) * self.width > CELLS

    def take(self) -> Iterator[pa.RecordBatch]:
        """The totals as rows (rep, *entity, *values), one batch per some cells; none are held afterwards."""
        cells, n_rep = list(self.rows), self.width // len(self.values)
        for first in range(0, len(cells), 64):
            part = cells[first : first + 64]
            sums = self.sums[first : first + len(part)].reshape(len(part), len(self.values), n_rep)
            owner = pa.array(np.repeat(np.arange(len(part)), n_rep))
            columns = [pa.array(np.tile(np.arange(POINT, n_rep - 1, dtype=np.int32), len(part)))]
            columns += [pa.array([c[i] for c in part], pa.string()).take(owner) for i in range(len(self.entity))]
            columns += [pa.array(sums[:, j].ravel(), from_pandas=True) for j in range(len(self.values))]
            yield pa.RecordBatch.from_arrays(columns, ["rep", *self.entity, *self.values])
        self.rows, self.sums = {}, np.empty((0, self.width))


def _block_totals(
    splits: Splits, stratum: str, number: int, m: int, slots: np.ndarray, code: np.ndarray, n_cells: int, amounts: list[np.ndarray],
) -> np.ndarray:
    """(cells x values x replicates) of units in one block, the plain totals first; a slot has a cell at most once."""
    size, n_rep = min(splits.block, m - number * splits.block), splits.n_rep
    out = np.empty((n_cells, len(amounts), n_rep + 1))
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(n_cells))
    slots, code, amounts = slots[order], code[order], [a[order] for a in amounts]
    # Few cells, each on many slots: a product of matrices; else only the cells that a slot has.
    dense = size * n_cells <= DENSE * len(slots)
    if dense:
        table = np.zeros((size, n_cells * len(amounts)))
        for j, amount in enumerate(amounts):
            table[slots, code * len(amounts) + j] = amount
    for j, amount in enumerate(amounts):
        out[:, j, 0] = np.add.reduceat(amount, starts)
    n = splits.counts(stratum, number, m)
    at_once = max(1, CELLS // (4 * max(size, len(slots), int(n.max(initial=0)))))
    for first in range(0, n_rep, at_once):
        last = min(first + at_once, n_rep)
        drawn = slot_counts(splits.seed, stratum, number, size, np.arange(first, last), n[first:last])
        if dense:
            out[:, :, first + 1 : last + 1] = (drawn @ table).T.reshape(n_cells, len(amounts), last - first)
        else:
            taken = drawn[:, slots]
            for j, amount in enumerate(amounts):
                out[:, j, first + 1 : last + 1] = np.add.reduceat(taken * amount, starts, axis=1).T
    return out


def _blocks(batches: Iterator[pa.RecordBatch], entity: list[str], values: list[str], n_rep: int, seed: int, block: int, fewer: int) -> Iterator[pa.RecordBatch]:
    """Totals of the blocks of a partition sorted by place; only the open block is held."""
    splits, totals = Splits(seed, n_rep, block, fewer), _Totals(entity, values, n_rep)

    def close(parts: list[pa.RecordBatch]) -> None:
        run = pa.Table.from_batches(parts)
        stratum, m, pos = run["stratum"][0].as_py(), run["m"][0].as_py(), run["pos"].to_numpy()
        number = int(pos[0]) // block
        lists = run["cells"].combine_chunks()
        slots = np.repeat(pos - number * block, lists.value_lengths().to_numpy(zero_copy_only=False))
        fields = lists.flatten()
        fields = [fields.field(i) for i in range(len(entity) + len(values))]
        code, known = np.zeros(len(slots), dtype=np.int64), [()]
        for column in fields[: len(entity)]:
            coded = pc.dictionary_encode(column, null_encoding="encode")
            names = coded.dictionary.to_pylist()
            found, code = np.unique(code * len(names) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            known = [(*known[f // len(names)], names[f % len(names)]) for f in found.tolist()]
        amounts = [column.to_numpy(zero_copy_only=False) for column in fields[len(entity) :]]
        totals.add(known, _block_totals(splits, stratum, number, m, slots, code, len(known), amounts))

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        names = pc.dictionary_encode(batch.column("stratum"))
        number, which = batch.column("pos").to_numpy() // block, names.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(which) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            key = (names.dictionary[int(which[low])].as_py(), int(number[low]))
            if held and key != last:
                close(held)
                held = []
                if totals.full():
                    yield from totals.take()
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        close(held)
    yield from totals.take()


def resample(
    rows: DataFrame, values: Sequence[str], entity: Sequence[str] = (), n_rep: int = REPLICATES, seed: int = 0,
    stratum: str = "stratum", cluster: str = "cluster", block: int = BLOCK, fewer: int = 0,
) -> DataFrame:
    """(rep, *entity, *values): replicate totals; rep -1 holds the plain totals (EST-2).

    All entities and values share the draws of a replicate. ``fewer`` makes
    m - fewer draws per stratum. A unit is one row with its entities; units are
    dealt to ranges of (stratum, hash, cluster) and written once in that order, so
    a unit's place is its place in the range after the units of earlier ranges.
    """
    entity, values = list(entity), list(values)
    if "stratum" in entity:
        rows = rows.withColumn("stratum_key", F.col(stratum).cast("string"))
        keys = ["stratum_key" if e == "stratum" else e for e in entity]
        return resample(rows, values, keys, n_rep, seed, stratum, cluster, block, fewer).withColumnRenamed("stratum_key", "stratum")
    keyed = rows.select(
        F.col(stratum).alias("stratum"), F.col(cluster).alias("cluster"),
        *[F.col(e).cast("string").alias(e) for e in entity], *values,
    )
    units = collapse(keyed, values, entity)
    cell = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*entity, *values])])
    units = units.groupBy("stratum", "cluster").agg(F.collect_list(cell).alias("cells")) if entity else units.select("stratum", "cluster", F.array(cell).alias("cells"))
    session = rows.sparkSession
    # A few rows here stand for very many draws: fix the task count, since the
    # adaptive planner would merge tasks that look small.
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    order = ["stratum", "__h", "cluster"]
    dealt = units.withColumn("__h", hash60(seed, F.col("stratum"), F.col("cluster"))).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.select("stratum", "cells", F.spark_partition_id().alias("__b"), F.monotonically_increasing_id().alias("__at")))
    # One row per stratum and range, so about as many as strata and tasks together.
    ranges = dealt.groupBy("stratum", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy("stratum")
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("stratum", "__b", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__off"), F.sum("__n").over(whole).alias("m"))
    located = dealt.join(F.broadcast(offsets), ["stratum", "__b"]).select("stratum", (F.col("__at") + F.col("__off")).alias("pos"), "m", "cells")
    # A block is one task's: a cell with a value missing is missing in its whole block.
    number = F.floor(F.col("pos") / block)
    located = located.repartition(tasks, "stratum", number).sortWithinPartitions("stratum", "pos")
    ddl = ", ".join(["rep int", *[f"`{e}` string" for e in entity], *[f"`{v}` double" for v in values]])
    work = partial(_blocks, entity=entity, values=values, n_rep=n_rep, seed=seed, block=block, fewer=fewer)
    # Written too: replicates x entities rows, which callers filter, join and aggregate several times.
    return cut_lineage(located.mapInArrow(work, ddl).groupBy("rep", *entity).agg(*[F.sum(v).alias(v) for v in values]))


def interval(reps: DataFrame, keys: Sequence[str], value: str, sparse_below: int | None = 30, n: str | None = None) -> DataFrame:
    """Point value and 2.5/25/75/97.5 percentiles of the finite replicates (EST-4).

    A group holds one value per replicate, so its size is the replicate count.
    """
    v = F.when(~F.isnan(value), F.col(value))
    points = F.percentile(F.when(F.col("rep") >= 0, v), F.array(*[F.lit(q) for q in (0.025, 0.25, 0.75, 0.975)])).alias("__q")
    aggs = [F.max(F.when(F.col("rep") == POINT, v)).alias("est"), points]
    if n is not None:
        aggs.append(F.max(F.when(F.col("rep") == POINT, F.col(n))).cast("bigint").alias("n"))
    out = reps.groupBy(*keys).agg(*aggs)
    for i, name in enumerate(("lo95", "lo50", "hi50", "hi95")):
        out = out.withColumn(name, F.when(F.col("est").isNotNull(), F.col("__q")[i]))
    if n is not None and sparse_below is not None:
        out = out.withColumn("sparse", F.coalesce(F.col("n") < sparse_below, F.lit(True)))
    return out.drop("__q")


def estimate_struct(df: DataFrame, name: str = "estimate") -> DataFrame:
    """Interval columns packed into the estimate object."""
    parts = ["est", "lo50", "hi50", "lo95", "hi95", "n", "sparse"]
    return df.withColumn(name, F.struct(*parts)).drop(*parts)


def finite_ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def ratio_replicates(
    rows: DataFrame, pairs: dict[str, tuple[Column, Column]], by: Sequence[str] = (), weight: str | None = "weight",
    within: bool = False, **options,
) -> DataFrame:
    """(rep, *by, name, ratio, n): Σw·num/Σw·den per named pair (EST-3).

    With ``within`` every ``by`` cell resamples its own units, otherwise all
    cells share the draws over all units. ``n`` counts rows with a numerator.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    values, selected = [], []
    for name, (num, den) in pairs.items():
        num, den = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (num, den))
        selected += [(w * num).alias(f"a_{name}"), (w * den).alias(f"d_{name}"), F.when(num > 0, 1.0).otherwise(0.0).alias(f"n_{name}")]
        values += [f"a_{name}", f"d_{name}", f"n_{name}"]
    strata = F.concat_ws("~", *[F.col(b).cast("string") for b in by], F.col("stratum").cast("string")) if within and by else F.col("stratum")
    flat = rows.select(strata.alias("stratum"), F.col("cluster"), *by, *selected)
    reps = resample(flat, values, by, **options)
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), finite_ratio(F.col(f"a_{n}"), F.col(f"d_{n}")).alias("ratio"), F.col(f"n_{n}").alias("n")) for n in pairs
    ])).alias("c")
    return reps.select("rep", *by, cells).select("rep", *by, "c.*")


def ratio_estimates(rows: DataFrame, pairs: dict[str, tuple[Column, Column]], by: Sequence[str] = (), **options) -> DataFrame:
    """Intervals for every named ratio (EST-3, EST-4)."""
    return interval(ratio_replicates(rows, pairs, by, **options), [*by, "name"], "ratio", n="n")


ALL_KEY = "*"


def share_replicates(rows: DataFrame, level: str, buckets: Column | None = None, within: bool = False, weight: str = "weight", **options) -> DataFrame:
    """(rep, bucket, id, share, n): weighted share of each value of ``level``.

    The denominator is every row of the bucket, placed or not. ``buckets`` is an
    array column naming the buckets a row belongs to.
    """
    return level_replicates(rows, [level], buckets, within, weight, **options).drop("level")


def level_replicates(
    rows: DataFrame, levels: Sequence[str], buckets: Column | None = None, within: bool = False, weight: str = "weight", **options,
) -> DataFrame:
    """(rep, level, bucket, id, share, n): the shares of several levels on the same draws, which are made once."""
    array = F.array(F.lit("all")) if buckets is None else buckets
    base = rows.withColumn("bucket", F.explode(array)).filter("bucket IS NOT NULL")
    strata = F.concat_ws("~", "bucket", F.col("stratum").cast("string")) if within else F.col("stratum")
    named = [(F.lit(ALL_KEY), F.lit(ALL_KEY)), *[(F.lit(c), F.col(c).cast("string")) for c in levels]]
    each = F.inline(F.array(*[F.struct(name.alias("level"), value.alias("id")) for name, value in named]))
    long = base.select(strata.alias("stratum"), "cluster", "bucket", each, F.col(weight).alias("x"), F.lit(1.0).alias("n")).filter("id IS NOT NULL")
    reps = resample(long, ["x", "n"], ["bucket", "level", "id"], **options)
    den = reps.filter(F.col("level") == ALL_KEY).select("rep", "bucket", F.col("x").alias("__den"))
    num = reps.filter(F.col("level") != ALL_KEY)
    return num.join(den, ["rep", "bucket"]).select("rep", "level", "bucket", "id", finite_ratio(F.col("x"), F.col("__den")).alias("share"), "n")
