"""Near-duplicate documents: 64-bit SimHash, Golay-code fuzzy hashing and verification.

Candidates. A fingerprint has four 16-bit segments. With at most three differing
bits one segment has no error, and the other 48 bits, cut into two windows of 23
bits and two bits that no window needs, hold at most three errors, so one window
has at most one. A key is therefore an exact segment with the 12-bit index of a
codeword of the perfect [23, 12] Golay code. For each of the eight (segment,
window) choices a fingerprint gets the indices that its window decodes to with
no bit or any one bit changed (one to six of them), so two fingerprints within
three bits always share a key.

Verification. Fingerprints of a key lie side by side after a sort; their real
distance is tested there and only a spanning forest of the links of a key leaves
the task, so a group of near copies costs edges in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgauge.llm.common import free_name, lookup, sole, whole_text, written
from threadgauge.llm.components import components

SEED = 42
WORDS = 3
MAX_BITS = 3
WINDOW = 23
# Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
BLOCK = 65536
SHORT_RUN = 16
_BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text in UTF-8 as a signed 64-bit integer.

    A-Z become lower case; words are runs of other than ASCII white space;
    shingles of ``words`` words keep their repeats. A text of fewer words is one
    shingle; one without words has fingerprint zero.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    sole("prints", int)  # lets go of what an earlier operator remembered
    for batch in batches:
        texts = batch.column("text")
        prints = pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; null text is empty and has fingerprint zero."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, words=words), "doc_id bigint, fp bigint")


def _indices() -> np.ndarray:
    return sole("golay", _decoded)


def _decoded() -> np.ndarray:
    """For each of the 2^23 words, the 12-bit index of the nearest codeword."""
    def remainder(word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for bit in range(WINDOW - 1, 10, -1):
            word = np.where(word >> bit & 1, word ^ (GOLAY << (bit - 11)), word)
        return word

    ones = [1 << i for i in range(WINDOW)]
    errors = [0, *ones]
    errors += [a | b for i, a in enumerate(ones) for b in ones[i + 1 :]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[i + 1 :], i + 1) for c in ones[j + 1 :]]
    patterns = np.array(errors, dtype=np.uint32)
    fix = np.zeros(2048, dtype=np.uint32)
    fix[remainder(patterns)] = patterns
    out = np.empty(1 << WINDOW, dtype=np.uint16)
    for at in range(0, 1 << WINDOW, 1 << 20):
        words = np.arange(at, at + (1 << 20), dtype=np.uint32)
        out[at : at + (1 << 20)] = (words ^ fix[remainder(words)]) >> 11
    return out


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, segment key, full key) of every key; the segment key is a prefix of the full key."""
    index, value = _indices(), prints.view(np.uint64)
    flips = np.array([0] + [1 << i for i in range(WINDOW)], dtype=np.uint32)
    rows, segments, keys = [], [], []
    for segment in range(4):
        exact = (value >> np.uint64(16 * segment)) & np.uint64(0xFFFF)
        low = np.uint64((1 << 16 * segment) - 1)
        above = np.uint64(min(63, 16 * (segment + 1)))
        rest = value & low
        if segment < 3:
            rest = rest | (value >> above) << np.uint64(16 * segment)
        prefix = (np.uint64(segment) << np.uint64(16) | exact).astype(np.int64)
        for window in range(2):
            word = (rest >> np.uint64((WINDOW + 1) * window)) & np.uint64((1 << WINDOW) - 1)
            near = index[word.astype(np.uint32)[:, None] ^ flips[None, :]].astype(np.int64)
            near[:, 1:].sort(axis=1)
            fresh = np.ones(near.shape, dtype=bool)
            fresh[:, 2:] = near[:, 2:] != near[:, 1:-1]
            fresh[:, 1:] &= near[:, 1:] != near[:, :1]
            row, place = np.nonzero(fresh)
            rows.append(row)
            segments.append(prefix[row])
            keys.append((prefix[row] << 13) | (window << 12) | near[row, place])
    return np.concatenate(rows), np.concatenate(segments), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy()
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            row, segment, key = golay_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(key), pa.array(part[row])], ["segment", "key", "fp"])


def _forest(points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``points`` (distinct); each point is compared with those not yet reached."""
    left, a, b = points, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), dtype=bool)
            for point in front:
                near = ~reached
                near[near] = np.bitwise_count(left[near] ^ point) <= max_bits
                a.append(np.full(near.sum(), point))
                b.append(left[near])
                reached |= near
                if reached.all():
                    break
            front, left = left[reached], left[~reached]
    empty = np.empty(0, dtype=np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _run_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal (sorted) keys: all pairs of short runs, a spanning forest of long ones."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    short = np.repeat(lengths <= SHORT_RUN, lengths)
    k, f, a, b = key[short], fp[short], [], []
    for step in range(1, SHORT_RUN):
        if len(k) <= step:
            break
        near = (k[step:] == k[:-step]) & (f[step:] != f[:-step])
        near[near] = np.bitwise_count(f[step:][near] ^ f[:-step][near]) <= max_bits
        a.append(f[step:][near])
        b.append(f[:-step][near])
    for at, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN], strict=True):
        x, y = _forest(np.unique(fp[at : at + n]), max_bits)
        a.append(x)
        b.append(y)
    empty = np.empty(0, dtype=np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each key of a partition sorted by key; only the run at the end of a batch is carried over."""
    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _run_links(key, fp, max_bits)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(key):
            continue
        change = np.flatnonzero(key[1:] != key[:-1])
        if held and key[0] == held[0][0][0] and not len(change):
            held.append((key, fp))
            continue
        if held and key[0] != held[0][0][0]:
            cut = 0
        else:
            cut = change[0] + 1 if len(change) and held else 0
        if held:
            held.append((key[:cut], fp[:cut]))
            yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        last = change[-1] + 1 if len(change) else 0
        last = max(last, cut)
        if last > cut:
            yield out(key[cut:last], fp[cut:last])
        held = [(key[last:], fp[last:])]
    if held:
        yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what lies within ``max_bits`` (at most 3) bits; ``prints`` has distinct fp.

    A segment value shared by more than ``block`` fingerprints is cut into blocks
    by hash and each pair of blocks is its own key, so no task grows with a group.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"Golay keys hold for at most {MAX_BITS} differing bits")
    segments = [F.shiftright("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) + F.lit(i << 16) for i in range(4)]
    hot = (
        prints.select(F.explode(F.array(*segments)).alias("segment"))
        .groupBy("segment").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        .select("segment", F.ceil(F.col("n") / block).alias("blocks"))
    )
    keys = prints.mapInArrow(_keys, "segment bigint, key bigint, fp bigint")
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
        keys = keys.join(hot, "segment", "left").select(
            F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(cut)).alias("key"), "fp"
        )
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(partial(_links, max_bits=max_bits), "a bigint, b bigint")


def _classes(prints: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(fp, class, least doc_id, rows) of every distinct fp of (doc_id, fp) rows."""
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    joined = written(components(links(groups.select("fp"), max_bits)), "labels").withColumnRenamed("node", "fp")
    labelled = groups.join(joined, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = joined.join(groups, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    return groups, labelled.join(least, "label", "left").select(
        "fp", "n", "label", F.coalesce("component_id", "least").alias("component_id")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fp, label, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included (null ids are passed over; null if all are). Null and empty texts
    and texts of white space have fingerprint zero and link like any other;
    repeated rows share a class; other columns are ignored; no rows give no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "docs")
    _, classes = _classes(prints, max_bits)
    return lookup(prints, written(classes, "classes"), "fp", "n").select("doc_id", "fp", "label", "component_id")


def fingerprint_hex(column: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest id, nulls last, then any one of equal rows.

    The result has the columns of ``docs``.
    """
    row = free_name(docs, "__row")
    tagged = written(docs.withColumn(row, F.monotonically_increasing_id()), "kept")
    prints = written(fingerprints(tagged.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", words), "docs")
    _, classes = _classes(prints, max_bits)
    ids = tagged.select(F.col(row).alias("doc_id"), F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row).alias("row")).alias("rank"))
    labels = lookup(prints, written(classes, "classes"), "fp", "n").select("doc_id", "label")
    ranked = written(labels.join(ids, "doc_id"), "ranks")
    first = ranked.groupBy("label").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    return tagged.join(first, row, "left_semi").drop(row)
