"""Token files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file is a run of zstandard frames followed by one skippable frame with the
seek table: for each frame its compressed size, its size and the low 32 bits of
the XXH64 of its content, then the number of frames, a descriptor byte and a
magic number. Any zstandard reader skips the table; ours reads it from the end
of the file and decompresses only the frames that hold the wanted documents.
Which documents a frame holds is in its own head, so a file explains itself.

Content of a frame: number of documents, then per document its id (with a flag
for null) and number of ids, then all ids; everything little-endian, ids as
unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadgauge.llm.bpe import _blocks
from threadgauge.llm.common import written
from threadgauge.llm.tokens import REMEMBERED, library_coder

END = 1
FRAME_BYTES = 1 << 18
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
_HEAD = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("n", "<u4")])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def frame(docs: Sequence[tuple[int | None, bytes]]) -> bytes:
    """Content of a frame that holds (doc_id, ids) documents."""
    head = np.zeros(len(docs), dtype=_HEAD)
    head["doc_id"] = [d or 0 for d, _ in docs]
    head["null"] = [d is None for d, _ in docs]
    head["n"] = [len(ids) // 4 for _, ids in docs]
    return struct.pack("<I", len(docs)) + head.tobytes() + b"".join(ids for _, ids in docs)


def unframe(content: bytes) -> list[tuple[int | None, bytes]]:
    (count,) = struct.unpack_from("<I", content)
    head = np.frombuffer(content, dtype=_HEAD, count=count, offset=4)
    ends = 4 + head.nbytes + np.cumsum(4 * head["n"].astype(np.int64))
    return [
        (None if h["null"] else int(h["doc_id"]), content[end - 4 * int(h["n"]) : end]) for h, end in zip(head, ends.tolist(), strict=True)
    ]


class FrameWriter:
    """Writes frames to an open binary sink and the seek table at its end."""

    def __init__(self, sink, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):  # noqa: ANN001
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.about: list[tuple[int, int, int | None, int | None, bool]] = []
        self.held: list[tuple[int | None, bytes]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append((doc_id, ids))
        self.size += len(ids) + _HEAD.itemsize
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            content = frame(self.held)
            packed = self.compressor.compress(content)
            self.sink.write(packed)
            self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            known = [d for d, _ in self.held if d is not None]
            ids = sum(len(i) for _, i in self.held) // 4
            self.about.append((len(self.held), ids, min(known, default=None), max(known, default=None), len(known) < len(self.held)))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Reads single frames of an open random-access file of ``size`` bytes."""

    def __init__(self, source, size: int):  # noqa: ANN001
        self.source = source
        source.seek(size - _FOOTER.size)
        count, descriptor, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEKABLE or descriptor != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        at = size - _FOOTER.size - count * _ENTRY.size
        source.seek(at - 8)
        head = source.read(8 + count * _ENTRY.size)
        if struct.unpack_from("<II", head) != (SKIPPABLE, count * _ENTRY.size + _FOOTER.size):
            raise ValueError("damaged seek table")
        self.entries = list(_ENTRY.iter_unpack(head[8:]))
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)]).tolist()
        self.decompressor = zstandard.ZstdDecompressor()

    def documents(self, k: int) -> list[tuple[int | None, bytes]]:
        """The documents of frame ``k``, after checking its checksum."""
        packed, size, check = self.entries[k]
        self.source.seek(self.starts[k])
        content = self.decompressor.decompress(self.source.read(packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        return unframe(content)


_MANIFEST = "part int, file string, frame int, docs bigint, ids bigint, at bigint, least bigint, most bigint, nulls boolean"


def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, end: int) -> Iterator[pa.RecordBatch]:
    """One file per task under a name of its own attempt; only the rows that a finished task returns name it."""
    context = TaskContext.get()
    part = context.partitionId()
    name = f"{folder}/part-{part:06d}-{context.taskAttemptId()}.zst"
    writer = sink = None
    for batch in batches:
        for at, texts in _blocks(batch, "text"):
            if writer is None:
                system, inner = place(name)
                system.create_dir(place(folder)[1], recursive=True)
                sink = system.open_output_stream(inner, compression=None)
                writer = FrameWriter(sink)
            names = batch.column("doc_id").slice(at, len(texts)).to_pylist()
            ids, counts = library_coder(path, REMEMBERED).encode(texts, end)
            ends = np.cumsum(counts)
            for doc_id, i, j in zip(names, (ends - counts).tolist(), ends.tolist(), strict=True):
                writer.add(doc_id, ids[i:j].tobytes())
    if writer is None:
        return
    writer.close()
    sink.close()
    rows, at = [], 0
    for k, (docs, ids, least, most, nulls) in enumerate(writer.about):
        rows.append({"part": part, "file": name, "frame": k, "docs": docs, "ids": ids, "at": at, "least": least, "most": most, "nulls": nulls})
        at += ids
    types = {"part": pa.int32(), "file": pa.string(), "frame": pa.int32(), "nulls": pa.bool_()}
    schema = pa.schema([(c, types.get(c, pa.int64())) for c in rows[0]])
    yield from pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=10_000)


def write_frames(
    docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, files: int | None = None
) -> DataFrame:
    """Encode texts, write them to files below ``folder`` in ascending id order, return the manifest.

    The manifest has a row per frame: part, file, frame, docs, ids, least and
    most doc_id, whether it has null ids, and ``first_id`` (ids in all earlier
    frames and files). Null ids come first, equal ids in order of their text;
    null text is the end id alone; other columns are ignored; no rows write no
    file. ``files`` defaults to the session's number of shuffle partitions.
    ``folder`` is any place that executors reach by URI.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    frames = written(dealt.mapInArrow(partial(_write, path=path, folder=folder, end=end), _MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_file = frames.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_id"))
    return frames.join(by_file, "part").withColumn("first_id", F.col("first_id") + F.col("at")).drop("at")


def _read(batches: Iterator[pa.RecordBatch], wanted: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    source = reader = opened = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["file"] != opened:
                if source is not None:
                    source.close()
                system, inner = place(row["file"])
                source, opened = system.open_input_file(inner), row["file"]
                reader = FrameReader(source, system.get_file_info(inner).size)
            first, rows = row["first_id"], []
            for doc_id, ids in reader.documents(row["frame"]):
                if wanted is None or doc_id in wanted:
                    rows.append((doc_id, first, len(ids) // 4, ids))
                first += len(ids) // 4
            if rows:
                doc_ids, starts, counts, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
    if source is not None:
        source.close()


def read_frames(manifest: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files of a manifest.

    With ``wanted`` doc_ids only the frames whose range holds one of them are read and decompressed.
    """
    chosen = None if wanted is None else frozenset(wanted)
    if chosen is not None:
        ids = F.array(*[F.lit(i).cast("bigint") for i in sorted(chosen)]) if chosen else F.array().cast("array<bigint>")
        manifest = manifest.filter(F.exists(ids, lambda i: i.between(F.col("least"), F.col("most"))))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.select("part", "file", "frame", "first_id").repartition(parts, "part", F.floor(F.col("frame") / 64)).sortWithinPartitions("part", "frame")
    return dealt.mapInArrow(partial(_read, wanted=chosen), "doc_id bigint, start bigint, n_tokens bigint, ids binary")

