"""Tokens, packing and token files against the library and exact round trips."""

import os
import random
import zlib

import numpy as np
import pytest

from threadgauge.llm import bpe, frames, packing, tokens
from threadgauge.llm.common import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids int"
LETTERS = [*"ab'sdtre  \n\n\t\r\x0b\x1c\x85\xa0éß½٣北😀 .,!?-_012Iİ", "<|endoftext|>", "  ", " \n", "ation", "The", "'s", ".,"]


def texts(n=600):
    rng = random.Random(9)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", "a" * 4000, " " * 500, "ab ba " * 3000]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def as_bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_speculated_encoding_equals_the_library():
    found = bpe.ByteBPE(BYTES)
    want = library(BYTES).encode_batch(texts(), add_special_tokens=False)
    got = found.encode_batch(texts())
    assert got == [as_bytes(w.ids) for w in want]
    assert [found.decode(g) for g in got] == texts()
    assert found.merged_words > 0


def test_pairs_that_fit_are_those_that_merging_leaves_apart():
    found, rng = bpe.ByteBPE(BYTES), np.random.default_rng(1)
    some = np.array(list(found.ids.values()))
    a, b = rng.choice(some, 3000), rng.choice(some, 3000)
    joined = [found.merge(found.bytes_of[x] + found.bytes_of[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert found.fitting(a, b).tolist() == joined


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    found = bpe.ByteBPE(BYTES)
    for _ in range(2):
        for text in texts(60):
            assert found.decode(found.encode_batch([text])[0]) == text
    assert len(found.chunks) <= 21 + len("ab ba " * 3000)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_remembered_library_encoding(path):
    want = library(path).encode_batch(texts(), add_special_tokens=False)
    assert tokens.LibraryCoder(path).encode_batch(texts()) == [as_bytes(w.ids) for w in want]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_blocks_with_a_small_store_equal_the_library(path):
    rng = random.Random(17)
    parts = ["don't", "I'll", "we're", "it's,", "a.b.", "x,y", "No.7", "...", "?!", "word.", "Word,", "ÜBER", "straße:", "İstanbul", "ǅ", "e\u0301", "日本", "12", "3.5", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1f", ""]
    gaps = [" ", " ", " ", " ", "\n", "\n", "  ", "\t", "\u3000", "\x85", "\n\n", " \n"]
    mixed = ["".join(rng.choice(parts) + rng.choice(gaps[: 6 if k % 3 else 12]) for _ in range(rng.randint(0, 30))) for k in range(800)]
    mixed += [" lead", "trail ", "\nlead", "trail\n", ".", " . ", "a.\nb, c. d", "s\u0307. İ. ß.\n"]
    want = library(path).encode_batch(mixed, add_special_tokens=False)
    coder = tokens.LibraryCoder(path, remembered=40)
    for at in range(0, len(mixed), 50):
        ids, counts = coder.encode(mixed[at : at + 50], 7)
        got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [[*w.ids, 7] for w in want[at : at + 50]]


def test_encode_and_decode_tables(spark):
    rows = [(1, "Hello there", 1), (2, None, 1), (2, "", 1), (None, "x", 1)]
    coded = bpe.encode(spark.createDataFrame(rows, SCHEMA), BYTES)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(coded, BYTES).collect()}
    assert back == {(1, "Hello there"), (2, ""), (None, "x")}
    assert bpe.encode(spark.createDataFrame([], SCHEMA), BYTES, decode=True).count() == 0


def least_bins(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plans_use_all_pieces_and_few_sequences():
    rng, worse = random.Random(2), 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 33])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 10))), reverse=True)
        plan = packing.plan({s: items.count(s) for s in items}, capacity)
        used = sorted((s for lengths, n in plan for s in lengths * n), reverse=True)
        assert used == items and all(sum(lengths) <= capacity for lengths, _ in plan)
        worse += sum(n for _, n in plan) > least_bins(items, capacity)
    assert worse <= 3


def test_plan_cost_does_not_grow_with_counts():
    few = packing.plan({s: 1000 + s for s in range(1, 1025)})
    many = packing.plan({s: 10**9 + s for s in range(1, 1025)})
    assert len(packing.slots(many)) < 4 * len(packing.slots(few)) + 10_000


def test_packed_pieces_are_gapless(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randint(0, 90))), 1) for i in range(200)]
    rows += [(500, None, 1), (501, "", 1), (None, "null id", 1), (7, "same id", 1), rows[0], (600, "word " * 5000, 1)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, SCHEMA), BYTES, capacity=64).collect()
    coder = library(BYTES)
    ids = [as_bytes([*coder.encode(t or "", add_special_tokens=False).ids, 2]) for _, t, _ in rows]
    want = sorted(
        (d or -1, j, start, n, zlib.crc32(i[4 * start : 4 * (start + n)]))
        for (d, _, _), i in zip(rows, ids, strict=True) for j, (start, n) in enumerate(packing.pieces_of(len(i) // 4, 64))
    )
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.best_fit_pack(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 40), 1) for i in range(300)] + [(400, None, 1), (None, "none", 1), (5, "again", 1)]
    manifest = frames.write_frames(spark.createDataFrame(rows, SCHEMA), WORDS, f"file://{tmp_path}/files", files=3)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in frames.read_frames(manifest).collect()))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    coder, at, want = library(WORDS), 0, []
    for d, t, _ in order:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((at, d, len(ids), as_bytes(ids)))
        at += len(ids)
    assert got == want
    assert sorted(r["doc_id"] for r in frames.read_frames(manifest, [5, 299, 12345]).collect()) == [5, 5, 299]
    assert frames.write_frames(spark.createDataFrame([], SCHEMA), WORDS, new_path(spark, "t")).count() == 0


def test_frames_are_zstandard_and_checked(tmp_path):
    import zstandard

    place = tmp_path / "a.zst"
    with place.open("wb") as sink:
        writer = frames.FrameWriter(sink, frame_bytes=64)
        for i in range(50):
            writer.add(i, as_bytes(range(i)))
        writer.close()
    data = place.read_bytes()
    with place.open("rb") as source:
        reader = frames.FrameReader(source, len(data))
        assert [d for k in range(len(reader.entries)) for d in reader.documents(k)] == [(i, as_bytes(range(i))) for i in range(50)]
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(whole) == sum(e[1] for e in reader.entries)
    with place.open("r+b") as f:
        f.seek(-9 - 4, 2)
        f.write(b"\0\0\0\0")
    with place.open("rb") as source, pytest.raises(ValueError, match="checksum"):
        reader = frames.FrameReader(source, len(data))
        reader.documents(len(reader.entries) - 1)


def test_pieces_are_cut_from_bounded_blocks_of_text():
    import pyarrow as pa

    texts = [f"word{k} and more text of it. " * 9000 for k in range(9)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(11)), "text": texts})
    parts = list(packing._cut(iter([batch]), BYTES, 2, 1024))
    alone = [row for k in range(11) for part in packing._cut(iter([batch.slice(k, 1)]), BYTES, 2, 1024) for row in part.to_pylist()]
    assert len(parts) > 1 and [row for part in parts for row in part.to_pylist()] == alone


def test_words_of_letters_and_signs_reach_the_model_in_blocks(monkeypatch):
    asked, plain = [], tokens.LibraryCoder._pieces
    monkeypatch.setattr(tokens.LibraryCoder, "_pieces", lambda self, chunk: asked.append(chunk) or plain(self, chunk))
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCßÄéñçªºµ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", "$$$", "%", "_", "?!", "\"", "(*"]) for _ in range(3000)]
    others = ["a'b", "'s", "x's!", "a!b", "7th", "a1", "×÷", "¡si!", "\x00", "À\x00", "日本", "don't%", "@@"]
    found = [" ".join(rng.choice(words) if rng.random() < 0.9 else rng.choice(others) for _ in range(40)) for _ in range(300)]
    coder = tokens.LibraryCoder(BYTES, remembered=500)
    got = coder.encode_batch(found[:200]) + coder.encode_batch(found[200:])
    assert got == [as_bytes(w.ids) for w in library(BYTES).encode_batch(found, add_special_tokens=False)]
    assert not {w.strip() for w in asked} & set(words)
