"""Byte-level BPE: greedy proposals, vectorised verification, exact merging only where needed.

A token sequence is the BPE encoding of a word exactly if each adjacent pair of
tokens is the encoding of its own bytes. A word is therefore cut greedily into
the longest tokens of the vocabulary, all adjacent pairs of all new words of a
batch are tested together, and only words with a failing pair are merged rule by
rule. Encodings of chunks (what stands between two spaces) are remembered per
worker in two generations, so memory is bounded and no text is cut.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadgauge.llm.common import sole


REMEMBERED = 300_000
NEVER = 1 << 40
# The pre-tokenisation pattern and the white space it knows.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_WORDS = regex.compile(WORD)
_LAST_SPACE = re.compile(f" (?=[^{SPACE}])")
_RARE_SPACE = ("\t", "\r", "\x0b", "\x0c")
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """A bounded mapping: when full, the younger half becomes the older half, which is the fallback."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class _Unknown:
    __slots__ = ("ids", "key")

    def __init__(self, key):
        self.key, self.ids = key, b""


class Chunks(Memory):
    """Chunk to ids; unknown ones are noted and get their ids at the end of the batch."""

    def __init__(self, most: int):
        super().__init__(most)
        self.new: list[_Unknown] = []

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = _Unknown(key)
            self.new.append(found)
        self[key] = found
        return found


def chunk_ids(text: str, chunks: Chunks) -> list:
    """What ``chunks`` has for each chunk of a text, in order; the first has no space before it.

    A text may be cut before a space that a non-space follows: the pattern never
    matches across that place. Where white space is never doubled, each space is
    such a place.
    """
    plain = "  " not in text and "\n " not in text and " \n" not in text and "\n\n" not in text
    plain = plain and not any(s in text for s in _RARE_SPACE) and (text.isascii() or not _WIDE_SPACE.search(text))
    parts = text.split(" ") if plain else _LAST_SPACE.split(text)
    known = chunks.__getitem__
    return [known((0, parts[0])), *map(known, parts[1:])]


class ByteBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library without a normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        names = spec["model"]["vocab"]
        size = max([*names.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for name, i in names.items():
            self.bytes_of[i] = bytes(letters[c] for c in name)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        left = np.array([names[a] for a, _ in merges], dtype=np.int64)
        right = np.array([names[b] for _, b in merges], dtype=np.int64)
        made = np.array([names[a + b] for a, b in merges], dtype=np.int64)
        # Of a token: its two parts and the rank of the rule that makes it (-1: a byte).
        self.left, self.right = np.arange(size), np.arange(size)
        self.born = np.full(size, -1, dtype=np.int64)
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        self.born[made[::-1]] = np.arange(len(merges))[::-1]
        pairs = left << 32 | right
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]
        self.rules = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(left, right, made, strict=True))}
        parts_fit = self.fitting(self.left, self.right, whole=True)
        sound = self.born < 0
        for _ in range(size.bit_length() * 4):
            now = (self.born < 0) | parts_fit & sound[self.left] & sound[self.right]
            if (now == sound).all():
                break
            sound = now
        known = set(names.values())
        self.ids = {self.bytes_of[i]: i for i in np.flatnonzero(sound).tolist() if i in known}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.words: Memory = Memory(REMEMBERED)
        self.chunks = Chunks(REMEMBERED)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merged_words = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], NEVER)

    def fitting(self, a: np.ndarray, b: np.ndarray, whole: bool = False) -> np.ndarray:
        """Whether tokens a and b stay apart when their joined bytes are merged.

        Walks back through the rules that made both: at each moment the piece at
        the end of a (till ``gone_a``) lies beside the piece at the start of b; a
        rule for the two that comes before either is used up would join them.
        ``whole`` asks the same of the parts of one token, up to its own rule.
        """
        a, b = a.copy(), b.copy()
        gone_a, gone_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        fits, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        first = whole
        while len(open_):
            x, y = a[open_], b[open_]
            if not first:
                rule = self.rank(x, y)
                clash = (rule < gone_a[open_]) & (rule <= gone_b[open_])
                fits[open_[clash]] = False
            else:
                clash = np.zeros(len(open_), dtype=bool)
            first = False
            on = ~clash & ((self.born[x] >= 0) | (self.born[y] >= 0))
            open_, x, y = open_[on], x[on], y[on]
            back_a = self.born[x] > self.born[y]
            i, j = open_[back_a], open_[~back_a]
            gone_a[i], a[i] = self.born[a[i]], self.right[a[i]]
            gone_b[j], b[j] = self.born[b[j]], self.left[b[j]]
        return fits

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                found = ids.get(word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the rule of lowest rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        rules = self.rules
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if r := rules.get((made, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, r[1], made, ids[after[j]]))
            if (k := before[i]) >= 0 and (r := rules.get((ids[k], made))):
                heapq.heappush(heap, (r[0], k, r[1], ids[k], made))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each word of a pre-tokenised text."""
        whole = [self.ids.get(w) for w in words]
        open_ = [k for k, i in enumerate(whole) if i is None]
        proposed = [self.greedy(words[k]) if words[k] else [] for k in open_]
        lengths = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.array([i for p in proposed for i in p], dtype=np.int64)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(open_)), lengths)
            beside = owner[1:] == owner[:-1]
            a, b = flat[:-1][beside], flat[1:][beside]
            seen, back = np.unique(a << 32 | b, return_inverse=True)
            fits = self.fitting(seen >> 32, seen & 0xFFFFFFFF)[back]
            for k in np.unique(owner[:-1][beside][~fits]).tolist():
                proposed[k] = self.merge(words[open_[k]])
                self.merged_words += 1
        done = dict(zip(open_, proposed, strict=True))
        return [np.array([i] if i is not None else done[k], dtype="<u4").tobytes() for k, i in enumerate(whole)]

    def _fill(self) -> None:
        """Ids of the chunks that were new in this batch."""
        chunks, self.chunks.new = self.chunks.new, []
        cut = [_WORDS.findall(c.key[1] if type(c.key) is tuple else " " + c.key) for c in chunks]
        memory, older = self.words, self.words.older
        new = []
        for word in {w for words in cut for w in words}:
            if word not in memory:
                found = older.get(word)
                if found is None:
                    new.append(word)
                else:
                    memory[word] = found
        memory.update(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        for chunk, words in zip(chunks, cut, strict=True):
            chunk.ids = b"".join([memory[w] for w in words])
            self.chunks[chunk.key] = chunk.ids
        memory.turn()

    def _pieces(self, text: str) -> list:
        """The remembered or noted encodings of a text's chunks, in order."""
        return chunk_ids(text, self.chunks)

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens in a text get their own id."""
        parts = []
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                pieces: list = []
                for k, part in enumerate(self.cut.split(text)):
                    if k % 2:
                        pieces.append(np.array([self.special[part]], dtype="<u4").tobytes())
                    else:
                        pieces.extend(self._pieces(part))
            else:
                pieces = self._pieces(text)
            parts.append(pieces)
        if self.chunks.new:
            self._fill()
            parts = [[p if type(p) is bytes else p.ids for p in pieces] for pieces in parts]
        self.chunks.turn()
        return [b"".join(pieces) for pieces in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def coder(path: str) -> ByteBPE:
    """One coder per worker at a time."""
    return sole(("bpe", path), lambda: ByteBPE(path))


def _blocks(batch: pa.RecordBatch, column: str, chars: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in blocks of bounded total length; a longer text is a block of its own."""
    at, held, size = 0, [], 0
    for k, text in enumerate(batch.column(column)):
        text = text.as_py() or ""
        if held and size + len(text) > chars:
            yield at, held
            at, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def _encode(batches: Iterator[pa.RecordBatch], path: str, decode: bool) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    for batch in batches:
        for at, texts in _blocks(batch, "text"):
            ids = bpe.encode_batch(texts)
            columns = [batch.column("doc_id").slice(at, len(texts)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            text = pa.array([bpe.decode(i.as_py() or b"") for i in part.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), text], ["doc_id", "text"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, with ``decoded`` when asked to decode the ids at once.

    Null text is empty and has no ids. Ids are bytes, unsigned 32-bit little-endian. Repeated rows are coded
    alike; other columns are ignored; no rows give no rows. ``path`` is the vocabulary file on every machine.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids binary" + (", decoded string" if decode else "")
    return rows.mapInArrow(partial(_encode, path=path, decode=decode), schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with encoded ids; null ids are an empty text."""
    picked = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(partial(_decode, path=path), "doc_id bigint, text string")
