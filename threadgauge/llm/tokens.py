"""Token ids by the tokenizers library, which is asked only for chunks it was not asked before.

A block of texts is cut into chunks by Arrow, chunks are numbered by dictionary
encoding, and only distinct ones are looked up. Ids of known chunks lie in one
flat array; a text's ids are gathered from there by position. New words go to
the library's own model many at a time, with a letter between them that it
never merges, if its file has such a letter.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadgauge.llm.bpe import _LAST_SPACE, _RARE_SPACE, _WIDE_SPACE, byte_letters
from threadgauge.llm.common import sole

REMEMBERED = 200_000
# Where white space is doubled or of a rare kind, the place of a cut depends on more than one character.
_UNEVEN = "  |\n\n| \n|\n |[\x1f" + "".join(_RARE_SPACE) + "]|" + _WIDE_SPACE.pattern
# Lower case and composition act on single characters up to this one.
_WIDE = "[^\x00-\xff]"
_STOP = r"([\pL\pN])([.,;:!?])([ \n])"
# Bytes that no text in UTF-8 has, and the number of words that the model is given at once.
_NO_TEXT = (0xC0, 0xC1, *range(0xF5, 0x100))
JOINED = 256
# Chunks of letters up to U+00FF and signs after them are one word or two; an apostrophe may start a word of its own.
_LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"
_SIGNS = r"[!-&(-/:-@\[-`{-~]+"
_PLAIN = f"^ ?{_LETTERS}({_SIGNS})?$"
_SIGNED = f"({_LETTERS})({_SIGNS})"


class IdStore:
    """Ids of chunks one after the other, and the number of each known chunk.

    When it holds ``most`` chunks, those that the fewest blocks used are forgotten, and older use counts less.
    """

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, dtype="<u4"), 0
        self.starts, self.counts, self.blocks = (np.empty(1 << 14, dtype=np.int64) for _ in range(3))
        self.n = 0

    def thin(self) -> None:
        if self.n <= self.most:
            return
        known, blocks = self.known, self.blocks[: self.n]
        least = 1 + int(np.partition(blocks, -(self.most // 2))[-(self.most // 2)])
        kept = [(c, i) for c, i in known.items() if blocks[i] >= least]
        numbers = np.array([i for _, i in kept], dtype=np.int64)
        ids, counts, blocks = self.gather(numbers), self.counts[numbers], blocks[numbers] // 2
        self._clear()
        self.add(ids, counts)
        self.blocks[: self.n] = blocks
        self.known = {c: k for k, (c, _) in enumerate(kept)}

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of newly stored ids, ``counts`` of them each."""
        self.flat = self._room(self.flat, self.used + len(ids))
        self.starts, self.counts, self.blocks = (self._room(x, self.n + len(counts)) for x in (self.starts, self.counts, self.blocks))
        at = slice(self.n, self.n + len(counts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.counts[at], self.starts[at], self.blocks[at] = counts, self.used + np.cumsum(counts) - counts, 0
        self.used, self.n = self.used + len(ids), at.stop
        return np.arange(at.start, at.stop)

    @staticmethod
    def _room(values: np.ndarray, size: int) -> np.ndarray:
        if size <= len(values):
            return values
        grown = np.empty(max(size, 2 * len(values)), dtype=values.dtype)
        grown[: len(values)] = values
        return grown

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks ``numbers``, one after the other."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[numbers] - ends + counts, counts)
        return self.flat[at]


class LibraryCoder:
    """Encodes as the library does with add_special_tokens=False, truncation and padding off.

    Files with the byte-level pattern are asked for each chunk with the space
    before it, files that split words off and drop white space for each chunk
    alone; both give what the library gives for the whole text. A text that
    holds a special token, or a file of another kind, is encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kind = self.tokenizer.pre_tokenizer
        self.spaced = isinstance(kind, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None and kind.use_regex and not kind.add_prefix_space
        self.split = isinstance(kind, pre_tokenizers.Sequence) and self.tokenizer.encode("a b c", add_special_tokens=False).ids == [
            i for w in "abc" for i in self.tokenizer.encode(w, add_special_tokens=False).ids
        ]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        normal = self.tokenizer.normalizer
        self.lower = self.split and normal is not None and normal.normalize_str("AÉ\nß") == "aé ß"
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = [letters[b] for b in range(256)]
        self.model = self.wall = None
        model = self.tokenizer.model
        ways = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if self.spaced and isinstance(model, models.BPE) and not any(getattr(model, w) for w in ways):
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            merged = {c for t in vocabulary if len(t) > 1 for c in t}
            walls = [c for b in _NO_TEXT if (c := self.letters[b]) in vocabulary and c not in merged]
            if walls:
                self.model, self.wall = Tokenizer(model), (walls[0], vocabulary[walls[0]])
                self.written = dict(enumerate(self.letters)) | {10: walls[0]}
        self.store = IdStore(remembered)

    def _library(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of texts, each encoded whole."""
        return [e.ids for at in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(list(texts[at : at + 64]), add_special_tokens=False)]

    def _pieces(self, chunk: str) -> list[str]:
        """The words a chunk falls into, written as the model is asked for them."""
        letters = chunk[1:] if self.spaced and chunk[:1] == " " else chunk
        if letters.isalpha() and max(letters) <= "ÿ" and (self.spaced or self.lower and letters.islower()):
            if letters.isascii():
                return [chunk.replace(" ", self.letters[32])]
            return ["".join([self.letters[b] for b in chunk.encode()])]
        normal = self.tokenizer.normalizer
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(chunk) if normal is not None else chunk)]

    def _walled(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words that end with the wall, a letter in no merge and no text.

        No merge reaches over a wall, and in each word merges come in the same order as in the word alone.
        """
        coded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), dtype="<u4")
        ends = ids == self.wall[1]
        return ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per chunk) of chunks of letters, or of letters and signs."""
        lines = pc.replace_substring_regex(chunks, _SIGNED, "\\1\n\\2")
        words = 1 + (pc.binary_length(lines).to_numpy() - pc.binary_length(chunks).to_numpy())
        names, texts = lines.to_numpy(zero_copy_only=False), []
        for at in range(0, len(names), JOINED):
            texts.append(("\n".join(names[at : at + JOINED]) + "\n").encode().decode("latin-1").translate(self.written))
        ids, counts = self._walled(texts)
        return ids, np.add.reduceat(counts, np.cumsum(words) - words)

    def _words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) by the library's own model."""
        if self.model is not None:
            return self._walled([self.wall[0].join([*words[at : at + JOINED], ""]) for at in range(0, len(words), JOINED)])
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in words]
        return np.array(list(chain.from_iterable(found)), dtype="<u4"), np.array(list(map(len, found)), dtype=np.int64)

    def _chunks(self, chunks: pa.Array) -> np.ndarray:
        """Store numbers of new chunks without special tokens, whose words go to the library's own model."""
        numbers = np.empty(len(chunks), dtype=np.int64)
        plain = np.zeros(len(chunks), dtype=bool)
        if self.model is not None:
            plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        if plain.any():
            numbers[plain] = self.store.add(*self._plain(chunks.filter(pa.array(plain))))
        words, ends = [], [0]
        for chunk in chunks.filter(pa.array(~plain)).to_numpy(zero_copy_only=False):
            words += self._pieces(chunk)
            ends.append(len(words))
        ids, counts = self._words(words)
        read = np.r_[0, np.cumsum(counts)]
        numbers[~plain] = self.store.add(ids, np.diff(read[ends]))
        return numbers

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """Store numbers of chunks, which are strings to be encoded on their own."""
        if not len(chunks):
            return np.empty(0, dtype=np.int64)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        known = self.store.known
        numbers = np.fromiter(map(known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = given = self._chunks(coded.dictionary.take(pa.array(new)))
            known.update(zip(distinct[new], given.tolist(), strict=True))
        self.store.blocks[numbers] += 1
        return numbers[coded.indices.to_numpy()]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, chunks per text) of even texts: a place between a letter and a stop is always one between words."""
        if self.spaced:
            marked = pc.replace_substring_regex(texts, _STOP, "\\1\x1f\\2\\3")
            marked = pc.replace_substring(pc.replace_substring(marked, "\n", "\x1f\n\x1f"), " ", "\x1f ")
            parts = pc.split_pattern(marked, "\x1f")
        else:
            marked = pc.replace_substring_regex(pc.utf8_lower(texts) if self.lower else texts, _STOP, "\\1 \\2\\3")
            parts = pc.split_pattern(pc.replace_substring(marked, "\n", " "), " ")
        return self._numbers(parts.flatten()), np.diff(parts.offsets.to_numpy())

    def encode(self, texts: Sequence[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of a block of texts, little-endian unsigned 32-bit; ``end`` follows each text."""
        self.store.thin()
        array = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts
        whole = np.zeros(len(array), dtype=bool)
        for s in self.special:
            whole |= pc.match_substring(array, s).to_numpy(zero_copy_only=False)
        if not (self.spaced or self.split):
            whole[:] = True
        uneven = pc.match_substring_regex(array, _UNEVEN if self.spaced else _WIDE).to_numpy(zero_copy_only=False)
        rows, numbers, counts = [], [], []
        even = np.flatnonzero(~whole & ~uneven)
        if len(even):
            some = array if len(even) == len(array) else array.take(pa.array(even))
            found, n = self._cut(some)
            rows, numbers, counts = [even], [found], [n]
        for k in np.flatnonzero(uneven & ~whole).tolist():
            text = array[k].as_py()
            first, *rest = _LAST_SPACE.split(text) if self.spaced else text.split(" ")
            found = self._numbers(pa.array([first, *(" " + p if self.spaced else p for p in rest)], pa.large_string()))
            rows, numbers, counts = [*rows, [k]], [*numbers, found], [*counts, [len(found)]]
        odd = np.flatnonzero(whole)
        if len(odd):
            rows.append(odd)
            found = self._library([array[k].as_py() for k in odd.tolist()])
            numbers.append(self.store.add(np.array(list(chain.from_iterable(found)), dtype="<u4"), np.array(list(map(len, found)), dtype=np.int64)))
            counts.append(np.ones(len(odd), dtype=np.int64))
        if not rows:
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        row, chunk, per_text = (np.concatenate(x).astype(np.int64) for x in (rows, numbers, counts))
        if len(rows) > 1:
            order = np.argsort(row, kind="stable")
            owner = np.repeat(row, per_text)
            chunk, per_text = chunk[np.argsort(owner, kind="stable")], per_text[order]
        ends = np.cumsum(per_text)
        if end is not None:
            chunk = np.insert(chunk, ends, self.store.add(np.array([end], dtype="<u4"), np.array([1]))[0])
            per_text = per_text + 1
            ends = np.cumsum(per_text)
        before = np.r_[0, np.cumsum(self.store.counts[chunk])]
        return self.store.gather(chunk), np.diff(before[np.r_[0, ends]])

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode(texts)
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def library_coder(path: str, remembered: int = REMEMBERED) -> LibraryCoder:
    """One coder per worker at a time."""
    return sole(("library", path, remembered), lambda: LibraryCoder(path, remembered))
