"""Whole-text tokenising with a bounded cache of pieces.

A byte-level BPE splits a text before every single space that stands between two non-space
characters, whatever surrounds it. So a text without double spaces is the concatenation of its
space-separated pieces' encodings; equal pieces are encoded once by the tokenizers library. A text
with a run of spaces goes through the library whole. Results equal ``encode`` of the whole text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces kept by a task (about 130 MB), and characters of them; beyond either the cache starts anew.
CACHE_PIECES, CACHE_CHARS = 1_000_000, 8 << 20
#: Pieces joined into one text for the library.
JOINED = 4_000


#: The split pattern of byte-level BPE vocabularies of this kind.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


def _byte_names() -> dict[int, str]:
    """How such vocabularies write bytes: printable Latin-1 as it is, the others in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_MAPPED = _byte_names()


#: A word of letters on which all versions of Unicode agree.
_WORD = regex.compile(r"[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


class PieceEncoder:
    def __init__(self, path: str, cache: int = CACHE_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.limit = cache
        self.mapped = Tokenizer(self.model.model)
        self.mapped.pre_tokenizer = CharDelimiterSplit("\n")
        names = self.model.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith(_MAPPED[ord(" ")])]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the cache; also at the end of a task, since workers are used again."""
        self.at: dict[str, int] = {}
        self.chars = 0
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return n, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of words of letters, each with a space before it: joined, with the bytes already mapped."""
        joined = ["\n".join([(" " + w).encode().decode("latin-1").translate(_MAPPED) for w in words[i : i + JOINED]]) for i in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.mapped.encode_batch_fast(joined, add_special_tokens=False)])
        return np.diff(np.flatnonzero(self.begins[ids]), append=len(ids)), ids

    def _add(self, pieces: list[str], n: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.at)
        self.at.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, ids])

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of cache rows, one after another, and where each row's end."""
        a = self.start[rows]
        size = self.start[rows + 1] - a
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1]) + np.repeat(a - (ends - size), size)], ends

    def _learn(self, pieces: list[str]) -> None:
        """Cache pieces. One that isn't a word of letters is put together from the parts that the library's own pattern splits it into.

        A part with a space before a word is that word's piece; any other is cached under itself with a space more before it, which no piece has.
        """
        told = [p.isalpha() if p.isascii() else _WORD(p) is not None for p in pieces]
        words = [p for p, word in zip(pieces, told, strict=True) if word]
        mixed = [p for p, word in zip(pieces, told, strict=True) if not word]
        cut = [_PARTS(" " + p) for p in mixed]
        keys = [x[1:] if x[0] == " " and (x[1:].isalpha() if x.isascii() else _WORD(x, 1)) else " " + x for parts in cut for x in parts]
        new = set(keys).difference(self.at)
        bits = [k for k in new if k[0] == " "]
        words += new.difference(words, bits)
        if words:
            self._add(words, *self._encode_words(words))
        if bits:
            self._add(bits, *self._encode([k[1:] for k in bits]))
        if mixed:
            get = self.at.__getitem__
            ids, ends = self._gather(np.array([get(k) for k in keys], np.int64))
            total = ends[np.cumsum([len(parts) for parts in cut]) - 1]
            self._add(mixed, np.diff(total, prepend=0), ids)

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """Cache rows of pieces, each taken with a space before it."""
        get = self.at.get
        rows = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(rows < 0)
        if self.at and (len(self.at) + len(new) > self.limit or self.chars > CACHE_CHARS):
            self.forget()
            new = np.arange(len(pieces))
        if len(new):
            self._learn([pieces[i] for i in new])
            get = self.at.__getitem__
            rows[new] = [get(pieces[i]) for i in new]
        return rows

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each followed by ``end``, and offsets of the texts (null: empty text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd = np.asarray(pc.match_substring(texts, "  "))
        plain = texts if not odd.any() else pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        lists = pc.split_pattern(plain, " ")
        off = np.asarray(lists.offsets).astype(np.int64)
        off = off - off[0]
        coded = lists.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        # the first piece of a text has no space before it; a text with runs of spaces is one piece
        whole = texts.to_pylist() if odd.any() else None
        first = coded.dictionary.take(coded.indices.take(pa.array(off[:-1]))).to_pylist()
        own_n, own = self._encode([whole[i] if odd[i] else first[i] for i in range(n)])
        a = self.start[rows]
        size = self.start[rows + 1] - a
        size[off[:-1]] = own_n
        a[off[:-1]] = len(self.ids) + np.cumsum(own_n) - own_n
        # one more piece at each end: the end id
        at = off[1:]
        a, size = np.insert(a, at, len(self.ids) + len(own)), np.insert(size, at, 1)
        ids = np.concatenate([self.ids, own, np.array([end], np.uint32)])
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        kind = np.int32 if max(total[-1], len(ids)) < 2**31 else np.int64
        flat = np.arange(total[-1], dtype=kind)
        flat += np.repeat((a - total[:-1]).astype(kind), size)
        return ids[flat], total[np.append(off[:-1] + np.arange(n), len(size))]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
