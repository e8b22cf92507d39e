"""Byte-level BPE: distinct words share the work on their common prefixes."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of the public byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text of ASCII alone.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: The characters with Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words that one Python worker remembers; beyond it starts afresh, which bounds memory and changes no result.
REMEMBERED = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieEncoder:
    """Encodes and decodes with the byte-level BPE vocabulary of a ``tokenizers`` file.

    The last token of a prefix's encoding is the longest vocabulary entry that ends the prefix and
    is stable beside the last token of what comes before it; so one token per trie node is enough
    to read every encoding backwards.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = data["model"]["vocab"]
        self.ids = {as_bytes(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.text_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(self.text_of) + 1
        self.made, self.left, self.right, self.rank = [-1] * size, [0] * size, [0] * size, {}
        for r, m in enumerate(data["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = r, *pair
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        #: A vocabulary entry that its own merges don't produce never stands in an encoding.
        self.ids = {b: i for b, i in sorted(self.ids.items(), key=lambda x: self.made[x[1]]) if len(b) == 1 or self._boundary_holds(self.left[i], self.right[i], self.made[i])}
        self.four = [i.to_bytes(4, "little") for i in range(size)]
        self.size_of = [len(self.text_of.get(i, b"")) for i in range(size)]
        self.entries = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.entries.add_word(b.decode("latin-1"), i)  # a letter for each byte
        self.entries.make_automaton()
        self.pattern = regex.compile(WORDS)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.ascii_pattern = re.compile(ASCII_WORDS)
        self.runs = re.compile(f"([{SPACE}]{{2,}})")
        self.known: dict[str, bytes] = {}

    def _boundary_holds(self, a: int, b: int, bound: float = float("inf")) -> bool:
        """No merge over the boundary of two adjacent tokens comes before the merges that made them."""
        rank, made = self.rank, self.made
        while True:
            if rank.get((a, b), bound) < bound:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                bound, a = made[a], self.right[a]
            else:
                bound, b = made[b] + 1, self.left[b]  # the left one of two equal merges comes first

    def encode_distinct(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each word. Sorted, the words are a depth-first walk over their trie: the path on the
        stack holds the last token of every prefix, and a word only adds nodes below what it shares
        with the word before."""
        out, path, before = {}, [-1], ""
        sure, holds, size = self.stable_pairs, self._boundary_holds, self.size_of
        if len(sure) > 1_000_000:
            sure.clear()
        matches = self.entries.iter
        for raw, word in sorted((w.encode().decode("latin-1"), w) for w in words):
            done = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                done += 1
            del path[done + 1 :]
            for last, token in matches(raw):  # every vocabulary entry in the word, the longest that ends at a place first
                if last < done:
                    continue
                start = last + 1 - size[token]
                if start:
                    pair = (path[start], token)
                    good = sure.get(pair)
                    if good is None:
                        good = sure[pair] = holds(*pair)
                    if not good:
                        continue
                path.append(token)
                done += 1
            found, end = [], len(raw)
            while end:
                found.append(path[end])
                end -= size[path[end]]
            found.reverse()
            out[word], before = found, raw
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none.

        A single space between two other characters always starts a word, so texts are cut there
        into chunks, and only chunks not met before are split by the vocabulary's pattern.
        """
        gc.disable()  # words by the million and no cycles: collecting would walk them all again and again
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self._chunks(t) if t else [] for t in texts]
        new = {c: self._words(c) for c in set().union(*cut)}
        pack = lambda ids: b"".join([four[i] for i in ids])
        four = self.four
        words = {w for ws in new.values() for w in ws} - self.known.keys()
        for w, found in self.encode_distinct(words).items():
            self.known[w] = pack(found)
        known, chunks = self.known, {}
        for c, ws in new.items():
            chunks[c] = b"".join([known[w] for w in ws])
        chunks.update((s, i.to_bytes(4, "little")) for s, i in self.special.items())
        return [b"".join(map(chunks.__getitem__, cs)) for cs in cut]

    def _words(self, chunk: str) -> list[str]:
        return (self.ascii_pattern if chunk.isascii() else self.pattern).findall(chunk)

    def _chunks(self, text: str) -> list[str]:
        if self.splitter and any(s in text for s in self.special):
            return [c for i, part in enumerate(self.splitter.split(text)) for c in ([part] if i % 2 else self._chunks(part))]
        if not self.runs.search(text):
            first, *rest = text.split(" ")
            return [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]
        out, lead, pieces = [], "", self.runs.split(text)
        for i, piece in enumerate(pieces):
            if i % 2 == 0:
                if lead or piece:
                    out += self._chunks(lead + piece) if not lead or piece else [lead]
                lead = ""
            elif i == len(pieces) - 2 and not pieces[-1]:
                out.append(piece)  # white space at the end is one word
            else:  # the last character of a run goes with what follows if it is a space
                out.append(piece[:-1])
                lead = piece[-1] if piece[-1] == " " else ""
                if not lead:
                    out.append(piece[-1])
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of a vocabulary file, built once in a Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def small_batches(column: pa.Array, most: int = 8_000_000) -> Iterator[slice]:
    """Slices of the batch with about ``most`` bytes of text, so that a task's memory stays bounded."""
    sizes = np.cumsum([len(x) if x is not None else 0 for x in column])
    at, base = 0, 0
    for i, end in enumerate(sizes):
        if end - base >= most:
            yield slice(at, i + 1)
            at, base = i + 1, end
    if at < len(sizes):
        yield slice(at, len(sizes))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of each text; a null text has no ids."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _rows(batches, path, lambda t, ids, e: {"n_tokens": len(ids) // 4, "ids": np.frombuffer(ids, "<i4")}),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded again.

    A row for each row of ``docs``, also repeated ones and those without a doc_id; a null text is empty.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _rows(batches, path, lambda t, ids, e: {"n_tokens": len(ids) // 4, "ids_sha256": sha(ids), "decoded_sha256": sha(e.decode(ids).encode())}),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _rows(batches, path, row) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for b in batches:
        texts = b.column(1).to_pylist()
        for s in small_batches(texts):
            rows = [row(t, ids, e) for t, ids in zip(texts[s], e.encode_batch(texts[s]))]
            cols = {k: pa.array([r[k] for r in rows]) for k in rows[0]}
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), *cols.values()], ["doc_id", *cols])
