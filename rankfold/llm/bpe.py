"""Byte-level BPE encoding and decoding (operator 4).

The vocabulary file (Hugging Face ``tokenizers`` JSON, BPE model over bytes) is
read by every Python worker from ``path``. A piece of text is a doubly linked
list of symbols; a heap holds the mergeable neighbour pairs by (rank, position).
Popping a pair whose symbols have changed since it was pushed (a stale entry) is
skipped, so a piece of n bytes costs O(n log n). Decoding concatenates the byte
strings of the vocabulary entries.

Results per row, in input order, no shuffle:
* null text encodes like the empty text: no ids, empty decoded text;
* special strings of the file (``<|endoftext|>``) inside a text become their id;
* repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: fixed value: the split pattern of byte-level BPE
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """Character of a vocabulary entry -> byte: printable Latin-1 characters
    stand for themselves, the other bytes for U+0100, U+0101, ... in order."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Bounded cache of piece -> packed ids, filled on first use."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.merge(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    def __init__(self, spec: dict):
        model = spec["model"]
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()
                         if t not in self.special}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.first = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rank: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], (r, vocab[a + b]))
        self.split = regex.compile(SPLIT)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self.pieces = Pieces(self)

    def merge(self, raw: bytes) -> list[int]:
        sym = [self.first[b] for b in raw]
        n = len(sym)
        if n < 2:
            return sym
        rank = self.rank
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = rank.get(sym[i] << 32 | sym[i + 1])
            if m:
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            k = after[j]
            sym[i], sym[j] = new, -1
            after[i] = k
            if k < n:
                before[k] = i
                m = rank.get(new << 32 | sym[k])
                if m:
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = before[i]
            if h >= 0:
                m = rank.get(sym[h] << 32 | new)
                if m:
                    heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get, find = self.pieces.__getitem__, self.split.findall
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(get, find(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(get, find(text[at:m.start()]))
            out.append(struct.pack("<I", self.special[m[0]]))
            at = m.end()
        out += map(get, find(text[at:]))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """The UTF-8 bytes of the text; byte sequences that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec (with its cache) per Python worker and file."""
    if path not in _CODECS:
        with open(path, encoding="utf-8") as f:
            _CODECS[path] = Codec(json.load(f))
    return _CODECS[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, n_tokens long): packed little-endian 32-bit ids."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()),
                                              pa.array([len(x) // 4 for x in ids], pa.int64())],
                                             names=[key, "ids", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, schema)


def decode(ids: DataFrame, path: str, key: str = "doc_id", packed: str = "ids") -> DataFrame:
    """(key, text string) of packed ids."""
    schema = f"`{key}` {ids.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(x or b"").decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, packed).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both:
    (key, n_tokens long, ids_sha256 string, decoded_sha256 string). The ids of
    one text at a time are held."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, " \
             "decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()),
                                              pa.array(text_hex, pa.string())],
                                             names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, schema)
