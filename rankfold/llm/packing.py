"""Vector best-fit packing (operator 10).

Documents become token ids, are closed by an end id and cut into pieces of at
most ``capacity`` tokens (only longer documents are cut; the first piece takes
the remainder). Pieces are packed into sequences under three capacities at once:
tokens, number of documents, and attention cost (the sum of squared piece
lengths). Among the open sequences in which a piece fits under every capacity,
the one with the least weighted norm of what would remain is taken
(``rule="norm"``), or the one whose remaining capacities have the largest
weighted dot product with the piece (``rule="dot"``).

Scale: one pass over the texts without a shuffle gives rows of a few numbers
per piece; those are dealt evenly into groups of about ``group`` pieces (by row
position, so repeated rows and hot sources spread), and every group is packed on
its own, longest piece first. A group leaves about one sequence that is not
full, a share of 1/1000 to 1/2000.

Null text counts as empty (a piece of one end id); an empty table gives an empty
table; repeated rows are packed as often as they appear; a text of any length is
encoded whole, by one task.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.bpe import SPLIT, byte_alphabet, codec
from rankfold.llm.common import materialise

CAPACITY = 1024
END_ID = 2
GROUP = 4096
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The file's BPE as a rank table. Merging by rank equals the file's merge
    list when ids of merged entries rise along that list, which is checked."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        made = [vocab["".join(p.split(" ") if isinstance(p, str) else p)] for p in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text. The encoder's pattern engine gives up on a run of about half a
    million blanks; such a text goes through the codec of operator 4 (equal ids)."""
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.frombuffer(codec(path).encode(text), "<u4")


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece int, start long, length long, ids_crc32 long) per piece."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.append(token_ids(t.as_py() or "", path), end_id).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k in range(len(cuts) - 1):
                    row.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(ids[cuts[k]:cuts[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, caps: tuple[float, float, float], weights: tuple[float, float, float],
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; pieces are taken in the given order.
    A piece that exceeds a capacity by itself gets a sequence of its own."""
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    cap, w = np.asarray(caps, float), np.asarray(weights, float)
    res = np.empty((3, max(1, len(lengths))))       # what remains of each open sequence, one row a capacity
    name = np.empty(max(1, len(lengths)), np.int64)
    n_open = n_seq = 0
    left = np.minimum.accumulate(lengths[::-1])[::-1]  # the shortest piece still to come
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, float(length) * length])
        pick = -1
        if n_open:
            r = res[:, :n_open]
            fits = (r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2])
            at = np.flatnonzero(fits)
            if len(at):
                rest = (r[:, at] - need[:, None]) / cap[:, None] if rule == "norm" else r[:, at] / cap[:, None]
                pick = at[np.argmin(w @ (rest * rest))] if rule == "norm" else at[np.argmax((w * need / cap) @ rest)]
        if pick < 0:
            pick = n_open
            res[:, pick], name[pick] = cap, n_seq
            n_open, n_seq = n_open + 1, n_seq + 1
        seq[i], off[i] = name[pick], cap[0] - res[0, pick]
        res[:, pick] -= need
        following = left[i + 1] if i + 1 < len(lengths) else math.inf
        if res[0, pick] < following or res[1, pick] < 1:  # nothing more can go in
            n_open -= 1
            res[:, pick], name[pick] = res[:, n_open], name[n_open]
    return seq, off


def pack(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, max_docs: int = CAPACITY,
         max_attention: float = float(CAPACITY) ** 2, weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
         rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id long and offset long to rows of ``pieces``. The default
    document and attention capacities never bind beyond the token capacity; set
    lower ones to bound either."""
    parts = materialise(parts, "pieces")
    groups = max(1, math.ceil(parts.count() / group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + \
        ", sequence_id long, offset long"
    names = parts.columns

    def run(g: tuple, t: pa.Table) -> pa.Table:
        t = t.select(names).sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending")])
        seq, off = best_fit(t["length"].to_numpy(), (capacity, max_docs, max_attention), weights, rule)
        return t.append_column("sequence_id", pa.array(seq + g[0].as_py() * 8 * group)) \
            .append_column("offset", pa.array(off))

    dealt = parts.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_g").applyInArrow(run, schema)
