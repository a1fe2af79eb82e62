"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.session import spread

#: Fixed value: how the public vocabulary's texts are cut into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file larger than this is refused, as it is broadcast.
MAX_VOCABULARY_BYTES = 32 << 20
NEVER = 1 << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by lowest-rank merges, the leftmost first among equals.

    A segment tree over the ranks of adjacent pairs holds the least rank at its
    root. Walking down, left where both sides are equal, finds the leftmost
    such pair; a merge changes three leaves, each updated up to the root. A
    piece of n bytes takes O(n log n) steps, however long it is.
    """
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], NEVER)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (least := tree[1]) < NEVER:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = after[i]
        part[i] += part[j]
        part[j] = b""
        end = after[i] = after[j]
        before[end] = i
        changed = [(i, ranks.get(part[i] + part[end], NEVER) if end < n else NEVER)]
        if j < n - 1:
            changed.append((j, NEVER))
        if (p := before[i]) >= 0:
            changed.append((p, ranks.get(part[p] + part[i], NEVER)))
        for leaf, rank in changed:
            k = size + leaf
            tree[k] = rank
            while k > 1:
                k //= 2
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
    return [ranks[x] for x in part if x]


class Encoder:
    """Encodes texts; the ids of short pieces are remembered up to ``remember`` pieces."""

    def __init__(self, raw: bytes, pattern: str = PATTERN, remember: int = 200_000) -> None:
        self.ranks, self.cut, self.remember = read_ranks(raw), regex.compile(pattern), remember
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None, out: array | None = None) -> array:
        out = array("i") if out is None else out
        known = self.known
        for piece in self.cut.findall(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode(), self.ranks)
                if len(piece) <= 48:
                    if len(known) >= self.remember:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """(key, ids): the token ids of each whole text, without special tokens.

    The text is not changed first; strings of special tokens in it are ordinary
    text. A null, empty text gives an empty list; a blank one the ids of its
    white space. Rows with a null or repeated key stay. Other columns are not
    read. ``vocabulary`` is a rank file of at most MAX_VOCABULARY_BYTES, read by
    the driver and broadcast. One pass over the texts, without a shuffle unless
    the input has few partitions (see spread).
    """
    raw = Path(vocabulary).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has {len(raw)} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    sent, name = df.sparkSession.sparkContext.broadcast(raw), (hashlib.sha256(raw).hexdigest(), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(sent.value, pattern)
        encoder = _ENCODERS[name]
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids, ends = array("i"), array("i", [0])
                for x in part.column(1):
                    encoder.encode(x.as_py(), ids)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    out = rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("key", key)
