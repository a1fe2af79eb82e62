"""Passages of test items inside training texts."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.session import materialize, spread

_DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")
#: Items of more characters than this in all are broadcast in blocks: 16 bytes a window and their vocabulary.
BLOCK_CHARS = 64 << 20


def folded(text: str) -> str:
    """NFKD without combining marks and format characters, lower-cased."""
    return (text if text.isascii() else _DROPPED.sub("", unicodedata.normalize("NFKD", text))).lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the folded text."""
    return _WORD.findall(folded(text or ""))


def word_spans(text: str) -> list[tuple[int, int]]:
    """For each of ``words(text)``, where it begins and ends in the text itself."""
    kept, at = [], []
    for i, ch in enumerate(text):
        for x in _DROPPED.sub("", unicodedata.normalize("NFKD", ch)):
            kept.append(x)
            at.append(i)
    found = [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer("".join(kept).lower())]
    return [(a, next((j for j in range(b, len(text)) if not _DROPPED.fullmatch(text[j])), len(text))) for a, b in found]


class ItemGrams:
    """The windows of n words of test items: a sorted array of hashes, and the items' word numbers to verify hits."""

    def __init__(self, items: list[tuple[int, str | None]], n: int) -> None:
        self.n = n
        self.number: dict[str, int] = {}
        self.factors = np.random.default_rng(7).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        texts = [np.array([*(self.number.setdefault(w, len(self.number) + 1) for w in words(text)), 0], np.uint32) for _, text in items]
        stream = np.concatenate([np.zeros(0, np.uint32), *texts])
        self.item_ids = [item for item, _ in items]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        spots = self.windows(stream)
        hashes = self.hashed(stream, spots)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.spots, self.stream = hashes[order], spots[order].astype(np.uint32), stream.tobytes()

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Where n numbers in a row are known words."""
        if len(ids) < self.n:
            return np.zeros(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        return np.flatnonzero(unknown[self.n :] == unknown[: -self.n])

    def hashed(self, ids: np.ndarray, spots: np.ndarray) -> np.ndarray:
        out = np.zeros(len(spots), np.uint64)
        for j in range(self.n):
            out += ids[spots + j].astype(np.uint64) * self.factors[j]
        return out

    def hits(self, texts: list[list[str]]) -> Iterator[tuple[int, int, list[int]]]:
        """(number of the text, first word, items) of each window of n words that is an item's."""
        get, sizes = self.number.get, [len(t) + 1 for t in texts]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.fromiter((x for t in texts for x in (*(get(w, 0) for w in t), 0)), np.uint32, int(starts[-1]))
        spots = self.windows(ids)
        if not len(spots) or not len(self.hashes):
            return
        own = self.hashed(ids, spots)
        first = np.searchsorted(self.hashes, own)
        near = self.hashes[np.minimum(first, len(self.hashes) - 1)] == own
        spots, first, last = spots[near], first[near], np.searchsorted(self.hashes, own[near], "right")
        text_of = np.searchsorted(starts, spots, "right") - 1
        whole, size = ids.tobytes(), 4 * self.n
        for s, a, b, k in zip(spots.tolist(), first.tolist(), last.tolist(), text_of.tolist(), strict=True):
            words_here = whole[4 * s : 4 * s + size]
            same = [x for x in self.spots[a:b].tolist() if self.stream[4 * x : 4 * x + size] == words_here]
            if same:
                items = dict.fromkeys(self.item_ids[i] for i in (np.searchsorted(self.starts, same, "right") - 1).tolist())
                yield k, s - int(starts[k]), list(items)


def _blocks(items: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of at most ``block_chars`` characters (or one item), read one after another."""
    rows = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text).distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


def _scanned(docs: DataFrame, blocks: Iterator[list[tuple[int, str | None]]], n: int, over) -> DataFrame:
    """The union of ``over(sent grams)`` of all blocks; of several, each is written before the next is sent."""
    context, parts = docs.sparkSession.sparkContext, []
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return over(context.broadcast(ItemGrams(block, n)))
    while block is not None:
        sent = context.broadcast(ItemGrams(block, n))
        parts.append(materialize(over(sent), "leaks"))
        sent.destroy()
        block, following = following, next(blocks, None)
    return reduce(DataFrame.unionByName, parts)


def _groups(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch in groups of about ``most`` characters, with the number of the first."""
    group, first, size = [], 0, 0
    for i, x in enumerate(batch.column(1)):
        group.append(x.as_py())
        size += len(group[-1] or "")
        if size >= most:
            yield first, group
            group, first, size = [], i + 1, 0
    if group:
        yield first, group


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item) for each document that has ``n`` or more consecutive words of an item.

    Words are compared as ``words`` folds them. Test items are the stated query
    set: their n-grams are broadcast in blocks of at most ``block_chars``
    characters, and for each block the documents are scanned once. Every window
    of n words of every whole document is looked up in a set of hashes, and
    each hit verified word by word.

    Null and empty texts, and texts or items of fewer than n words, give no
    rows, nor do null items; a null doc stays a row. Repeated documents and items
    give one row. Empty tables give an empty result. Other columns are not read.
    """
    rows = spread(docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")))
    kinds = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def over(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = sent.value
            for batch in batches:
                found: dict[tuple[int, object], None] = {}
                for first, group in _groups(batch):
                    found.update(((first + k, x), None) for k, _, own in grams.hits([words(t) for t in group]) for x in own)
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in found])), pa.array([x for _, x in found])], names=["doc", "item"])

        return rows.mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}")

    out = _scanned(docs, _blocks(items, item, item_text, block_chars), n, over)
    return out.distinct().select(F.col("doc").alias(doc), F.col("item").alias(item))


def without_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 12, drop_share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, text, leaked_words, dropped): the documents with the passages of test items taken out.

    Runs of leaked words go, with all signs between them, and leave one space.
    Where they make up ``drop_share`` or more of a document's words, the document is
    dropped: its text becomes null and dropped true. Null and empty texts and
    those without a leak stay as they are. Every row of ``docs`` gives one.

    What is cut depends on the text and the items alone: with one block of items
    it is found and cut in one pass; with several, the places found by each
    scan of the original texts are united by the text's digest and cut at once.
    """
    rows = spread(docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")))
    out = f"doc {docs.schema[doc].dataType.simpleString()}, text string, leaked_words long, dropped boolean"

    def places(grams: ItemGrams, batch: pa.RecordBatch) -> dict[int, set[int]]:
        hit = defaultdict(set)
        for first, group in _groups(batch):
            for k, at, _ in grams.hits([words(t) for t in group]):
                hit[first + k].update(range(at, at + n))
        return hit

    def cut(batch: pa.RecordBatch, hit: Mapping[int, set[int]]) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        leaked, dropped = [0] * len(texts), [False] * len(texts)
        for k, own in hit.items():
            leaked[k], dropped[k] = len(own), len(own) >= drop_share * len(words(texts[k]))
            texts[k] = None if dropped[k] else _cut(texts[k], own)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(leaked, pa.int64()), pa.array(dropped, pa.bool_())], names=["doc", "text", "leaked_words", "dropped"])

    def named(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"doc": doc, "text": text})

    blocks = _blocks(items, item, item_text, block_chars)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        sent = docs.sparkSession.sparkContext.broadcast(ItemGrams(block, n))

        def in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield cut(batch, places(sent.value, batch))

        return named(rows.mapInArrow(in_one, out))

    def over(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = places(sent.value, batch)
                if hit:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(list(hit))), pa.array([sorted(v) for v in hit.values()], pa.list_(pa.int32()))], names=["digest", "at"])

        return rows.where("text is not null").select(F.md5("text").alias("digest"), "text").mapInArrow(run, "digest string, at array<int>").dropDuplicates(["digest"])

    found = _scanned(docs, chain([block, following], blocks), n, over)
    found = found.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))  # at most the text's words for each block

    def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch, {k: set(v) for k, v in enumerate(batch.column(2).to_pylist()) if v})

    placed = rows.withColumn("digest", F.md5("text")).join(found, "digest", "left").select("doc", "text", "at")
    return named(placed.mapInArrow(by_place, out))


def _cut(text: str, leaked: set[int]) -> str:
    spans, parts, at = word_spans(text), [], 0
    k = 0
    while k < len(spans):
        if k not in leaked:
            k += 1
            continue
        first = k
        while k in leaked:
            k += 1
        parts.append(text[at : spans[first][0]].rstrip())
        at = spans[k - 1][1]
    return " ".join([*parts, text[at:].lstrip()]).strip()
