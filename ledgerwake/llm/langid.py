"""The language of documents and of their paragraphs, by cross-parsing."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.session import spread

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
#: The sample that the automata are built from: at most so many documents, and
#: so many characters of their segments, for each language.
SAMPLE_DOCS = 150
SAMPLE_CHARS = 40_000
#: Documents with longer texts are not part of the sample.
SAMPLE_DOC_CHARS = 20_000
#: A segment is parsed in windows of this many characters, all of which count.
WINDOW = 2_000
END = "\n"

#: Documents to a bag, and at most so many bags a language, when wrong labels are weeded out.
BAG_DOCS = 2
BAGS = 15

_TOKEN = re.compile(r"\w+(?:['’]\w+)*")
_ADDRESS = re.compile(r"://|www\.|@")


def segments(text: str | None) -> list[str]:
    """Maximal runs of lines that are not blank; lines end at a line feed."""
    out: list[list[str]] = []
    fresh = True
    for line in (text or "").split("\n"):
        if not line.strip():
            fresh = True
        elif fresh:
            out.append([line])
            fresh = False
        else:
            out[-1].append(line)
    return ["\n".join(x) for x in out]


def plain(segment: str) -> str:
    """The segment's words in lower case, between single spaces; empty if there is none.

    Moves, numbers, ids, addresses and names with digits or underscores are
    left out, and words of mixed case inside, as ids have.
    """
    s = segment if segment.isascii() else "".join(c for c in unicodedata.normalize("NFKC", segment) if unicodedata.category(c) != "Cf")
    if _ADDRESS.search(s):
        s = " ".join(x for x in s.split() if not _ADDRESS.search(x))
    kept, words = [], 0
    for w in _TOKEN.findall(s):
        bare = w.replace("'", "").replace("’", "")
        if bare.isalpha() and (bare.islower() or bare.isupper() or bare[1:].islower() or not bare.isascii()):
            kept.append(w)
            words += len(bare) > 1
    return f" {' '.join(kept).lower().replace('’', "'")} " if words else ""


def automaton(text: str) -> list[dict[str, int]]:
    """The suffix automaton of ``text``: for each state, from 0, its transitions."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return nxt


class Windows:
    """Texts cut into windows, the longest first."""

    def __init__(self, texts: list[str]) -> None:
        parts = [(i, t[k : k + WINDOW]) for i, t in enumerate(texts) for k in range(0, len(t), WINDOW)]
        parts.sort(key=lambda p: -len(p[1]))
        self.sizes = np.array([len(p) for _, p in parts], np.int64)
        self.chars = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le"), np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.owner = np.array([i for i, _ in parts], np.int64)
        self.length = np.array([max(1, len(t)) for t in texts])


class Parser:
    """Counts the phrases of cross-parsing texts against one language's sample.

    A phrase is the longest match, from where the one before ended, with any
    stretch of the sample. Only the automaton's edges are kept when a parser is
    sent elsewhere; the dense table is built where it is used.
    """

    def __init__(self, text: str) -> None:
        states = automaton(text)
        alphabet = [c for c in sorted(set(text) - {END}) if ord(c) < 0x3000][:254]
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        edges = [(i, number[c], s) for i, own in enumerate(states) for c, s in own.items() if c in number]
        self.alphabet, self.size, self.bits = "".join(alphabet), len(states), math.log2(len(text) + 2)  # bits: of one phrase
        self.edges = np.array(edges, np.int32).reshape(-1, 3)
        self._open()

    def __getstate__(self) -> tuple:
        return self.alphabet, self.size, self.bits, self.edges

    def __setstate__(self, state: tuple) -> None:
        self.alphabet, self.size, self.bits, self.edges = state
        self._open()

    def _open(self) -> None:
        """steps[state x width + code] holds the next state's row and, in its two lowest bits, the phrases that end."""
        width = len(self.alphabet) + 1
        self.codes = np.zeros(0x3001, np.uint8)  # of a character's number; 0 where the sample doesn't have it
        for i, c in enumerate(self.alphabet):
            self.codes[ord(c)] = i + 1
        start, code, end = self.edges.T
        fresh = np.full(width, 2, np.int64)  # an unknown character ends a phrase and is one itself
        root = start == 0
        fresh[code[root]] = end[root].astype(np.int64) * width * 4 + 1
        steps = np.tile(fresh.astype(np.int32), (self.size, 1))
        steps[start, code] = end * np.int32(width * 4)
        steps[0, 0] = 1  # no phrase is open at the root
        self.steps, self.width = steps.ravel(), width

    def phrases(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each stretch chars[start : start + size]; sizes must not rise."""
        codes = self.codes[np.minimum(chars, len(self.codes) - 1)].astype(np.int64)
        row, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
        for t, n in enumerate(alive):
            step = self.steps[row[:n] + codes[starts[:n] + t]]
            row[:n] = step >> 2
            count[:n] += step & 3
        return count + (row > 0)

    def cost(self, texts: list[str], windows: Windows | None = None) -> np.ndarray:
        """Normalised phrases of each text: bits a character."""
        w = windows or Windows(texts)
        return np.bincount(w.owner, self.phrases(w.chars, w.starts, w.sizes), len(texts)) * self.bits / w.length


class Model:
    """A Parser for each language that has a sample."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(x for x in samples if samples[x])
        self.parsers = [Parser(samples[x]) for x in self.names]

    def costs(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases of each text in each language."""
        windows = Windows(texts)
        return np.stack([p.cost(texts, windows) for p in self.parsers], axis=1)

    def best(self, texts: list[str]) -> list[tuple[str | None, float | None]]:
        """The language of each plain text and 1 - its cost / the next one's; nulls for an empty text."""
        if not self.parsers or not texts:
            return [(None, None)] * len(texts)
        costs = self.costs(texts)
        order = np.argsort(costs, axis=1, kind="stable")
        out: list[tuple[str | None, float | None]] = []
        for i, t in enumerate(texts):
            if not t:
                out.append((None, None))
                continue
            first = costs[i, order[i, 0]]
            second = costs[i, order[i, 1]] if costs.shape[1] > 1 else first
            out.append((self.names[order[i, 0]], float(1 - first / second) if second > 0 else 0.0))
        return out


def _fill(parts: list[str], most: int) -> str:
    out, size = [], 0
    for p in parts:
        if size + len(p) <= most:
            out.append(p)
            size += len(p) + 1
    return END.join(out)


def weeded(labelled: list[tuple[str, str]]) -> dict[str, list[str]]:
    """The plain segments of each language without those that look wrongly labelled.

    Each language's texts are dealt to small bags, and a segment is given to the
    language whose bags have the least median cost. As long as fewer than half
    of a language's bags hold a wrongly labelled text, these have no say.
    """
    texts: dict[str, list[str]] = {}
    for lang, text in dict.fromkeys(labelled):
        texts.setdefault(lang, []).append(text)
    parts = {x: [[p for s in segments(t) if (p := plain(s))] for t in own] for x, own in texts.items()}
    names = sorted(x for x, own in parts.items() if any(own))
    every = [(x, p) for x in names for own in parts[x] for p in own]
    if not every:
        return {}
    flat = [p for _, p in every]
    medians = []
    for x in names:
        full = [own for own in parts[x] if own]
        bags = [END.join(p for own in full[k : k + BAG_DOCS] for p in own) for k in range(0, min(len(full), BAG_DOCS * BAGS), BAG_DOCS)]
        medians.append(np.median([Parser(b).cost(flat) for b in bags], axis=0))
    best = np.argmin(medians, axis=0)
    kept: dict[str, list[str]] = {x: [] for x in names}
    for (x, p), k in zip(every, best, strict=True):
        if names[k] == x:
            kept[x].append(p)
    return kept


def train(labelled: list[tuple[str, str]], most: int = SAMPLE_CHARS) -> Model:
    """A model from (language, text), in a stable order; see weeded."""
    return Model({x: _fill(parts, most) for x, parts in weeded(labelled).items()})


def sample(docs: DataFrame, doc: str, text: str, code: str, per_language: int = SAMPLE_DOCS, languages: tuple[str, ...] = LANGUAGES) -> list[tuple[str, str]]:
    """At most ``per_language`` distinct labelled texts of each language, not blank, those of least hash."""
    seen = F.regexp_like(F.col(text), F.lit(r"(?U)[^\s\x1c-\x1f]"))  # not blank, as in segments
    rows = docs.where(F.col(code).isin(*languages) & (F.length(text) <= SAMPLE_DOC_CHARS) & seen).select(F.col(code).alias("code"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    w = Window.partitionBy("code").orderBy("h", "text")  # the row number is limited before the shuffle
    # Of a large language only the hashes below a threshold are ranked: three times
    # as many as are wanted, so that no task ranks a whole language. Copies of a text
    # have one hash and count once, so only hashes are sent to count them.
    counts = {r.code: r["count"] for r in rows.select("code", "h").distinct().groupBy("code").count().collect()}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 3 * per_language / n)))]) if counts else None
    if share is not None:
        rows = rows.where(F.pmod("h", F.lit(1 << 31)) < share[F.col("code")] * float(1 << 31))
    found = rows.distinct().withColumn("no", F.row_number().over(w)).where(F.col("no") <= per_language).orderBy("code", "no").collect()
    return [(r.code, r.text) for r in found]


def segment_languages(docs: DataFrame, doc: str, text: str, model: Model) -> DataFrame:
    """(doc, seg_no, lang, confidence, n_letters) of each segment of each whole text.

    lang is the language in which cross-parsing needs the fewest phrases, each
    weighed by log2 of the sample's length (phrases are found by walking the
    sample's suffix automaton), confidence 1 - its cost / the next language's.
    Both are null for a segment without words: moves, numbers, ids and signs.
    Null, empty and blank texts have no segments. Rows with a null or repeated
    doc are treated like others. One pass without a shuffle unless the input
    has few partitions; the model, bounded by SAMPLE_CHARS, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                rows, numbers, texts = [], [], []
                for i, x in enumerate(part.column(1)):
                    for k, s in enumerate(segments(x.as_py())):
                        rows.append(i)
                        numbers.append(k)
                        texts.append(plain(s))
                found = own.best(texts)
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array([x for x, _ in found], pa.string()), pa.array([c for _, c in found], pa.float64()), pa.array([len(t) - t.count(" ") for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "seg_no", "lang", "confidence", "n_letters"])

    rows = spread(docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")))
    kind = docs.schema[doc].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, seg_no int, lang string, confidence double, n_letters long").withColumnRenamed("doc", doc)


def document_languages(docs: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """(doc, lang, confidence, n_langs) of every document, from segment_languages.

    lang is the language of most letters, ties by name; confidence its share of
    the letters times its segments' mean confidence by letters; n_langs the
    number of languages. Documents without any language have nulls and 0.
    """
    per = found.where("lang is not null").groupBy(doc, "lang").agg(F.sum("n_letters").alias("n"), F.sum(F.col("confidence") * F.col("n_letters")).alias("c"))
    top = per.groupBy(doc).agg(F.max(F.struct("n", F.col("lang"), "c")).alias("x"), F.sum("n").alias("all"), F.count("*").alias("n_langs"))
    every = docs.select(doc).where(F.col(doc).isNotNull()).distinct().join(top, doc, "left")
    return every.select(doc, F.col("x.lang").alias("lang"), F.round(F.col("x.c") / F.col("all"), 6).alias("confidence"), F.coalesce("n_langs", F.lit(0)).alias("n_langs"))
