"""The llm operators against brute force, public tokenizers and made-up cases."""

import hashlib
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwake.llm import bpe, langid, leakage, sampling, splits

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


# Sampling -------------------------------------------------------------------------


def chosen(data, rate):
    first = {}
    for k, b in data:
        if k is not None and b is not None:
            first[k] = min(first.get(k, b), b)
    out = set()
    for b in set(first.values()):
        own = sorted((k for k, v in first.items() if v == b), key=lambda k: (hashlib.md5(f"frozen-1:{k}".encode()).hexdigest()[:15], k))
        out |= {(k, b) for k in own[: -int(-rate * len(own) // 1)]}
    return out


def test_sample_is_exact_stable_and_frozen(spark):
    r = random.Random(3)
    data = [(r.choice([None, *range(300)]), r.choice([None, 1, 2, 3, 4])) for _ in range(900)]
    data += data[:99]
    df = spark.createDataFrame([(*x, 0) for x in data], "k long, load int, lo int")
    pick = lambda d: {tuple(x) for x in sampling.frozen_sample(d, "k", "load", 0.25, bins=8).collect()}
    got = pick(df)
    assert got == chosen(data, 0.25) == pick(df.repartition(7).orderBy(F.desc("k")))
    for k in (1, 2, 3):
        assert pick(df.where(F.col("load") <= k)) == {x for x in got if x[1] <= k}
    assert pick(df.limit(0)) == set() and pick(df.where("load is null")) == set()
    kept = sampling.sampled_rows(df, "k", "load", 0.25)
    assert kept.columns == df.columns and kept.count() == sum(k in {x for x, _ in got} for k, _ in data)


# Splits ---------------------------------------------------------------------------


def components(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None:
            root(("n", a))
            if b is not None:
                up[root(("n", a))] = root(("e", b))
    least = defaultdict(list)
    for x in list(up):
        if x[0] == "n":
            least[root(x)].append(x[1])
    return {n: min(own) for own in least.values() for n in own}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_linked_equals_union_find(spark, kind):
    r = random.Random(kind)
    if kind == "random":
        pairs = [(r.choice([None, *range(150)]), r.choice([None, *(f"c{i}" for i in range(120))])) for _ in range(260)]
    elif kind == "chain":
        pairs = [(i + d, f"c{i}") for i in range(60) for d in (0, 1)]
    else:
        pairs = [(i, "hub") for i in range(200)] + [(1000, None)]
    df = spark.createDataFrame([(*p, 0, "x") for p in pairs + pairs[:9]], "a long, b string, node int, least string")
    assert {x.a: x.group for x in splits.linked(df, "a", "b").collect()} == components(pairs)
    assert splits.linked(df.limit(0), "a", "b").count() == 0


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(8)
    data = [(r.randrange(2000), r.random() < 0.3) for _ in range(6000)] + [(-5, True)] * 900 + [(None, True), (7, None)]
    df = spark.createDataFrame(data, "g long, y boolean")
    want = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
    one, two = ({x.g: x.split for x in splits.grouped_splits(d, "g", [F.col("y")], want).collect()} for d in (df, df.repartition(5)))
    assert one == two and set(one) == {g for g, _ in data if g is not None}
    for label in (True, False):
        n = Counter(one[g] for g, y in data if g is not None and bool(y) == label)
        assert all(abs(n[s] / sum(n.values()) - p) < 0.02 for s, p in want)
    assert splits.grouped_splits(df.limit(0), "g", [F.col("y")], want).count() == 0


@pytest.mark.parametrize("target", [300, 100_000])
def test_small_groups_are_dealt_one_by_one(spark, target):
    """All but two groups are small here; a third of all rows lies in one of them, a third of the groups has equal counts."""
    r = random.Random(9)
    data = [(-1, i % 3 == 0) for i in range(3000)] + [(g, r.random() < 0.4) for g in range(1500) for _ in range(r.choice([1, 1, 3, 5]))] + [(5000 + i, True) for i in range(900)]
    df = spark.createDataFrame(data, "g long, y boolean")
    want = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
    one, two = ({x.g: x.split for x in splits.grouped_splits(d, "g", [F.col("y")], want, target_rows=target, large_share=50).collect()} for d in (df, df.repartition(5)))
    assert one == two and set(one) == {g for g, _ in data}
    n = Counter(one[g] for g, _ in data)
    assert all(abs(n[s] / len(data) - p) < 0.01 for s, p in want)
    sizes = Counter(g for g, _ in data)
    alike = [g for g, y in data if sizes[g] == 1 and y]
    single = Counter(one[g] for g in alike)
    lack = {s: p * len(data) - 3000 * (one[-1] == s) for s, p in want}
    assert all(abs(single[s] - len(alike) * lack[s] / sum(lack.values())) <= 5 for s, _ in want), "groups of equal counts are dealt evenly"


# Tokens ---------------------------------------------------------------------------

ODD = ["", " ", "a", "\n\n\t x", "it's  I'LL", "naïve ﬁ é é", "🙂🙂👩‍👩‍👧", "<|endoftext|> x", "\x00\x1c​ 　", "1234567890" * 30, "ab" * 3000, "…" * 999, "привет мир", "\r\n\r\n", "棋" * 50]


def test_ids_equal_the_public_tokenizer(encoder, public):
    for x in ODD:
        assert encoder.encode(x).tolist() == public.encode(x, add_special_tokens=False).ids, x[:20]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, public, text):
    assert encoder.encode(text).tolist() == public.encode(text, add_special_tokens=False).ids


def test_encode_texts(spark, encoder):
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate([*ODD, None])] + [(None, "a", [2]), (0, "a", [2])], "key long, text string, ids array<int>")
    got = [(x.key, x.ids) for x in bpe.encode_texts(df, "key", "text", VOCABULARY).collect()]
    assert sorted(got, key=str) == sorted([(i, encoder.encode(x).tolist()) for i, x in enumerate([*ODD, None])] + [(None, [64]), (0, [64])], key=str)
    assert bpe.encode_texts(df.limit(0), "key", "text", VOCABULARY).count() == 0


# Leakage --------------------------------------------------------------------------


def plain_words(text):
    kept = [c for c in unicodedata.normalize("NFKD", text or "") if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf"]
    return "".join(c if c.isalnum() else " " for c in "".join(kept).lower()).split()


def common(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [plain_words(t)] for i in range(len(w) - n + 1)}
    own = {i: grams(t) for i, t in items if i is not None}
    return {(d, i) for d, t in docs for i, g in own.items() if g & grams(t)}


def cleaned(text, items, n, drop_share):
    """(kept words, leaked, dropped) of one text against all items."""
    own = plain_words(text)
    grams = {tuple(w[i : i + n]) for _, t in items for w in [plain_words(t)] for i in range(len(w) - n + 1)}
    bad = {j for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in grams for j in range(i, i + n)}
    if bad and len(bad) >= drop_share * len(own):
        return None, len(bad), True
    return [w for j, w in enumerate(own) if j not in bad], len(bad), False


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_leaks_equal_brute_force(spark, block):
    r = random.Random(4)
    vocab = ["straße", "É́a", "éa", "x_1", "ﬁn", "z​z", "II", "Ⅱ", "a", "b", "don't"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "\n\n", "_"]) for _ in range(n))
    items = [(i, text(r.choice([2, 6, 20]))) for i in range(12)] + [(99, None), (98, ""), (None, text(9))]
    docs = [(i, text(30) + (r.choice(items)[1] or "")) for i in range(40)] + [(77, None), (78, ""), (79, text(4000))]
    docs += docs[:5]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc long, text string, item int")
    t = spark.createDataFrame([(*x, 0) for x in items + items[:3]], "id long, text string, doc int")
    got = leakage.leaks(d, "doc", "text", t, "id", "text", 4, block).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == common(docs, items, 4)
    clean = leakage.without_leaks(d, "doc", "text", t, "id", "text", 4, 0.5, block).collect()
    known = [(i, x) for i, x in items if i is not None]
    want = Counter((i, *(lambda k, n, gone: (None if x is None or gone else tuple(k), n, gone))(*cleaned(x, known, 4, 0.5))) for i, x in docs)
    assert Counter((x.doc, None if x.text is None else tuple(plain_words(x.text)), x.leaked_words, x.dropped) for x in clean) == want
    assert {(x.doc, x.text) for x in clean if x.doc in (77, 78)} == {(77, None), (78, "")}
    assert leakage.leaks(d.limit(0), "doc", "text", t, "id", "text").count() == 0
    assert leakage.leaks(d, "doc", "text", t.limit(0), "id", "text").count() == 0


def test_only_the_passage_is_cut(spark):
    d = spark.createDataFrame([(1, "Keep this.\n\nThe QUICK, brown fóx jumps!! And that, and more words, and others here.")], "doc long, text string")
    t = spark.createDataFrame([(5, "the quick brown fox jumps")], "id long, text string")
    assert leakage.without_leaks(d, "doc", "text", t, "id", "text", 5).first() == (1, "Keep this. !! And that, and more words, and others here.", 5, False)
    assert leakage.without_leaks(d, "doc", "text", t, "id", "text", 5, 0.2).first() == (1, None, 5, True)
    assert leakage.word_spans("a_bc éd") == [(0, 1), (2, 4), (5, 8)]


def test_passages_of_two_blocks_overlap(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    d = spark.createDataFrame([(1, " ".join(w))], "doc long, text string")
    t = spark.createDataFrame([(1, " ".join(w[10:28])), (2, " ".join(w[20:36]))], "id long, text string")
    for block in (10, 10_000):
        assert leakage.without_leaks(d, "doc", "text", t, "id", "text", block_chars=block).first() == (1, " ".join(w[:10] + w[36:]), 26, False)


# Languages ------------------------------------------------------------------------

WORDS = {
    "en": "the game was lost because nobody could answer when that board had gone dark and we waited for another round".split(),
    "de": "das spiel ging verloren weil niemand antworten konnte als das brett dunkel wurde und wir auf eine runde warteten".split(),
    "ru": "партия была проиграна потому что никто не мог ответить когда доска погасла и мы ждали новую партию".split(),
}


def sentence(r, lang, n=14):
    return " ".join(r.choices(WORDS[lang], k=n)).capitalize() + "."


def brute_phrases(sample, text):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.text("abc é\n", max_size=60), st.lists(st.text("abcd éж", min_size=1, max_size=40), min_size=1, max_size=8))
def test_phrases_equal_brute_force(sample, texts):
    parser, w = langid.Parser(sample), langid.Windows(texts)
    counts = dict(zip(w.owner.tolist(), parser.phrases(w.chars, w.starts, w.sizes).tolist(), strict=True))
    assert counts == {i: brute_phrases(sample, t) for i, t in enumerate(texts)}


def test_segments_and_words():
    assert langid.segments(None) == langid.segments(" \n\t\n") == []
    assert langid.segments("a\nb\r\n\r\n \nc") == ["a\nb\r", "c"]
    for x in ("12. Nf3 Qe4+ O-O", "#54693 / 91:25", "a3e1ed78dc5b", "NfEvT79X", "…", "https://x.org/abc"):
        assert langid.plain(x) == ""
    assert langid.plain("L’ÉTÉ, été!") == " l'été été "


def test_languages_in_spite_of_wrong_labels(spark):
    r = random.Random(6)
    labelled = [("en" if k % 6 == 0 else lang, "\n\n".join(sentence(r, lang) for _ in range(3))) for k in range(40) for lang in WORDS]
    model = langid.train(labelled)
    truth, docs = {}, []
    for i in range(60):
        langs = r.choices(sorted(WORDS), k=r.choice([1, 2, 3]))
        docs.append((i, "\n\n".join([*(sentence(r, x) for x in langs), "1. e4 e5"])))
        truth |= {(i, k): x for k, x in enumerate([*langs, None])}
    docs += [(900, None), (901, ""), (902, " \n "), (903, sentence(r, "de", 4000))]
    df = spark.createDataFrame([(*x, "zz") for x in docs], "doc long, text string, lang string")
    found = langid.segment_languages(df, "doc", "text", model)
    assert {(x.doc, x.seg_no): x.lang for x in found.collect()} == truth | {(903, 0): "de"}
    assert all((x.confidence is None) == (x.lang is None) and (x.lang is None or 0 <= x.confidence <= 1) for x in found.collect())
    whole = {x.doc: (x.lang, x.n_langs) for x in langid.document_languages(df, found, "doc").collect()}
    assert whole[903] == ("de", 1) and whole[900] == whole[901] == whole[902] == (None, 0) and len(whole) == len(docs)
    assert langid.segment_languages(df, "doc", "text", langid.train([])).where("lang is not null").count() == 0
    assert langid.segment_languages(df.limit(0), "doc", "text", model).count() == 0


def test_sample_takes_distinct_texts(spark):
    own = [("en", f"text number {i}") for i in range(900)]
    hot = own[0][1]
    rows = own + [("en", hot)] * 5000 + [("en", "")] * 3000 + [("en", x) for x in (" \n\t", "\u00a0\u2003", "\x1c \x85")] * 50 + [("de", "ein Text")] * 400
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)], "d long, c string, t string")
    found = langid.sample(df, "d", "t", "c")
    assert len(found) == len(set(found)) == 151 and ("de", "ein Text") in found and all(t.strip() for _, t in found)
    hashes = {r.t: r.h for r in df.where("c = 'en'").select("t", F.xxhash64("t").alias("h")).distinct().collect()}
    below = [t for _, t in own if hashes[t] % (1 << 31) < 3 * 150 / 900 * (1 << 31)]
    assert [t for c, t in found if c == "en"] == sorted(below, key=lambda t: hashes[t])[:150]
