"""Language model, language identification, BPE and packing against brute force and libraries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, ngram_lm
from tidemark.llm.bpe import PrefixBpe, encode_decode
from tidemark.llm.packing import pack, plan, solve_patterns
from tidemark.llm.vocabulary import TokenizerFile

ODD = "abcAB'\"<|>endoftext stré ̸́=!\x85\xa0\x1c　Σσς İıßÀÿ²½×ªµﬁǅ𝒳中文हि٣​\n\t012�"


def odd_texts(n=300):
    r = random.Random(1)
    texts = ["".join(r.choices(ODD, k=r.randint(0, 40))) for _ in range(n)]
    return [*texts, None, "", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "ab" * 4000, "word " * 20_000, "don't we'll I'M"]


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\0end"]


class Reference:
    """The same model, counted in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count, top = order, Counter(), Counter()
        for t in texts:
            own = tokens(t)
            self.count.update(own)
            padded = ["\0start"] * (order - 1) + own
            top.update(tuple(padded[i : i + order]) for i in range(len(own)))
        self.levels = {order: top}
        for level in range(order - 1, 0, -1):
            self.levels[level] = Counter(g[1:] for g in self.levels[level + 1])
        self.n, self.v = sum(self.count.values()), len(self.count)
        of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d = {level: ngram_lm.discounts(*of(c)) for level, c in self.levels.items()}
        self.total, self.left = defaultdict(float), defaultdict(float)
        for level, c in self.levels.items():
            for g, n in c.items():
                self.total[level, g[:-1]] += n
                self.left[level, g[:-1]] += self.d[level][min(n, 3)]

    def prob(self, gram):
        level = len(gram)
        if not level:
            return 1 / (self.v + 1)
        total = self.total[level, gram[:-1]]
        if not total:
            return self.prob(gram[1:])
        n = self.levels[level][gram]
        return (max(n - self.d[level][min(n, 3)], 0) + self.left[level, gram[:-1]] * self.prob(gram[1:])) / total

    def score(self, text):
        own = tokens(text)
        padded = ["\0start"] * (self.order - 1) + own
        return sum(math.log10(self.prob(tuple(padded[i : i + self.order]))) for i in range(len(own)))


@pytest.mark.parametrize(("range_bytes", "share", "order", "ranges_a_task"), [(6_000_000, 0.003, 3, 16), (300, 0.01, 3, 1000), (2000, 0.01, 2, 3), (900, 0.003, 4, 16)])
def test_language_model(table, words, monkeypatch, range_bytes, share, order, ranges_a_task):
    monkeypatch.setattr(ngram_lm, "SPREAD_SHARE", share)
    monkeypatch.setattr(ngram_lm, "SPREAD_SAMPLE", 2)
    monkeypatch.setattr(ngram_lm, "RANGES_A_TASK", ranges_a_task)
    texts = [words(i, 60, 90) for i in range(60)] + [None, "", "The THE the", words(7, 20_000, 50), "e é É", "w1 w1 w1"]
    learned = [t for i, t in enumerate(texts) if i % 5]
    df = table(texts)
    model = ngram_lm.train(df.where("doc_id % 5 <> 0"), range_bytes=range_bytes, order=order)
    want = Reference(learned, order)
    assert (model.tokens, model.words, model.distinct) == (want.n, want.v, {level: len(c) for level, c in want.levels.items()})
    context = ("w1", "w2", "w1")[: order - 1]
    assert sum(want.prob((*context, w)) for w in [*want.count, "\0unknown"]) == pytest.approx(1)
    rows = ngram_lm.score(df, model, F.col("doc_id") % 5 == 0).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((want.count[w] + 1) / (want.n + want.v + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.held_out) == (len(own), sum(want.count[w] > 0 for w in own), r.doc_id % 5 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(want.score(texts[r.doc_id]), rel=1e-9)


def test_language_model_of_many_ranges_keeps_few_files_open(table, words):
    """Two thousand ranges: parts in files are fewer, and a reader holds ``MOST_MAPS`` of them at most."""
    import os

    import pyarrow as pa

    from tidemark.llm import ngram_store

    df = table([words(i, 400, 3000) for i in range(60)])
    model = ngram_lm.train(df, range_bytes=60)
    assert model.ranges > 2000 and model.parts < model.ranges / 10
    assert len(os.listdir(ngram_store.plain(model.folder))) <= 3 * model.parts
    batch = pa.record_batch([pa.array([1]), pa.array([words(3, 400, 3000)]), pa.array([False])], names=["doc_id", "text", "held_out"])
    before = len(os.listdir("/proc/self/fd"))
    assert len(list(ngram_lm._scores(model)(iter([batch])))) == 1
    assert 0 < len(ngram_store._MAPS) <= ngram_store.MOST_MAPS
    assert len(os.listdir("/proc/self/fd")) <= before + ngram_store.MOST_MAPS + 5


def test_language_model_of_nothing(table):
    model = ngram_lm.train(table([]))
    assert (model.tokens, model.words) == (0, 0)
    assert ngram_lm.score(table([]), model).count() == 0
    rows = ngram_lm.score(table(["a b", None]), model).collect()
    assert {(r.doc_id, r.n_tokens, r.score, r.base_score) for r in rows} == {(0, 3, 0.0, 0.0), (1, 1, 0.0, 0.0)}


def test_bpe_equals_the_library(table, vocabulary):
    from tokenizers import Tokenizer

    texts = odd_texts()
    library = Tokenizer.from_file(vocabulary)
    rows = encode_decode(table(texts), vocabulary).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
    assert encode_decode(table([]), vocabulary).count() == 0


def test_bpe_pieces_equal_plain_merging(vocabulary):
    bpe, r = PrefixBpe(TokenizerFile(vocabulary)), random.Random(3)
    for _ in range(2000):
        piece = "".join(r.choices("abcdefghinorstuy", k=r.randint(1, 14)))
        assert [bpe.file.names[i] for i in bpe.encode_piece(piece)] == bpe.merged((*piece[:-1], piece[-1] + "</w>"))


def test_packing_holds_every_id_once(table, vocabulary, words):
    from tokenizers import Tokenizer

    texts = [*odd_texts(60), *(words(i, 40 * i) for i in range(80)), *[words(5, 100)] * 30]
    library = Tokenizer.from_file(vocabulary)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = pack(table(texts), vocabulary).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(own)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 4096 - at
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-total // 4096) * 1.03 + 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert padding < 0.05 * total + 4096
    assert pack(table([]), vocabulary).count() == 0


def test_packing_repeated_rows(table, vocabulary):
    rows = pack(table([(1, "a b c"), (1, "a b c"), (None, None)]), vocabulary).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 4), (1, 4)]
    assert {r.sequence_id for r in rows} == {0}

def test_packing_of_short_texts_has_little_padding(table, vocabulary, words):
    for n in (0, 1, 4, 16, 50):
        texts = [words(3, n)] * 12_000
        rows = pack(table(texts).repartition(3), vocabulary).agg(F.sum("length"), F.countDistinct("sequence_id"), F.countDistinct("sequence_id", "offset"), F.count("*")).first()
        assert rows[2] == rows[3] >= len(texts)
        assert rows[1] * 4096 < 1.05 * rows[0] + 4096


def test_packing_of_any_capacity(table, vocabulary, words):
    texts = [words(i, i % 70) for i in range(200)]
    for capacity in (16, 64, 512):
        by_sequence = defaultdict(list)
        for r in pack(table(texts), vocabulary, capacity=capacity).collect():
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for own in by_sequence.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
            assert sum(n for _, n in own) <= capacity


def test_plan_that_is_cut_short_is_logged(caplog):
    histogram = {s: 100 + s for s in range(20, 120)}
    assert sum(n for _, n in plan(histogram, 256)) > 0 and not caplog.records
    columns, use = solve_patterns(np.arange(20, 120), np.full(100, 50.0), 256, rounds=2)
    assert "rounds" in caplog.text
    assert (np.einsum("ij,j->i", columns, use) > 49.999).all()


def test_plan_is_whole_and_close_to_the_bound():
    r = random.Random(2)
    histogram = {s: r.randrange(1, 900) for s in r.sample(range(1, 257), 120)}
    made = plan(histogram, 256)
    held = Counter()
    for pattern, times in made:
        assert sum(s * n for s, n in pattern.items()) <= 256
        assert times > 0
        for s, n in pattern.items():
            held[s] += n * times
    assert held == Counter(histogram)
    big = sum(n for s, n in histogram.items() if s > 128)
    bound = max(big, -(-sum(s * n for s, n in histogram.items()) // 256))
    assert sum(t for _, t in made) <= bound * 1.02 + 3
    assert plan({}, 256) == []


def test_language_accuracy_held_out(spark, sf_dir, vocabulary):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.train(docs.where(~out).select("doc_id", "text", "lang"), vocabulary)
    rows = langid.identify(docs, model, out).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(table, vocabulary, spark):
    texts = [None, "", "123 !?", "Ünïcode", "hello world", "中文", "٣٣", "é", "x" * 500_000, "hello world"]
    df = table(texts)
    model = langid.train(df.select("doc_id", "text", "lang"), vocabulary)
    rows = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {0, 1, 2, 6}
    assert all(rows[i].score == 0 for i in (0, 1, 2, 6))
    assert {rows[i].lang_pred for i in (3, 4, 5, 7, 8)} == {"en"}
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 7, 8, 9}
    assert langid.identify(table([]), model).count() == 0
    nothing = langid.train(table([], lang=None).select("doc_id", "text", "lang"), vocabulary)
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations(vocabulary):
    pieces = langid.Pieces.of([b"a", b"b", b"ab", b"b\0", b"\0", b"ab\0"])
    prob = np.random.default_rng(1).random((len(pieces.hashes), 2))
    place = {}
    for p in (b"a", b"b", b"ab", b"b\0", b"\0", b"ab\0"):
        h = langid._hash_rows(np.frombuffer(p, np.uint8)[None])[0, -1]
        place[p] = int(np.searchsorted(pieces.hashes, h))

    def total(rest):
        return np.ones(2) if not rest else sum((prob[i] * total(rest[len(p) :]) for p, i in place.items() if rest.startswith(p)), np.zeros(2))

    for word in (b"ab", b"aab", b"bab", b"b"):
        assert np.exp(langid.word_scores([word], pieces, prob))[0] == pytest.approx(total(word + b"\0"))


def test_language_stage_without_labels_keeps_texts_with_a_letter(spark, table, vocabulary):
    texts = ["the house by the sea", "é", "12 34", "", None, "!?", "la casa"]
    df = table(texts, lang=None)
    kept = langid.keep_identified(df, langid.train(df.select("doc_id", "text", "lang"), vocabulary))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 6]


def test_language_predictions_against_brute_force(spark, table, vocabulary):
    """Fit and prediction as a whole, by recursion over strings, with long words, marks and other characters."""
    import unicodedata
    from functools import cache

    r = random.Random(8)
    word = lambda letters, n: "".join(r.choices(letters, k=n))
    make = lambda letters: " ".join(word(letters, r.randint(1, 9)) for _ in range(12))
    rows = [(i, make("abcdeé" if i % 2 else "defghß"), "x" if i % 2 else "y") for i in range(24)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(learned, vocabulary)
    pieces = sorted(set(langid.read_pieces(vocabulary)))
    longest = max(map(len, pieces))

    def words(text):
        out, own = [], ""
        for c in (text or "").lower() + " ":
            if unicodedata.category(c)[0] in "LM":
                own += c
            elif own:
                out.append(own.encode())
                own = ""
        return out

    known, prob = set(pieces), {lang: dict.fromkeys(pieces, 1 / len(pieces)) for lang in "xy"}
    counts = {lang: Counter(w for _, t, lang2 in rows if lang2 == lang for w in words(t)) for lang in "xy"}

    def every(w):
        """All segmentations of a word."""
        if not w:
            return [[]]
        return [[w[:n], *rest] for n in range(1, len(w) + 1) if w[:n] in known for rest in every(w[n:])]

    for _ in range(langid.ROUNDS):
        for lang in "xy":
            expected = dict.fromkeys(pieces, langid.SMOOTHING)
            for w, n in counts[lang].items():
                ways = [(math.prod(prob[lang][p] for p in way), way) for way in every(w + b"\0")]
                total = sum(x for x, _ in ways)
                for x, way in ways:
                    for p in way:
                        expected[p] += n * x / total
            whole = sum(expected.values())
            prob[lang] = {p: x / whole for p, x in expected.items()}

    def log_of(w, lang):
        from fractions import Fraction

        w, sums = w + b"\0", [Fraction(1)]
        for j in range(1, len(w) + 1):
            sums.append(sum((sums[i] * Fraction(prob[lang][w[i:j]]) for i in range(max(0, j - longest), j) if w[i:j] in known), Fraction(0)))
            sums[-1] = sums[-1].limit_denominator(10**400) if len(w) < 60 else Fraction(int(sums[-1] * 2 ** (20 * j + 80)), 2 ** (20 * j + 80))
        top = sums[-1]
        return math.log(top.numerator) - math.log(top.denominator)

    log_of = cache(log_of)
    texts = ["abc fgh de", "– ab—gh ٣٣ 😀hh", "é" * 3 + " éa", word("abcde", 500) + " hg", word("dé", 90), "def", "", None, "12", "ab abc hh " * 20]
    got = {g.doc_id: g for g in langid.identify(table(texts), model).collect()}
    for i, text in enumerate(texts):
        own = words(text)
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        scores = {lang: sum(log_of(w, lang) for w in own) for lang in "xy"}
        best = max("xy", key=lambda lang: (scores[lang], -ord(lang)))
        other = "y" if best == "x" else "x"
        assert got[i].lang_pred == best, text
        assert got[i].score == pytest.approx(1 / (1 + math.exp(scores[other] - scores[best])), rel=1e-6), text
