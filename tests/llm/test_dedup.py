"""Exact dedup, n-gram Jaccard join and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.components import connected_components
from tidemark.llm.exact_dedup import drop_exact_copies, exact_dedup
from tidemark.llm.fm_index import FmIndex
from tidemark.llm.jaccard_join import choose_bands, drop_near_copies, jaccard_classes
from tidemark.llm.substring_dedup import remove_repeats


def sha(x):
    return hashlib.sha256((x or "").encode()).hexdigest()


def copies(words):
    """Two large groups of copies, small ones, nulls, empty, blank and very long texts."""
    long = words(1, 30_000)
    return [words(5, 30)] * 40 + [words(6, 8)] * 3 + ["", None, " ", "a", long, long] + [words(100 + i, 20) for i in range(60)]


@pytest.mark.parametrize("support", [0.001, 0.1])
def test_exact_groups(table, words, support):
    texts = copies(words)
    df = table(texts + [(3, texts[3])])  # a row that repeats id and text
    rows = exact_dedup(df, support=support).collect()
    assert len(rows) == len(texts) + 1
    groups = defaultdict(list)
    for r in rows:
        assert r.text_sha256 == sha(texts[r.doc_id])
        groups[r.text_sha256].append(r)
    for own in groups.values():
        assert {r.group_size for r in own} == {len(own)}
        assert {r.keep_id for r in own} == {max(r.doc_id for r in own)}
        assert sum(r.kept for r in own) == 1
        assert next(r for r in own if r.kept).doc_id == own[0].keep_id
    kept = drop_exact_copies(df, support=support)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_exact_null_ids_and_empty_table(table):
    rows = exact_dedup(table([(None, "a"), (2, "a"), (None, "b")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(None, 2, False), (2, 2, True), (None, None, True)}
    assert drop_exact_copies(table([(None, "a"), (2, "a"), (None, "b")])).count() == 2
    assert exact_dedup(table([])).count() == 0
    assert drop_exact_copies(table([])).count() == 0


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(words):
    base, other = words(50, 120).split(), words(51, 60).split()
    texts = []
    for i in range(30):  # a group of near copies, neighbours closer than the ends
        w = base.copy()
        w[(7 * i) % 120] = f"x{i}"
        if i % 3:
            w[(11 * i + 5) % 120] = f"y{i}"
        texts.append(" ".join(w))
    for i in range(6):
        texts.append(" ".join(other[: 60 - i]))
    for n in (90, 96, 108, 120, 135, 150, 168, 187):  # sets of many sizes with a common beginning
        texts.append(words(52, n))
    return [*texts, texts[0], texts[0], "one two", "one two", "one two three", "", None, " \n", words(60, 9000), words(60, 9000) + " z"] + [
        words(200 + i, 40) for i in range(40)
    ]


@pytest.mark.parametrize("part_rows", [1024, 5])
def test_jaccard_against_all_pairs(table, words, monkeypatch, part_rows):
    monkeypatch.setattr("tidemark.llm.jaccard_join.PART_ROWS", part_rows)
    texts = near(words)
    sets = [shingles(t) for t in texts]
    links, parent = defaultdict(int), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    df = table(texts)
    rows = {r.doc_id: r for r in jaccard_classes(df).collect()}
    assert len(rows) == len(texts)
    assert {i: r.class_id for i, r in rows.items()} == {i: find(i) for i in range(len(texts))}
    assert {i: r.n_links for i, r in rows.items()} == {i: links[i] for i in range(len(texts))}
    assert {i for i, r in rows.items() if r.kept} == {find(i) for i in range(len(texts))}
    assert max(links.values()) > 10
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(texts))}


def test_jaccard_edges(table):
    assert jaccard_classes(table([])).count() == 0
    rows = jaccard_classes(table([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (4, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.kept) for r in rows) == [(0, 0, True), (1, 1, False), (1, 1, True), (4, 0, True)]
    assert drop_near_copies(table([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (4, "")])).count() == 3


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def repeats(texts, window=20):
    first, out = set(), {}
    for i, text in enumerate(texts):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in first:
                gone[s : s + window] = [True] * window
            first.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def passages(words):
    shared, texts = words(70, 60), []
    for i in range(25):
        cut = words(70, 60).split()[i : 25 + 2 * i]
        texts.append(f"{words(300 + i, 15)}\n{shared if i % 3 else ' '.join(cut)} {words(400 + i, 9)}")
    return [*texts, texts[2], "a " * 70, "a " * 45, "é ü " * 30, None, "", " \t", "short text", words(80, 25_000), words(80, 21), words(81, 19)]


@pytest.mark.parametrize(("spread", "hot"), [(200, 0.9), (2, 0.9), (200, 0.001), (2, 0.02)])
def test_substrings_against_brute_force(table, words, monkeypatch, spread, hot):
    monkeypatch.setattr("tidemark.llm.substring_dedup.SPREAD_FROM", spread)
    monkeypatch.setattr("tidemark.llm.substring_dedup.HOT_SHARE", hot)
    monkeypatch.setattr("tidemark.llm.substring_dedup.HOT_SAMPLE", 1)
    texts = passages(words)
    want = repeats(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(table(texts)).collect()}
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 500
    small = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(table(texts), shard_bytes=2000).collect()}
    assert small == want
    digests = {r.doc_id: r.kept_sha256 for r in remove_repeats(table(texts), digests=True).collect()}
    assert digests == {i: sha(kept) for i, (_, _, kept) in want.items()}


def test_substrings_of_a_hot_anchor_in_different_contexts(table, words, monkeypatch):
    """Eight words that all documents hold amid words of their own, and a whole passage that most of them hold."""
    monkeypatch.setattr("tidemark.llm.substring_dedup.HOT_SAMPLE", 1)
    common, passage = "the of and to in a is it", words(5, 45)
    texts = [f"{words(500 + i, 14, 9000)} {common} {words(700 + i, 14, 9000)} {passage if i % 4 else ''} {words(900 + i, 3)}" for i in range(300)]
    want = repeats(texts)
    for shard_bytes in (6_000_000, 5000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(table(texts), shard_bytes=shard_bytes).collect()}
        assert got == want
    assert sum(n for _, n, _ in want.values()) >= 224 * 45


def test_substring_edges(table, words):
    assert remove_repeats(table([])).count() == 0
    text = words(90, 40)
    rows = remove_repeats(table([(1, text), (1, text), (None, text)])).collect()
    # A null id comes first; rows that repeat id and text are one document.
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 40), (1, 40)]


def test_substrings_of_many_rows_with_one_id_and_text(table, words):
    """One earlier copy, many rows that repeat a document, and one that holds it twice in itself."""
    text = words(91, 60)
    rows = [(1, text), *[(2, text)] * 1500, (3, f"{text} {text}"), *[(4, words(92, 30))] * 900]
    got = {}
    for r in remove_repeats(table(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got == {1: [(60, 0)], 2: [(60, 60)] * 1500, 3: [(120, 120)], 4: [(30, 0)] * 900}


def test_fm_index_finds_earlier_windows():
    rng = np.random.default_rng(5)
    for _ in range(100):
        texts = [rng.integers(1, 4, rng.integers(3, 15)).astype(np.uint64) for _ in range(rng.integers(1, 25))]
        index = FmIndex(np.concatenate(texts), np.array([len(t) for t in texts]))
        got = {(p, q) for p, s, n in zip(*index.repeated_windows(5), strict=True) for q in range(s, s + n)}
        every = {(p, q) for p, s, n in zip(*index.repeated_windows(5, anywhere=True), strict=True) for q in range(s, s + n)}
        assert every == {(p, q) for p, x in enumerate(texts) for q in range(len(x) - 4)}
        seen, want = set(), set()
        for p, x in enumerate(texts):
            for q in range(len(x) - 4):
                key = tuple(x[q : q + 5])
                if key in seen:
                    want.add((p, q))
                seen.add(key)
        assert got == want


def test_components_of_long_shuffled_chains(spark):
    ids = list(range(700))
    random.Random(3).shuffle(ids)
    chain, ring, star = ids[:500], ids[500:600], ids[600:]
    edges = [*zip(chain, chain[1:]), *zip(ring, [*ring[1:], ring[0]]), *((i, max(star)) for i in star), (chain[3], chain[4]), (900, 900)]
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(own) for own in (chain, ring, star) for i in own}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
