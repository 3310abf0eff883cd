"""Fingerprints, periodic runs and conversation repair against brute force."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import conversation_repair as repair
from tidemark.llm import fingerprints as prints
from tidemark.llm.fingerprints import edited_fingerprints, fingerprints
from tidemark.llm.periodic_runs import collapse, least_level, periodic_runs, run_report, runs_of_texts, with_planted_period

SPACE = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def split(text):
    return (text or "").encode().split()


# Fingerprints


def expected_print(text):
    """The method on plain Python numbers."""
    r_table, q_table, c_table = prints.gamma_tables()
    groups, inner, alone = prints.multipliers()
    counts = Counter(split(text))
    part = lambda v: v - math.floor(v)
    out = []
    for g in groups:
        for j in inner:
            least = None
            for word, n in counts.items():
                h = int(hashlib.md5(word).hexdigest()[:13], 16)
                x, y = (h >> 26) / 2**26, (h & (2**26 - 1)) / 2**26
                z = part(x * alone[0] + y * alone[1] + alone[2])
                x, y = part(x * g[0] + y * g[1] + g[2]), part(x * g[3] + y * g[4] + g[5])
                i, c, b = (part(x * j[k] + y * j[k + 1] + j[k + 2]) for k in (0, 3, 6))
                r, q, c = r_table[int(i * 1024)], q_table[int(i * 1024)], c_table[int(c * 1024)]
                t = math.floor(math.log(n) * q + b)
                v = math.floor((c - r * (t - b + 1) + 64) * 2**24) * 65536 + math.floor(part(z + t * prints.STEP) * 65535)
                least = v if least is None else min(least, v)
            out.append("ffff" if least is None else f"{least % 65536:04x}")
    return "".join(out)


def shared(a, b):
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / prints.SAMPLES


def test_fingerprints_equal_the_method_on_plain_numbers(table, words):
    texts = [(5, words(1, 40)), (3, None), (9, ""), (7, " \t "), (1, "a a a b"), (2, "éa̲😀 x"), (8, words(2, 3000, 50)), (11, "ab"), (10, words(1, 40)), (None, "first of all")]
    texts += [(7, "twice"), (7, "twice")]
    rows = {(r.doc_id, r.n_chars, r.fingerprint): r for r in edited_fingerprints(table(texts)).collect()}
    assert edited_fingerprints(table(texts)).count() == len(texts)
    key = lambda x: (x[0] is not None, x[0])
    alone = sorted((t for t in texts if t[0] != 7), key=key)
    for (doc_id, text), (_, after) in zip(alone, [*alone[1:], alone[0]], strict=True):
        text, prints_of = text or "", expected_print(text)
        r = rows[doc_id, len(text), prints_of]
        if doc_id == 2:  # the documents 3, 5 and 7 follow
            assert r.near_next == shared(prints_of, expected_print(None))
        if doc_id == 5:
            continue  # several documents 7 follow
        q = len(text) // 4
        edited = text[: len(text) - q] + (after or "")[:q]
        assert (r.edited_sha256, r.edited_fingerprint) == (sha(edited), expected_print(edited))
        assert (r.near_edited, r.near_next) == (shared(prints_of, expected_print(edited)), shared(prints_of, expected_print(after)))


def test_fingerprints_of_one_document_and_of_none(table):
    (one,) = edited_fingerprints(table(["a b c d"])).collect()
    assert (one.edited_sha256, one.near_next) == (sha("a b c a"), 1.0)
    assert edited_fingerprints(table([])).count() == 0


def test_collisions_estimate_generalised_jaccard(spark):
    r = random.Random(4)
    pairs, wanted = [], []
    for k in range(150):
        a = Counter({f"{k}-{i}": r.choice([1, 1, 2, 5, 40]) for i in range(30)})
        b = Counter({w: max(1, n * r.choice([1, 1, 2, 3]) // r.choice([1, 1, 2])) if r.random() < 0.8 else 0 for w, n in a.items()})
        text = lambda c: " ".join(c.elements())
        pairs.append((k, text(a), text(b)))
        wanted.append(sum((a & b).values()) / sum((a | b).values()))
    got = {x.row_no: x.same / prints.SAMPLES for x in fingerprints(spark.createDataFrame(pairs, "row_no long, a string, b string"), ["a", "b"]).collect()}
    errors = [got[k] - w for k, w in enumerate(wanted)]
    assert abs(sum(errors) / len(errors)) < 0.02
    spread = math.sqrt(sum(e * e for e in errors) / len(errors))
    assert spread < 1.25 * math.sqrt(sum(w * (1 - w) for w in wanted) / len(wanted) / prints.SAMPLES)


# Periodic runs


def brute_runs(w, least=24, periods=3):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, periods * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        text = []
        for _ in range(r.randrange(6)):
            unit = [r.choice("abc"[: r.randrange(1, 4)]) for _ in range(r.choice([1, 2, 3, 8, 12, 30]))]
            text += (unit * r.randrange(1, 12))[: r.randrange(1, 140)]
        yield [x.encode() for x in text]


@pytest.mark.parametrize("least,periods", [(24, 3), (10, 2), (6, 3), (1, 2)])
def test_runs_equal_brute_force(least, periods):
    texts = list(periodic_texts(least, 400))
    for start in range(0, len(texts), 5):
        some = texts[start : start + 5]
        assert runs_of_texts(some, least, periods) == [brute_runs(w, least, periods) for w in some]


def test_least_level():
    assert least_level(24, 3) == 16
    assert runs_of_texts([]) == [] and runs_of_texts([[]]) == [[]]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_of_a_table(table, words):
    texts = [(i, " ".join(x.decode() for x in w)) for i, w in enumerate(periodic_texts(9, 150))]
    texts += [(200 + i, words(i, 30 * i)) for i in range(60)] + [(300, None), (301, ""), (302, SPACE), (None, "é " * 40), (304, "x\x85y " * 30), (305, "a b " * 40_000), (0, texts[0][1])]
    df = table(texts)
    rows = run_report(periodic_runs(df, with_planted_period(F.col("text"), F.col("doc_id")))).collect()
    assert len(rows) == len(texts)
    wanted = []
    for doc_id, text in texts:
        w = planted(doc_id, split(text))
        runs = [(0, 80_000, 2)] if doc_id == 305 and w == split(text) else brute_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        assert kept == b" ".join(collapse(w, runs)).decode()
        wanted.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)))
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)
    assert run_report(periodic_runs(table([]))).count() == 0


# Conversation repair

TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("row_no", T.StringType()), T.StructField("content", T.StringType()), T.StructField("n", T.LongType())])
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(rows):
    """Cost, audit and repaired rows of (role, text, fault), by a search over all edits."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q) in done:
            continue
        done.add((i, q))
        name = "user" if GIVEN[q] == 2 else "assistant"
        heapq.heappush(heap, (cost + 2, audit + "I", i, GIVEN[q], (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
            if fault in ("", "truncated"):
                stays = int(fault == "truncated")
                if (q, role[:1]) in AFTER:
                    heapq.heappush(heap, (cost + stays, audit + "K", i + 1, AFTER[q, role[:1]], (*out, (role, text))))
                heapq.heappush(heap, (cost + stays + 2, audit + "R", i + 1, GIVEN[q], (*out, (name, text))))


def expected_repairs(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            core = text.strip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, out = cheapest([(r, x, f) for (_, r, x), f in zip(own, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out)


def conversations(seed):
    r = random.Random(seed)
    texts = ["Hello.", "Hello", "", " \n", None, "Why? ", "Well!\t", "é.", "x" * 50, "y" * 40 + ".", "y" * 40 + "?"]
    roles = ["user", "assistant", "user", "assistant", "system", "user", "tool", "", None, "u2", "a-very-long-role-name-1", "a-very-long-role-name-2"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.choice([1, 2, 5, 9, 40])):
            rows.append((conv, r.choice([turn, turn, turn, turn // 2, None, turn + 3]), r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"{conv} {turn}.", "x", "y", 1))
    rows += [(77, i % 500, "user", "again.", "x", "y", 1) for i in range(3000)] + [(78, i, ("user", "assistant")[i % 2], f"line {i}.", "x", "y", 1) for i in range(2500)]
    return rows


@pytest.mark.parametrize("piece_rows,parts", [(4096, 1), (4096, 7), (50, 3)])
def test_repair_against_a_search(spark, monkeypatch, piece_rows, parts):
    rows = conversations(parts)
    df = spark.createDataFrame(rows, TURN).repartition(3)
    broken = repair.damaged(df)
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    if piece_rows < 4096:  # pieces are cut in the workers
        monkeypatch.setattr(repair._Piece, "full", eval(f"lambda self: len(self.rows) >= {piece_rows}"))
    with_parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = repair.repair_conversations(broken, present_col="present", digests=True).collect()
        whole = repair.repair_conversations(broken, present_col="present").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(expected_repairs(rows), key=repr)
    assert sorted(((*r[:8], sha("\n".join(f"{a}:{b}" for a, b in w[8]))) for r, w in zip(sorted(map(tuple, got), key=repr), want, strict=True)), key=repr) == sorted(map(tuple, got), key=repr)
    assert [r[:8] for r in sorted(map(tuple, got), key=repr)] == [w[:8] for w in want]
    assert sorted(((*r[:8], tuple(map(tuple, r[8]))) for r in whole), key=repr) == want


def test_repair_of_dropped_rows_and_of_none(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = repair.damaged(spark.createDataFrame([(gone, 0, "user", "a.", "", "", 0)], TURN))
    assert [tuple(r) for r in repair.repair_conversations(df, present_col="present", digests=True).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert repair.repair_conversations(spark.createDataFrame([], TURN)).count() == 0


def test_powers_advance_runs():
    r = random.Random(2)
    for _ in range(300):
        symbols = [s for _ in range(r.randrange(6)) for s in [r.randrange(16)] * r.choice([1, 2, 3, 9])]
        runs = [(s, len(list(same))) for s, same in groupby(symbols)]
        one = many = repair.END
        for s in reversed(symbols):
            one = repair.apply(repair.power(s, 0), one)
        for s, n in reversed(runs):
            many = repair.advance(s, n, many)
        assert one == many == repair.apply(repair.transition(runs), repair.END)


def test_a_worker_holds_the_caches_of_one_operator():
    from tidemark.llm import worker

    worker.drop_others("")
    worker.held("one")["path"] = "cache"
    assert list(worker.releasing(iter, "one")([1, 2])) == [1, 2]
    assert worker.held("one") == {"path": "cache"}
    assert list(worker.releasing(iter)([3])) == [3]
    assert worker.held("one") == {}
