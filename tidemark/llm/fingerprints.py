"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is the multiset of its words, each weighted by its count. For each of the samples a word with
weight w draws r and c from Gamma(2, 1) and b from [0, 1), which depend on the word and the sample
alone; t = floor(ln(w) / r + b), and ln(a) = ln(c) - r * (t - b + 1). The word of the least a, with
its t, is the sample. Two texts agree in a sample with the probability of their generalised Jaccard
similarity, the sum of the lesser weights over the sum of the greater ones.

r and ln(c) come by inversion from tables of 1,024 equally likely values (b has 26 bits, so that a is
as good as continuous). For c a bin's value is the one that keeps the mean of 1 / c, which makes the lower
tail of a, where the least ones lie, exact. A sample is kept as 16 bits; different samples agree by chance
once in 65,535. ln(a) counts to 24 binary places, ties going to the smaller bits. Hashes are
linear in two fractions of 26 bits from a word's MD5, exact in doubles, and their upper bits are used.

Rows stay where one exchange by row number has put them: the next document's first characters come
there, words are counted, and samples are taken and reduced without a further exchange. No key holds more
than one document. Samples are taken in groups, each word once per group, whatever texts of the row hold it.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a null text counts as empty; a text without words has a
fingerprint of its own (all ones), equal only to that of other such texts; documents follow each other by
id (nulls first), rows that repeat an id by the hash of their text; rows that repeat id and text are
documents of their own with equal fingerprints; an empty table gives an empty result; further columns,
whatever their names, play no part.
"""

from __future__ import annotations

import math
import random
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Samples of a fingerprint, and how many of them are taken together: the code made for eight is more than the JVM compiles.
SAMPLES, TOGETHER = 64, 4
#: Entries of the tables of gamma values; bits of a hash; values of a kept sample, and of its bits.
LEVELS, BITS, KEPT, KEPT_BITS = 1024, 26, 65535, 65536
#: ln(a) is counted from here, in so many parts; no sample reaches the first, as ln(w) at 2**63 is 44.
FLOOR, PARTS = 64.0, float(1 << 24)
#: Fixed value: what each t adds to a word's number, as a share of 1.
STEP = 40503 / 65536


@cache
def gamma_tables() -> tuple[list[float], list[float], list[float]]:
    """Values of r, of 1 / r, and of ln(c), for equally likely parts of Gamma(2, 1)."""

    def quantile(p: float) -> float:
        low, high = 0.0, 100.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if 1 - math.exp(-mid) * (1 + mid) < p else (low, mid)
        return low

    edges = [quantile(i / LEVELS) for i in range(LEVELS)] + [math.inf]
    middle = [quantile((i + 0.5) / LEVELS) for i in range(LEVELS)]
    kept = [1 / LEVELS / (math.exp(-a) - math.exp(-b)) for a, b in zip(edges, edges[1:], strict=False)]
    short = lambda x: round(x * 2**24) / 2**24  # noqa: E731  the same in any engine that reads it
    return [short(r) for r in middle], [short(1 / r) for r in middle], [short(math.log(c)) for c in kept]


@cache
def multipliers() -> tuple[list[list[float]], list[list[float]], list[float]]:
    """Odd factors and terms a, b, c of the hashes: two per group of samples, three per sample of a group, one of the word alone."""
    r = random.Random(20_260)
    draw = lambda n: [x for _ in range(n) for x in (float(r.getrandbits(BITS - 1) * 2 + 1), float(r.getrandbits(BITS - 1) * 2 + 1), r.getrandbits(BITS) / 2**BITS)]
    return [draw(2) for _ in range(SAMPLES // TOGETHER)], [draw(3) for _ in range(TOGETHER)], draw(1)


def _part(x: Column) -> Column:
    """What stands after the point of a positive number."""
    return x - F.floor(x)


def _linear(x: Column, y: Column, a: object, b: object, c: object) -> Column:
    """A hash of two fractions of BITS bits each, as such a fraction; exact in doubles, where nothing can overflow."""
    return _part(x * a + y * b + c)


def _table(values: list[float]) -> Column:
    """A constant array; Spark folds the text away."""
    return F.from_json(F.lit(str(values)), "array<double>")


def fingerprints(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Per ``row_no``, which is unique: the fingerprints of its texts, under their names, and ``same``.

    ``same`` counts the samples in which the first two texts, if there are two, agree. Without an exchange of
    ``rows`` by ``row_no`` there will be one; with it, there is none.
    """
    (r_table, q_table, c_table), (groups, inner, alone) = map(_table, gamma_tables()), multipliers()
    weights = [f"w{k}" for k in range(len(texts))]
    words = (
        rows.select("row_no", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(t).alias("text")) for k, t in enumerate(texts)])).alias("s"))
        .select("row_no", F.col("s.k").alias("k"), F.explode(F.split("s.text", r"[\x20\x09-\x0D]+", -1)).alias("word"))
        .groupBy("row_no", "word")
        .agg(*[F.count(F.when(F.col("k") == k, 1)).alias(w) for k, w in enumerate(weights)])
    )
    number = F.coalesce(F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 13), 16, 10).cast("long"), F.lit(0))
    # The empty word, which stands at the ends of a text and for a text without words, has no weight and takes no sample.
    numbered = words.select("row_no", *[F.when((F.col(w) > 0) & (F.col("word") != ""), F.log(F.col(w).cast("double"))).alias(w) for w in weights], number.alias("x")).select(
        "row_no", *weights, (F.shiftright("x", BITS) / F.lit(2.0**BITS)).alias("x"), (F.col("x").bitwiseAND(F.lit(2**BITS - 1)) / F.lit(2.0**BITS)).alias("y")
    )
    factors = F.array(*[F.struct(F.lit(g).alias("g"), *[F.lit(c).alias(n) for n, c in zip("abcdef", row, strict=True)]) for g, row in enumerate(groups)])
    f, x, y = F.col("f"), F.col("x"), F.col("y")
    spread = numbered.select("*", F.explode(factors).alias("f")).select(
        "row_no", *weights, f["g"].alias("g"), _linear(x, y, *alone).alias("z"), _linear(x, y, f["a"], f["b"], f["c"]).alias("x"), _linear(x, y, f["d"], f["e"], f["f"]).alias("y")
    )
    each = range(TOGETHER)
    hashed = spread.select(
        "row_no", "g", "z", *weights,
        *[F.floor(_linear(x, y, *inner[j][:3]) * LEVELS).cast("int").alias(f"i{j}") for j in each],
        *[F.floor(_linear(x, y, *inner[j][3:6]) * LEVELS).cast("int").alias(f"h{j}") for j in each],
        *[_linear(x, y, *inner[j][6:]).alias(f"b{j}") for j in each],
    )
    drawn = hashed.select(
        "row_no", "g", "z", *weights, *[f"b{j}" for j in each],
        *[F.get(table, F.col(f"{i}{j}")).alias(f"{name}{j}") for name, table, i in (("r", r_table, "i"), ("q", q_table, "i"), ("c", c_table, "h")) for j in each],
    )

    def sample(w: str, j: int) -> Column:
        b = F.col(f"b{j}")
        t = F.floor(F.col(w) * F.col(f"q{j}") + b)
        size = F.floor((F.col(f"c{j}") - F.col(f"r{j}") * (t - b + 1.0) + FLOOR) * PARTS)
        return size * float(KEPT_BITS) + F.floor(_part(F.col("z") + t * STEP) * float(KEPT))

    first = drawn.select("*", *[sample("w0", j).alias(f"s{j}") for j in each])
    # A word that a further text has as often as the first gives the same sample.
    value = lambda k, j: F.when(F.col("w0") == F.col(f"w{k}"), F.col(f"s{j}")).otherwise(sample(f"w{k}", j)) if k else F.col(f"s{j}")
    least = first.groupBy("row_no", "g").agg(*[F.min(value(k, j)).alias(f"m{k}_{j}") for k in range(len(texts)) for j in each])
    kept = lambda k, j: F.col(f"m{k}_{j}").cast("long") % KEPT_BITS
    part = lambda k: F.concat(*[F.lpad(F.lower(F.hex(kept(k, j))), 4, "0") for j in each])
    none = F.lit("f" * 4 * TOGETHER)
    agree = sum((F.when(kept(0, j).eqNullSafe(kept(1, j)), 1).otherwise(0) for j in each), F.lit(0)) if len(texts) > 1 else F.lit(0)
    whole = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", f"p{k}"))), lambda s: s[f"p{k}"]), "")
    return (
        least.select("row_no", "g", agree.alias("agree"), *[F.coalesce(part(k), none).alias(f"p{k}") for k in range(len(texts))])
        .groupBy("row_no")
        .agg(*[whole(k).alias(t) for k, t in enumerate(texts)], F.sum("agree").alias("same"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of the samples in which two fingerprints agree."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.substr(a, 4 * i + 1, F.lit(4)) == F.substr(b, 4 * i + 1, F.lit(4)))
    return F.size(same) / F.lit(float(SAMPLES))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their place ``n`` from 0 by doc_id, content and row_no: sorted ranges, counted, and the counts added up."""
    order = ["doc_id", "content", "row_no"]
    place = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_.select("*", F.shiftright(place, 33).alias("part"), (place % 2**33).alias("place")), "placed")
    before = F.coalesce(F.expr("sum(rows) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    # One row for each partition of the sort.
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", before.alias("before"))
    return placed.join(F.broadcast(offsets), "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("n"))


def _in_fixed_order(df: DataFrame) -> DataFrame:
    """``df``, written first unless it only reads files, which gives the same rows in the same order each time."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "FileScan" in plan and "Exchange" not in plan and "Join" not in plan else materialize(df, "texts")


def edited_fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited form, which ends with the beginning of the next document.

    Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    df = _in_fixed_order(df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")))
    text = F.col("text")
    row_no = F.monotonically_increasing_id()
    rows = df.select(row_no.alias("row_no"), "text")
    narrow = df.select(row_no.alias("row_no"), "doc_id", F.char_length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("content"))
    placed = materialize(_numbered(materialize(narrow, "rows")), "numbered")
    total = max(1, placed.count())
    before = placed.select(((F.col("n") + 1) % total).alias("n"), F.col("row_no").alias("before_no"), F.floor(F.col("n_chars") / 4).alias("quarter"))
    links = materialize(placed.join(before, "n").select("row_no", "content", "before_no", "quarter"), "links")
    # Row numbers come from reading the table again; were it to come in another order, that is an error, never a wrong result.
    known = rows.join(links, "row_no")
    right = F.when(F.xxhash64("text") == F.col("content"), F.col("before_no")).otherwise(F.raise_error(F.lit("the table's rows changed their order")).cast("long"))
    heads = known.select(right.alias("row_no"), F.substr("text", F.lit(1), F.col("quarter").cast("int")).alias("head"))
    n = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("head"))
    both = rows.join(heads, "row_no").select("row_no", "text", edited.alias("edited"))
    prints = fingerprints(both.withColumnsRenamed({"text": "fingerprint", "edited": "edited_fingerprint"}), ["fingerprint", "edited_fingerprint"])
    digests = both.select("row_no", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    prints = materialize(prints.join(digests, "row_no"), "fingerprints")
    following = prints.select("row_no", F.col("fingerprint").alias("next")).join(links.select("row_no", "before_no"), "row_no").select(F.col("before_no").alias("row_no"), "next")
    return (
        placed.select("row_no", "doc_id", "n_chars")
        .join(prints, "row_no")
        .join(following, "row_no")
        .select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", (F.col("same") / F.lit(float(SAMPLES))).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        )
    )
