"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Patterns yield candidate spans per document. Hashes of the candidates' values are aggregated to
distinct repositories and owners over the whole corpus: a value that many owners hold is a widely
copied example, a value of few owners looks like a live credential. Base spans (assign, access, hex)
are always reported; spans of the further kinds only when their value looks live. Values that hold a
large share of all spans meet their counts without a shuffle.

A span's kind, start and end are code points, end exclusive. The owner is what stands before the
first slash of the repository name.

Defined results: a null text counts as empty; a null repository is a repository and owner of its
own; repeated rows give repeated results; an empty table gives an empty result; other columns play
no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hot_join import join_counted
from tidemark.session import materialize

#: The base kinds, in the order of the report: pattern, value group, least length.
BASE = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What scans for the base kinds: same spans, found without visiting the matches that fail.
FAST = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
#: Public token formats that the method adds.
ADDED = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15),
    "google": (r"AIza[A-Za-z0-9_-]{35,}+", 0, 39),
    "stripe": (r"[sr]k_live_[A-Za-z0-9]{16,}+", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
    "login": (r"[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:([^\s/@:]{3,64})@", 1, 3),
}
KINDS = [*BASE, *ADDED]
#: Distinct owners from which a value counts as widely copied.
MIN_OWNERS = 3

#: Matches of a text that are taken together.
RUN = 256

_SPAN = "array<struct<start:long,rank:int,end:long,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one kind: leftmost matches that don't overlap, less those whose value is too short."""
    pattern, group, least = (BASE | ADDED)[kind]
    pattern = FAST.get(kind, pattern)
    # What lies between the matches and the matches themselves, in turn, add up to positions.
    pieces = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["whole"]), F.lit(0))
        found = F.struct(
            start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("long").alias("end"), x["value"].alias("value")
        )
        return F.struct(
            end.cast("long").alias("pos"),
            F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    # Appending copies the array, so the matches are taken in runs, and the runs' spans put together once.
    empty = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(_SPAN).alias("out"))
    runs = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.size(pieces) - 1) / RUN)), lambda r: F.aggregate(F.slice(pieces, (r * RUN + 1).cast("int"), RUN), empty, step))

    def join(acc, run):
        moved = F.transform(
            run["out"], lambda x: F.struct((x["start"] + acc["pos"]).alias("start"), x["rank"].alias("rank"), (x["end"] + acc["pos"]).alias("end"), x["value"].alias("value"))
        )
        return F.struct((acc["pos"] + run["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(runs, start, join, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(_SPAN))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def candidates(df: DataFrame, text_col: str, id_col: str, repo_col: str) -> DataFrame:
    """doc_id, repo, owner and the sorted candidate spans, values hashed, of each row that has any or none."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    repo = F.coalesce(df[repo_col].cast("string"), F.lit(""))
    spans = F.array_sort(F.concat(*[spans_of(text, kind) for kind in KINDS]))
    hide = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"))
    return df.select(
        df[id_col].alias("doc_id"),
        F.monotonically_increasing_id().alias("row_no"),
        repo.alias("repo"),
        F.split_part(repo, F.lit("/"), F.lit(1)).alias("owner"),
        F.transform(spans, hide).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per hash the number of distinct repositories and owners, and of spans; combined before each shuffle."""
    return (
        found.select(F.explode("spans.hash").alias("hash"), "owner", "repo")
        .groupBy("hash", "owner", "repo")
        .agg(F.count(F.lit(1)).alias("spans"))
        .groupBy("hash", "owner")
        .agg(F.count(F.lit(1)).alias("repos"), F.sum("spans").alias("spans"))
        .groupBy("hash")
        .agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("spans").alias("n_spans"))
    )


def judged(df: DataFrame, text_col: str, id_col: str, repo_col: str, min_owners: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their candidates, and the judged spans of those that have any."""
    found = materialize(candidates(df, text_col, id_col, repo_col), "secret-candidates")
    owned = materialize(ownership(found), "secret-owners")
    single = found.select("row_no", F.explode("spans").alias("span")).select("row_no", "span.*")
    spans = (
        join_counted(single, owned, "hash", "n_spans")
        .select("row_no", F.struct("start", "rank", "end", (F.col("n_owners") >= min_owners).alias("copied")).alias("span"))
    )
    return found, spans


def secret_scan(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", repo_col: str = "source", min_owners: int = MIN_OWNERS
) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, all reported spans, live and copied counts."""
    found, spans = judged(df, text_col, id_col, repo_col, min_owners)
    per_row = spans.groupBy("row_no").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    n_base = len(BASE)
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,copied:boolean>>")
    bare = found.where(F.size("spans") == 0).select("doc_id", empty.alias("spans"))
    rows = found.where(F.size("spans") > 0).select("doc_id", "row_no").join(per_row, "row_no").select("doc_id", "spans").unionByName(bare)
    base = F.filter("spans", lambda x: x["rank"] < n_base)
    told = F.filter("spans", lambda x: (x["rank"] < n_base) | ~x["copied"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == KINDS.index(k))).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(told).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["copied"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: x["copied"])).cast("long").alias("n_copied"),
    )


def redact_live(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    repo_col: str = "source",
    min_owners: int = MIN_OWNERS,
    mark: str = "[secret]",
) -> DataFrame:
    """``df`` with each live-looking span of the text replaced by ``mark``; no row is dropped.

    Widely copied examples stay. Spans that overlap are replaced as one.
    """
    # The row travels as one struct, so that none of its columns can clash with those beside it.
    keyed = df.select(
        F.struct("*").alias("row"),
        df[id_col].alias("id"),
        F.sha2(F.coalesce(df[text_col].cast("string"), F.lit("")), 256).alias("digest"),
        df[text_col].alias("t"),
        df[repo_col].alias("r"),
    )
    # One row per id and text: rows that repeat both have the same spans.
    small = keyed.select(F.struct("id", "digest").alias("key"), "t", "r")
    found, spans = judged(small, "t", "key", "r", min_owners)
    live = (
        spans.where("NOT span.copied")
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_set(F.struct("span.start", "span.end"))).alias("spans"))
        .join(found.where(F.size("spans") > 0).select("row_no", "doc_id"), "row_no")
        .groupBy(F.col("doc_id.id").alias("live_id"), F.col("doc_id.digest").alias("live_digest"))
        .agg(F.first("spans").alias("spans"))
    )
    text = F.col("t")

    def step(acc, x):
        before = F.substring(text, (acc["pos"] + 1).cast("int"), F.greatest(x["start"] - acc["pos"], F.lit(0)).cast("int"))
        put = F.when(x["start"] >= acc["pos"], F.concat(before, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.concat(acc["out"], put).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.lit(2**31 - 1)))
    rewritten = F.when(F.col("spans").isNull(), text).otherwise(F.aggregate("spans", start, step, rest))
    same = F.col("id").eqNullSafe(F.col("live_id")) & (F.col("digest") == F.col("live_digest"))
    joined = keyed.join(materialize(live, "live-secrets"), same, "left").withColumn("rewritten", rewritten)
    return joined.select(*[F.col("rewritten" if c == text_col else f"row.`{c}`").alias(c) for c in df.columns])
