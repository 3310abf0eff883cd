"""Licence scanning by sparse TF-IDF cosine to templates, with inheritance along directories.

In DataFrame functions only. Notices are hard-wrapped as a rule, so comment marks are taken off and
lines joined: lines, sentences, paragraphs and comment blocks that speak of licensing are candidates, and
so is the whole text. A file whose name says so, most of whose text is such notices, or whose whole text
is like a full licence, is a licence file. Candidates are compared with the templates as sparse TF-IDF
vectors (1 + log of the count, so that a long text's common words do not outweigh its terms): term
counts join the templates' terms, a bounded table that is broadcast. A row whose best cosine reaches
``threshold`` has a licence of its own. The licence files'
findings hold for their directory; all other rows take the licence of the nearest ancestor directory
that has one, by a join of the distinct directories' ancestors with the licensed directories. Directories
of a large share of the rows, and ancestors of a large share of the directories, are joined without a shuffle.

Defined results: a null text counts as empty; a null path is a file in the root directory; equal
cosines go to the licence that comes first in the alphabet; of several licence files in a directory
the highest cosine counts, then the first licence; repeated rows give repeated results; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from math import log, sqrt
from re import findall

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hot_join import join_counted
from tidemark.llm.license_templates import FULL_TEXTS, TEMPLATES
from tidemark.session import materialize

THRESHOLD = 0.7
#: Share of a text that its notices make up in a licence file.
FILE_SHARE = 0.6

_CUE = r"(?i)licen[cs]e|copyright|redistribution|permission\s+(?:is\s+hereby|to\s+use)|public\s+domain|free\s+software|creative\s+commons|\bcc[ -]by\b|\bcc0\b|\b[al]?gpl\b"
#: In "this work is released under ..." the licence is told from here on.
_UNDER = r"(?i)(?:licen[cs]ed|released|distributed|available|published|provided)\s+(under\s.*)"
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"


#: What opens or closes a comment, and what begins a line of one.
_FENCE = r"/\*+!?|\*+/|<!--|-->|\"{3}|'{3}|\(\*|\*\)|\{-|-\}"
_MARK = r"(?md)^[ \t]*(?:(?://+!?|#+!?|\*+|;+|--+|%+|!+|dnl\b|REM\b|\.\.)[ \t]*)(.*)$"


def _candidates(text: Column) -> Column:
    """The parts of a text that may be notices, each once: all of it, then its lines, paragraphs, comment blocks and sentences."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    # Each line of a comment stands between \u0001, each other line between \u0002.
    marked = F.regexp_replace(F.regexp_replace(text, _FENCE, "\n\n"), _MARK, "\u0001$1\u0001")
    marked = F.regexp_replace(marked, r"(?md)^([^\u0001\n].*)$", "\u0002$1\u0002")
    plain = lambda part: F.trim(F.regexp_replace(part, r"[\u0001\u0002\s]+", " "))
    gap, turn = r"\n[\u0001\u0002 \t]*\n", r"\u0001\n\u0002|\u0002\n\u0001"
    parts = F.concat(
        F.split(marked, f"{gap}"),  # paragraphs, of comments and other lines alike
        F.split(marked, f"{gap}|{turn}"),  # paragraphs of comments
        F.split(marked, f"\n\n+|{turn}"),  # whole comments of marked lines
        F.slice(F.split(text, r"\*/|-->|\"{3}|'{3}"), 1, 1),  # a leading comment between fences
    )
    joined = F.transform(F.filter(parts, lambda part: part.rlike(_CUE)), plain)
    sentences = F.flatten(F.transform(joined, lambda part: F.split(part, r"(?<=[.!?])[ \t]+")))
    lines = F.transform(F.split(text, r"\n+|(?<=[.!?])[ \t]+"), plain)
    spoken = F.filter(F.concat(lines, joined, sentences), lambda part: part.rlike(_CUE))
    named = F.filter(F.transform(spoken, lambda part: F.regexp_extract(part, _UNDER, 1)), lambda part: part != "")
    return F.array_distinct(F.concat(F.array(plain(marked)), spoken, named))


def template_terms() -> tuple[list[tuple[int, str, float]], list[tuple[int, str]], dict[str, float], float]:
    """Unit TF-IDF weights (template, term, weight), template licences, idf of each term, idf of other terms."""
    texts = [(name, t) for name, own in sorted(TEMPLATES.items()) for t in own]
    counts = [Counter(findall(_TERM, t.lower())) for _, t in texts]
    df = Counter(term for c in counts for term in c)
    idf = {term: 1 + log((1 + len(texts)) / (1 + n)) for term, n in df.items()}
    weights = []
    for i, c in enumerate(counts):
        own = {t: (1 + log(n)) * idf[t] for t, n in sorted(c.items())}
        norm = sqrt(sum(w * w for w in own.values()))
        weights += [(i, t, w / norm) for t, w in own.items()]
    return weights, [(i, name) for i, (name, _) in enumerate(texts)], idf, 1 + log(1 + len(texts))


def _own_licenses(rows: DataFrame, threshold: float) -> DataFrame:
    """row_no, license, score, and share of the text in notices, of the rows with a notice."""
    spark = rows.sparkSession
    weights, names, idf, other = template_terms()
    terms = F.broadcast(spark.createDataFrame(weights, "template int, term string, weight double"))
    full = [text == FULL_TEXTS.get(name) for name, own in sorted(TEMPLATES.items()) for text in own]
    named = F.broadcast(spark.createDataFrame([(*named, of) for named, of in zip(names, full, strict=True)], "template int, license string, full boolean"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    # Lines and sentences as they stand, which do not overlap, tell the share of the text in notices.
    own_lines = F.filter(F.split("text", r"\n+|(?<=[.!?])[ \t]+"), lambda line: line.rlike(_CUE))
    spoken = F.aggregate(own_lines, F.lit(0), lambda sum_, line: sum_ + F.char_length(line))
    notices = rows.where(F.col("text").rlike(_CUE)).select(
        "row_no", (spoken / F.char_length("text")).alias("share"), F.posexplode(_candidates(F.col("text"))).alias("part", "notice")
    )
    notices = materialize(notices, "license-notices")
    counts = (
        notices.select("row_no", "part", F.explode(F.regexp_extract_all(F.lower("notice"), F.lit(_TERM), F.lit(0))).alias("term"))
        .groupBy("row_no", "part", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    weighed = counts.join(known, "term", "left").select(
        "row_no", "part", "term", ((1 + F.log("n")) * F.coalesce("idf", F.lit(other))).alias("w")
    )
    # One pass gives the norm and the sums with every template: the terms come as one array per term.
    vectors = terms.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("template", "weight"))).alias("weights"))
    norms = weighed.groupBy("row_no", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        weighed.join(F.broadcast(vectors), "term")
        .select("row_no", "part", "w", F.explode("weights").alias("template", "weight"))
        .groupBy("row_no", "part", "template")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    )
    scored = dots.join(norms, ["row_no", "part"]).join(named, "template").select(
        "row_no", "part", "license", "full", F.round(F.col("dot") / F.col("norm"), 9).alias("score")
    )
    # Part 0 is the whole text; it alone can make its row a full licence.
    share = notices.where("part = 0").select("row_no", "share")
    best = (
        scored.where(F.col("score") >= threshold)
        .join(share, "row_no")
        .groupBy("row_no")
        .agg(
            F.min(F.struct(-F.col("score"), "license")).alias("best"),
            F.first("share").alias("share"),
            F.max(F.col("full") & (F.col("part") == 0)).alias("whole"),
        )
    )
    return best.select(
        "row_no", F.col("best.license").alias("license"), (-F.col("best.col1")).alias("score"), F.when(F.col("whole"), 1.0).otherwise(F.col("share")).alias("share")
    )


def license_scan(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    path_col: str = "path",
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """Per row: doc_id, license, origin (header, file, inherited or null), score, from_dir."""
    path = F.coalesce(df[path_col].cast("string"), F.lit(""))
    rows = df.select(
        df[id_col].alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
        path.alias("path"),
        F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    keys = materialize(rows.select("row_no", "doc_id", "path", "dir", F.when(F.col("text").rlike(_CUE), F.col("text")).alias("text")), "license-rows")
    own = materialize(
        _own_licenses(keys.where("text IS NOT NULL").select("row_no", "text"), threshold), "own-licenses"
    )
    rows = keys.select("row_no", "doc_id", "path", "dir").join(own, "row_no", "left")
    is_file = F.col("license").isNotNull() & (F.col("path").rlike(_FILE_NAME) | (F.col("share") >= file_share))
    rows = materialize(rows.withColumn("is_file", is_file), "licensed-rows")
    licensed = rows.where("is_file").groupBy("dir").agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    licensed = licensed.select(F.col("dir").alias("from_dir"), F.col("best.license").alias("dir_license"))
    # Ancestors of each distinct directory, itself and the root included.
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    bare = rows.where("license IS NULL")
    dirs = materialize(bare.groupBy("dir").agg(F.count(F.lit(1)).alias("n_rows")), "directories")
    # The root is an ancestor of every directory, so ancestors are counted and joined as hot keys are.
    climbed = dirs.select("dir", F.explode(F.array_distinct(up)).alias("from_dir"))
    counted = climbed.groupBy("from_dir").agg(F.count(F.lit(1)).alias("n_dirs")).join(licensed, "from_dir", "left")
    found = (
        join_counted(climbed, materialize(counted, "ancestors"), "from_dir", "n_dirs")
        .where("dir_license IS NOT NULL")
        .groupBy("dir")
        .agg(F.max_by(F.struct("from_dir", "dir_license"), F.char_length("from_dir")).alias("near"))
    )
    # Every directory is in the table, so that a hot one without a licence needs no shuffle either.
    nearest = materialize(dirs.join(found, "dir", "left"), "inherited")
    bare = (
        join_counted(bare, nearest, "dir", "n_rows")
        .select(
            "doc_id",
            F.col("near.dir_license").alias("license"),
            F.when(F.col("near").isNotNull(), "inherited").alias("origin"),
            F.lit(None).cast("double").alias("score"),
            F.col("near.from_dir").alias("from_dir"),
        )
    )
    told = rows.where("license IS NOT NULL").select(
        "doc_id", "license", F.when(F.col("is_file"), "file").otherwise("header").alias("origin"), "score", F.lit(None).cast("string").alias("from_dir")
    )
    return told.unionByName(bare)
