"""Extractive distillation: title, summary, answer, question, keywords, entities, quality, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import STOPWORDS, first_sentence_of_line, let, squeeze, truncate

#: What marks a telling sentence, a definition, a name and a topic. The first letters are looked for first.
_MODAL = r"(?i)(?=[mspre])(?<![A-Za-z0-9_])(must|should|provides|supports|requires|ensures|enables|preserves)(?![A-Za-z0-9_])"
_COPULA = r"(?i)(?=[iam])(?<![A-Za-z0-9_])(is|are|means|includes)(?![A-Za-z0-9_])"
# A run of names may be as long as the text: possessive, each name with its own end, as Java's matcher goes a call deeper for every
# turn of a group that it may have to take back, and such an overflow of the stack ends the executor.
_ENTITY = r"(?<![A-Za-z0-9_])(?:[A-Z][a-z0-9]+(?![A-Za-z0-9_])(?:\s+[A-Z][a-z0-9]+(?![A-Za-z0-9_]))*+|[A-Z]{2,}(?![A-Za-z0-9_])(?:-[A-Z0-9]+(?![A-Za-z0-9_]))*+)"
_TOPIC = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}(?![A-Za-z0-9_])"


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), squeeze), lambda s: s != "")


def title(text: Column, label: Column) -> Column:
    return title_of(first_line(text), first_sentence_of_line(squeeze(text)), label)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, without white space at its ends: what precedes it is white space."""
    return F.regexp_replace(F.regexp_extract(text, r"(?U)^\s*([^\n]*)", 1), r"(?U)\s+$", "")


def title_of(first: Column, sentence: Column, label: Column) -> Column:
    """The title of a text whose first line and first sentence (null if it has none) are known."""

    def of(line: Column) -> Column:
        return (
            F.when(line.startswith("#"), F.trim(F.regexp_replace(line, r"^#+\s*", "")))
            .when((label == "heading") & (line != ""), truncate(line, 96))
            .otherwise(truncate(F.coalesce(sentence, line), 96))
        )

    return let(first, of)


def sentence_score(sentence: Column, index: Column) -> Column:
    n_words = F.octet_length(sentence) - F.octet_length(F.replace(sentence, F.lit(" "), F.lit(""))) + 1
    yes = lambda test, points: F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    return (
        let(n_words, lambda n: F.when((n >= 8) & (n <= 28), 3.0).when(n >= 5, 1.5).otherwise(0.0))
        + yes(sentence.rlike("[A-Z][a-z]"), 0.8)
        + yes(sentence.rlike(_MODAL), 1.5)
        + yes(sentence.rlike(_COPULA), 0.8)
        + yes(sentence.rlike("[:;]"), 0.3)
        - index * F.lit(0.1)
    )


def summary_sentences(parts: Column, most: int = 2) -> Column:
    """The best sentences, in the order of the text. Scores are compared to nine digits."""
    scored = F.transform(parts, lambda s, i: F.struct((-F.round(sentence_score(s, i), 9)).alias("by"), i.alias("at"), s.alias("s")))
    best = F.slice(F.sort_array(scored), 1, most)
    return F.transform(F.sort_array(F.transform(best, lambda x: F.struct(x["at"].alias("at"), x["s"].alias("s")))), lambda x: x["s"])


def summary(text: Column, parts: Column) -> Column:
    return summary_of(text, summary_sentences(parts))


def summary_of(text: Column, best: Column) -> Column:
    """The summary of a text whose best sentences are known."""
    return truncate(let(best, lambda own: F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(text)), 320)


def answer(text: Column, parts: Column) -> Column:
    return answer_of(text, parts, summary_sentences(parts))


def answer_of(text: Column, parts: Column, best: Column) -> Column:
    """The answer of a text whose sentences and best sentences are known."""
    # Of the rest only the first is needed, so that it holds each sentence once is no matter.
    three = let(best, lambda own: F.slice(F.concat(own, F.array_except(parts, own)), 1, 3))
    return truncate(F.when(F.size(parts) > 0, F.array_join(three, " ")).otherwise(text), 480)


def question(of_title: Column, first_keyword: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"[.]+$", "")

    def of(title: Column, name: Column, subject: Column) -> Column:
        return (
            F.when(title.endswith("?"), title)
            .when(name.rlike(r"(?i)^(what|why|how|when|where|who)(?![A-Za-z0-9_])"), F.concat(bare(name), F.lit("?")))
            .when(subject.rlike("(?i)^(overview|summary|introduction|background)$"), F.concat(F.lit("What does "), F.lower(subject), F.lit(" cover?")))
            .otherwise(F.concat(F.lit("What is the key point about "), bare(subject), F.lit("?")))
        )

    subject = lambda name: F.when(name != "", name).otherwise(F.coalesce(first_keyword, F.lit("this section")))
    return let(of_title, lambda t: let(F.trim(t), lambda name: let(subject(name), lambda about: of(t, name, about))))


def keywords(text: Column, most: int = 6) -> Column:
    """The weightiest terms of a text (double weight among the first 24), ties by term.

    Counted within the row, by the runs of the sorted terms, so that no row meets another. The first terms
    stand in the list twice.
    """
    terms = F.regexp_extract_all(F.lower(squeeze(text)), F.lit("[a-z0-9][a-z0-9_-]{2,}"), F.lit(0))

    def best(s: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda p, a, j: F.struct((a - F.coalesce(F.get(p, j + 1), F.size(s))).alias("by"), F.get(s, a).alias("term"))
        found = let(fresh, lambda p: F.slice(F.sort_array(F.transform(p, lambda a, j: run(p, a, j))), 1, most))
        return F.when(F.size(s) > 0, F.transform(found, lambda x: x["term"])).otherwise(F.array().cast("array<string>"))

    twice = lambda t: F.filter(F.concat(t, F.slice(t, 1, 24)), lambda w: ~w.isin(STOPWORDS))
    return let(terms, lambda t: let(F.sort_array(twice(t)), best))


def entities(text: Column, most: int = 6) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), lambda s: F.char_length(s) >= 2)
    return F.slice(F.array_distinct(found), 1, most)


def themes(of_title: Column, text: Column, terms: Column, names: Column, most: int = 8) -> Column:
    long = lambda a: F.filter(a, lambda s: F.char_length(s) >= 4)
    topics = F.transform(F.regexp_extract_all(text, F.lit(_TOPIC), F.lit(0)), lambda s: F.lower(squeeze(s)))
    named = F.transform(names, lambda s: F.lower(squeeze(s)))
    every = F.concat(long(F.array(F.lower(squeeze(of_title)))), long(topics), named, long(terms))
    return F.slice(F.array_except(F.array_distinct(every), F.array(*[F.lit(s) for s in STOPWORDS])), 1, most)


#: Characters of a text that are looked at first, where a few terms are enough.
_HEAD = 512


def n_keywords(text: Column, enough: int = 4) -> Column:
    """The number of different terms that ``keywords`` chooses from, exact below ``enough``.

    The whole text is read only if its head holds no more than ``enough`` terms, one of which may be cut.
    """

    def count(t: Column) -> Column:
        terms = F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9][a-z0-9_-]{2,}"), F.lit(0))
        return F.size(F.array_except(terms, F.array(*[F.lit(w) for w in STOPWORDS])))

    return F.when(count(F.substring(text, 1, _HEAD)) > enough, enough).otherwise(count(text))


def has_entities(text: Column) -> Column:
    """Whether ``entities`` finds any: every match has two characters at least."""
    return text.rlike(_ENTITY)


def mean_words(flat: Column, n: Column) -> Column:
    """Words of each of the ``n`` sentences: a sentence's are one more than its spaces, and one space parts two sentences."""
    spaces = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(n == 0, 0.0).otherwise((spaces + 1) / n)


def repeated_lines(text: Column) -> Column:
    own = lines(text)
    return F.size(F.array_distinct(own)) < F.size(own)


def noisy(flat: Column) -> Column:
    runs = F.regexp_count(flat, F.lit(r"[^\w\s]{3,}"))
    digits = F.octet_length(flat) - F.octet_length(F.regexp_replace(flat, "[0-9]+", ""))
    return (runs > 1) | ((F.char_length(flat) > 0) & (digits / F.char_length(flat) > 0.2))


def mostly_uppercase(flat: Column) -> Column:
    words = F.regexp_count(flat, F.lit("[A-Za-z]{3,}"))
    upper = F.regexp_count(flat, F.lit("(?=[A-Z])(?<![A-Za-z])[A-Z]{3,}+(?![a-z])"))  # whole runs of letters
    return (words > 0) & (upper / words > 0.4)


def quality(text: Column, flat: Column, n: Column, mean: Column, label: Column, terms: Column, named: Column) -> dict[str, Column]:
    """From a text, the same in single spaces, its sentences and their mean words, its terms, and whether it names entities: coverage, density, structure, noise penalty and confidence in hundredths, and the flags.

    All are whole hundredths, so confidence is computed in whole ten-thousandths and rounded half up.
    """
    length = F.char_length(flat)
    coverage = F.when((length >= 120) & (length <= 2200), 82).when(length >= 60, 68).otherwise(48)
    density = (
        F.lit(42)
        + F.when(terms >= 4, 24).when(terms >= 2, 14).otherwise(0)
        + F.when(named, 10).otherwise(0)
        + F.when(n >= 2, 10).when(n == 1, 4).otherwise(0)
    )
    structure = (
        F.lit(48) + F.when(label.isin("heading", "paragraph"), 24).otherwise(12) + F.when(n >= 2, 14).otherwise(0) + F.when(mean >= 24, 8).otherwise(0)
    )
    tests = {
        "repeated_lines": (repeated_lines(text), 12),
        "noisy_content": (noisy(flat), 10),
        "uppercase_heavy": (mostly_uppercase(flat), 8),
        "low_information_density": ((n > 0) & (mean < 24), 5),
    }
    noise, flags = F.lit(0), []
    for name, (test, points) in tests.items():
        noise = noise + F.when(test, points).otherwise(0)
        flags.append(F.when(test, F.lit(name)))
    exact = F.lit(2800) + 25 * coverage + 24 * F.least(density, F.lit(100)) + 23 * F.least(structure, F.lit(100)) - 100 * noise
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), F.floor((exact + 50) / 100)))
    return {
        "coverage": coverage,
        "density": F.least(density, F.lit(100)),
        "structure": F.least(structure, F.lit(100)),
        "noise_penalty": noise,
        "confidence": confidence,
        "flags": F.concat_ws(",", *flags),
    }
