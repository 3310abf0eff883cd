"""Language identification by unigram pieces, all segmentations of a word being summed.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; a
word's probability in a language is the sum, over all ways to segment the word into pieces, of the
product of their probabilities, by a forward algorithm over the word's bytes. The piece probabilities
are fitted by expectation maximisation (forward-backward counts) on a bounded sample of labelled
rows. A text's score is the sum over its words; prediction takes equal priors.

Words are runs of letters and their marks, lower-cased, of any length. Sums over long words are scaled as
they go, so that none vanishes. For the fit alone, words beyond ``FIT_BYTES`` are cut to that length, and
each language learns from its ``MOST_WORDS`` most frequent words of the sample.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is any text when no
language was learned; ties go to the language that comes first in the alphabet; labels that are null
are not learned; repeated rows give repeated results; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vocabulary import byte_alphabet
from tidemark.llm.wordhash import powers
from tidemark.llm.worker import releasing

#: Training rows per language, those whose hash is smallest, and words per language. They bound the fit at any corpus size.
SAMPLE_PER_LANGUAGE, MOST_WORDS = 400, 30_000
#: Groups in which a frequent language's rows or words are thinned out, level by level.
THIN = (64, 8, 1)
#: Rounds of expectation maximisation, and the count that every piece is given beforehand.
ROUNDS, SMOOTHING = 3, 0.05
#: Words up to here are summed without scaling, and are not cut by the fit.
FIT_BYTES = 40

_STEP = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces as bytes; a zero byte marks the end of a word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, back = model.get("end_of_word_suffix") or "", {c: b for b, c in enumerate(byte_alphabet())}
    out = []
    for token in model["vocab"]:
        closed = bool(end) and token.endswith(end) and len(token) > len(end)
        body = token[: -len(end)] if closed else token
        out.append(bytes(back[c] for c in body) + b"\x00" * closed)
    return out


def _hash_rows(cells: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash, one row per word."""
    up, _ = powers(_STEP, cells.shape[1])
    sums = np.zeros((len(cells), cells.shape[1] + 1), np.uint64)
    np.cumsum(_BYTES[cells] * up[: cells.shape[1]], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums


@dataclass
class Pieces:
    hashes: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        """Piece i is the one with the i-th smallest hash."""
        own = [int(_hash_rows(np.frombuffer(p, np.uint8)[None])[0, -1]) for p in pieces]
        return cls(np.unique(np.array(own, np.uint64)), np.unique(list(map(len, pieces))))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the piece with each hash, and whether there is one."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def spans(self, cells: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length (end mark included): start, end, the rows with a piece there, its number."""
        sums, width = _hash_rows(cells), cells.shape[1]
        back = powers(_STEP, width + 1)[1]
        for j in range(1, width + 1):
            for i in (j - self.lengths[self.lengths <= j]).tolist():
                at, hit = self.find((sums[:, j] - sums[:, i]) * back[i])
                rows = np.flatnonzero(hit)
                if len(rows):
                    yield i, j, rows, at[rows]


def _cells(words: list[bytes], width: int) -> np.ndarray:
    """Byte matrix of the words, filled up with zero bytes, the first of which is the end mark."""
    return np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and byte matrix, end mark included, of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for some in np.array_split(at, -(-len(at) // 20_000)):
            yield some, _cells([words[i] for i in some], int(n) + 1)


def _long_scores(words: list[bytes], pieces: Pieces, prob: np.ndarray, cells_at_once: int = 1_000_000) -> np.ndarray:
    """``word_scores`` of long words: those of like length go together, and the sums are scaled every 16 bytes."""
    out = np.zeros((len(words), prob.shape[1]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    like = np.frexp(sizes.astype(float))[1]
    reach = int(pieces.lengths[-1])
    for kind in np.unique(like):
        every = np.flatnonzero(like == kind)
        for at in np.array_split(every, -(-len(every) * int(sizes[every].max()) // cells_at_once)):
            if not len(at):
                continue
            width, n = int(sizes[at].max()), len(at)
            sums = _hash_rows(_cells([words[i] for i in at], width))
            back = powers(_STEP, width + 1)[1]
            forward, scale = np.zeros((reach + 1, n, prob.shape[1])), np.zeros((n, prob.shape[1]))
            forward[0] = 1
            steps = max(1, 20_000 // (n * len(pieces.lengths)))
            for first in range(1, width + 1, steps):
                ends = np.arange(first, min(first + steps, width + 1))
                starts = ends[:, None] - pieces.lengths
                inside = starts >= 0
                starts = np.maximum(starts, 0)
                piece, hit = pieces.find((sums[:, ends].T[:, None] - sums[:, starts].transpose(1, 2, 0)) * back[starts][:, :, None])
                share = prob[piece] * (hit & inside[:, :, None])[..., None]
                for k, j in enumerate(ends.tolist()):
                    now = (forward[starts[k] % (reach + 1)] * share[k]).sum(axis=0)
                    forward[j % (reach + 1)] = now
                    done = np.flatnonzero(sizes[at] == j)
                    if len(done):
                        out[at[done]] = scale[done] + np.log(np.maximum(now[done], 1e-300))
                    if j % 16 == 0:
                        top = forward.max(axis=0)
                        top[top == 0] = 1
                        forward /= top
                        scale += np.log(top)
    return out


def word_scores(words: list[bytes], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """log P(word | language), one row per word; the forward sums."""
    out = np.zeros((len(words), prob.shape[1]))
    long = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > FIT_BYTES)
    if len(long):
        out[long] = _long_scores([words[i] for i in long], pieces, prob)
        short = np.setdiff1d(np.arange(len(words)), long)
        words = [words[i] for i in short]
    else:
        short = np.arange(len(words))
    for at, cells in by_length(words):
        forward = np.zeros((cells.shape[1] + 1, len(at), prob.shape[1]))
        forward[0] = 1
        for i, j, rows, piece in pieces.spans(cells):
            forward[j, rows] += forward[i, rows] * prob[piece]
        out[short[at]] = np.log(np.maximum(forward[-1], 1e-300))
    return out


def fit(counts: dict[bytes, np.ndarray], n_languages: int, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities per language from word counts, by forward-backward expectations."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words]).reshape(len(words), n_languages)
    prob = np.full((len(pieces.hashes), n_languages), 1.0 / len(pieces.hashes))
    groups = [(at, cells, list(pieces.spans(cells))) for at, cells in by_length(words)]
    for _ in range(rounds):
        expected = np.full(prob.shape, SMOOTHING)
        for at, cells, spans in groups:
            width = cells.shape[1]
            forward = np.zeros((width + 1, len(at), n_languages))
            backward = np.zeros_like(forward)
            forward[0], backward[width] = 1, 1
            for i, j, rows, piece in spans:
                forward[j, rows] += forward[i, rows] * prob[piece]
            for i, j, rows, piece in sorted(spans, key=lambda s: -s[1]):
                backward[i, rows] += backward[j, rows] * prob[piece]
            scale = weight[at] / np.maximum(forward[width], 1e-300)
            for i, j, rows, piece in spans:
                np.add.at(expected, piece, forward[i, rows] * prob[piece] * backward[j, rows] * scale[rows])
        prob = expected / expected.sum(axis=0)
    return prob


def _kinds_of_characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and whether it is a letter or a mark."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


_KINDS: list[tuple[np.ndarray, np.ndarray]] = []


def _in_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of UTF-8 whether its character is a letter, and whether it belongs to a word."""
    letter = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    word = letter.copy()
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        if not _KINDS:
            _KINDS.append(_kinds_of_characters())
        more = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int64) & (0x3F >> more)
        for k in (1, 2, 3):
            own = np.flatnonzero(more >= k)
            code[own] = (code[own] << 6) | (data[lead[own] + k] & 0x3F)
        for of, table in zip((letter, word), _KINDS[0], strict=True):
            yes = table[code]
            for k in range(4):
                own = more >= k
                of[lead[own] + k] = yes[own]
    return letter, word


def _letter_runs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lowered texts, per word its start, end and row, and per row whether it has a letter."""
    lowered = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter, word = np.zeros(len(data), bool), np.zeros(len(data) + 2, bool)
    letter[:], word[1:-1] = _in_words(data)
    before = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    seen = before[offsets[1:]] > before[offsets[:-1]]
    step = word[1:] != word[:-1]
    starts, ends = np.flatnonzero(step & word[1:]), np.flatnonzero(step & word[:-1])
    # A run never joins two rows: rows are cut where they meet.
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    cut = np.unique(cut[word[cut] & word[cut + 1]])
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, seen


def distinct_runs(text: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a batch, per occurrence its word and row, and per row whether it has a letter."""
    data, starts, ends, rows, seen = _letter_runs(text)
    if not len(starts):
        return [], np.zeros(0, np.int64), rows, seen
    hashes = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 200_000):  # in blocks, so that the sums stay in the cache
        s, e = starts[at : at + 200_000], ends[at : at + 200_000]
        block = data[s[0] : e[-1]]
        sums = np.zeros(len(block) + 1, np.uint64)
        up, back = powers(_STEP, len(block) + 1)
        np.cumsum(_BYTES[block] * up[: len(block)], out=sums[1:])
        hashes[at : at + 200_000] = (sums[e - s[0]] - sums[s - s[0]]) * back[s - s[0]]
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    body = data.tobytes()
    return [body[starts[i] : ends[i]] for i in first], word, rows, seen


def _slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(batch):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 0):
            words, word, rows, _ = distinct_runs(part.column("text"))
            labels = pc.dictionary_encode(part.column("lang"))
            codes = labels.indices.to_numpy(zero_copy_only=False)
            both, n = np.unique(codes[rows] * max(1, len(words)) + word, return_counts=True)
            lang = labels.dictionary.take(pa.array(both // max(1, len(words)), pa.int64()))
            text = pa.array([words[i][:FIT_BYTES] for i in both % max(1, len(words))], pa.binary())
            yield pa.record_batch([lang, text, pa.array(n, pa.int64())], names=["lang", "word", "n"])


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    prob: np.ndarray


def _first_per_language(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first rows of each language; a frequent one is thinned out in groups before it meets in one."""
    key = F.xxhash64(*order)
    for groups in THIN:
        own = Window.partitionBy("lang", F.pmod(key, F.lit(groups))).orderBy(*order)
        rows = rows.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= most).drop("__n")
    return rows


def train(labelled: DataFrame, path: str, per_language: int = SAMPLE_PER_LANGUAGE, most_words: int = MOST_WORDS) -> LanguageModel:
    """Fit on ``per_language`` rows and ``most_words`` words of each label of (doc_id, text, lang)."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = _first_per_language(rows.select("doc_id", "lang"), per_language, F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"))
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # bounded by per_language
    counted = (
        sample.select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(releasing(_count_words), "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    found = _first_per_language(counted, most_words, -F.col("n"), F.col("word")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    place = {lang: i for i, lang in enumerate(languages)}
    counts: dict[bytes, np.ndarray] = {}
    for lang, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(word, np.zeros(len(languages)))[place[lang]] += n
    pieces = Pieces.of(read_pieces(path))
    return LanguageModel(languages, pieces, fit(counts, len(languages), pieces) if languages else np.zeros((len(pieces.hashes), 0)))


def predict(model: LanguageModel, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of its language, -1 for ``und``, and the score."""
    words, word, rows, seen = distinct_runs(text)
    total = np.zeros((len(text), len(model.languages)))
    if model.languages and words:
        scores = word_scores(words, model.pieces, model.prob)
        for lang in range(len(model.languages)):
            total[:, lang] = np.bincount(rows, scores[word, lang], len(text))
    pick, score = np.full(len(text), -1), np.zeros(len(text))
    if model.languages:
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        pick[seen] = total.argmax(axis=1)[seen]
        score[seen] = share.max(axis=1)[seen]
    return pick, score


def _identify(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, "und"])
        for batch in batches:
            for part in _slices(batch, 1):
                pick, score = predict(model, part.column(1))
                yield pa.record_batch(
                    [part.column(0), part.column(2), names.take(pa.array(pick % len(names))), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return releasing(run)


def identify(df: DataFrame, model: LanguageModel, held_out=None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    rows = df.select(
        df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out")
    )
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_identify(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a language, with their columns.

    If the model has learned no language, as from a table without labels, these are the texts with a letter.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                text = part.column(at)
                keep = predict(model, text)[0] >= 0 if model.languages else _letter_runs(text)[-1]
                yield part.filter(pa.array(keep))

    return df.mapInArrow(releasing(run), df.schema)
