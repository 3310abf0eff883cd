"""BPE encoding and decoding by dynamic programming over prefixes.

For byte-pair encodings, the last token of each prefix of a piece is unique: it is the one token
that ends there and may stand after the last token of what comes before it. An automaton over the
vocabulary, whose suffix links lead from each matched string to its longest suffixes, lists the
tokens that end at a position; the test of a pair asks whether the two tokens stay apart when their
characters are merged anew. The back-pointers of the whole piece then give the exact ids.

Defined results: a null text counts as empty and has no ids; special tokens written out in a text
are those tokens; other columns play no part; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.chunk_table import ChunkTable, portions
from tidemark.llm.vocabulary import TokenizerFile
from tidemark.llm.worker import PAIR_BYTES, held, releasing

#: Pair tests and pieces that a worker keeps from task to task, each of them, and bytes of chunks. Learning them anew
#: in each task would take more CPU time than the encoding itself.
REMEMBER, CHUNK_BYTES = 400_000, 80_000_000

_ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\x09-\x0d\x20]+")


class SuffixAutomaton:
    """States are the prefixes of tokens; ``tokens[state]`` are those that end there, longest first."""

    def __init__(self, words: dict[tuple[str, ...], int]):
        self.next: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]
        for symbols, token in words.items():
            state = 0
            for s in symbols:
                to = self.next[state].get(s)
                if to is None:
                    to = self.next[state][s] = len(self.next)
                    self.next.append({})
                    ends.append(None)
                state = to
            ends[state] = (token, len(symbols))
        self.link = [0] * len(self.next)
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        queue = list(self.next[0].values())
        for state in queue:
            own = ends[state]
            self.tokens[state] = ((own,) if own else ()) + self.tokens[self.link[state]]
            for s, to in self.next[state].items():
                back = self.link[state]
                while back and s not in self.next[back]:
                    back = self.link[back]
                self.link[to] = self.next[back].get(s, 0)
                queue.append(to)

    def step(self, state: int, symbol: str) -> int:
        while True:
            to = self.next[state].get(symbol)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.link[state]


class PrefixBpe:
    def __init__(self, file: TokenizerFile):
        self.file = file
        self._symbols = {i: self._cut(t) for t, i in file.vocab.items()}
        self._automaton = SuffixAutomaton({s: i for i, s in self._symbols.items()})
        self._apart: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def _cut(self, token: str) -> tuple[str, ...]:
        """Characters, the word end being part of the last."""
        end = self.file.end
        if end and token.endswith(end) and len(token) > len(end):
            body = token[: -len(end)]
            return (*body[:-1], body[-1] + end)
        return tuple(token)

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """What the merges make of these symbols: lowest rank first, then leftmost."""
        parts, ranks = list(symbols), self.file.ranks
        while len(parts) > 1:
            best = min(((ranks.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged anew, come out as they are; left -1 is the start."""
        known = self._apart.get((left, right))
        if known is None:
            tokens = [right] if left < 0 else [left, right]
            symbols = sum((self._symbols[t] for t in tokens), ())
            known = self.merged(symbols) == [self.file.names[t] for t in tokens]
            if len(self._apart) < REMEMBER:
                self._apart[left, right] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        known = self._pieces.get(piece)
        if known is not None:
            return known
        symbols = [*piece[:-1], piece[-1] + self.file.end]
        last, back, state = [-1], [0], 0
        for i, s in enumerate(symbols, 1):
            state = self._automaton.step(state, s)
            for token, length in self._automaton.tokens[state]:
                if self.may_follow(last[i - length], token):
                    last.append(token)
                    back.append(i - length)
                    break
            else:
                raise ValueError("the vocabulary doesn't cover this text")
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        if len(self._pieces) < REMEMBER and len(piece) < 100:
            self._pieces[piece] = ids
        return ids

    def encode_chunk(self, chunk: bytes) -> list[int]:
        if chunk.isascii() and b"<|" not in chunk:
            alphabet = self.file.alphabet
            pieces = ["".join([alphabet[b] for b in p]) for p in _ASCII_PIECE.findall(chunk.lower())]
        else:
            pieces = self.file.pieces(chunk.decode("utf-8", "replace"))
        return [i for p in pieces for i in (self.encode_piece(p) if isinstance(p, str) else [p])]

    def encode_chunks(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Per chunk its ids, little-endian, and its decoded text."""
        return [(struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode()) for ids in map(self.encode_chunk, chunks)]

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between; special tokens are kept."""
        names = self.file.names
        return " ".join([names[i] for i in ids])




def _table(path: str) -> ChunkTable:
    loaded = held("bpe")
    if path not in loaded:
        size = lambda both: PAIR_BYTES // 2 + len(both[0]) + len(both[1])
        loaded[path] = ChunkTable(PrefixBpe(TokenizerFile(path)).encode_chunks, size, CHUNK_BYTES)
    return loaded[path]


def encode_text(path: str, text: str) -> tuple[bytes, str]:
    """Ids, little-endian, and decoded text of one text."""
    values = _table(path).look_up([text.encode()])[0]
    return b"".join([v[0] for v in values]), b" ".join([v[1] for v in values if v[1]]).decode()


_OUT = "n_tokens long, ids binary, decoded string"


def _encoder(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for start, some in portions(texts):
                counts, ids, decoded = [], [], []
                for values in table.look_up(some):
                    id_bytes = b"".join([v[0] for v in values])
                    text = b" ".join([v[1] for v in values if v[1]])
                    counts.append(len(id_bytes) // 4)
                    ids.append(hashlib.sha256(id_bytes).hexdigest() if digests else id_bytes)
                    decoded.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                yield pa.record_batch(
                    [
                        batch.column(0).slice(start, len(some)),
                        pa.array(counts, pa.int64()),
                        pa.array(ids, pa.string() if digests else pa.binary()),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"],
                )

    return releasing(run, "bpe")


def encode_decode(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids (binary) and decoded (string), or the digests of both."""
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else _OUT
    kind = df.select(df[id_col].alias("doc_id")).schema[0].dataType.simpleString()
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(
        _encoder(path, digests), f"doc_id {kind}, {out}"
    )
