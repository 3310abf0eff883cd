"""A worker's table of white-space-delimited chunks and what they encode to.

White space (bytes 9-13 and 32) always ends a piece of the vocabularies used here, so a text encodes
to the concatenation of what its chunks encode to. ASCII letters may be lowered first, because the
normalizer lowers them anyway, unless the text might hold a special token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from tidemark.llm.worker import PAIR_BYTES


class ChunkTable:
    """Remembers chunks up to ``budget`` bytes; further ones are encoded whenever they are met."""

    def __init__(self, encode: Callable[[list[bytes]], list], size: Callable[[object], int] = len, budget: int = 40_000_000):
        self._encode, self._size, self._known, self._left = encode, size, {}, budget

    def look_up(self, texts: list[bytes]) -> list[list]:
        """Per text the values of its chunks, in order."""
        known, out, waiting, missing = self._known, [], [], set()
        for i, text in enumerate(texts):
            chunks = (text if b"<|" in text else text.lower()).split()
            values = list(map(known.get, chunks))
            if None in values:
                waiting.append((i, chunks))
                missing.update(chunks)
            out.append(values)
        if missing:
            fresh = list(missing.difference(known))
            made = dict(zip(fresh, self._encode(fresh), strict=True))
            known.update(made)
            for i, chunks in waiting:
                out[i] = list(map(known.get, chunks))
            for chunk, value in made.items():
                if self._left > 0:
                    self._left -= PAIR_BYTES + len(chunk) + self._size(value)
                else:
                    del known[chunk]
        return out


def portions(texts: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes, with the place of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
