"""Reading a tokenizer file: vocabulary, merges, and the rules that cut a text into pieces.

Only the parts that the files of the ``tokenizers`` library with byte-level BPE and word ends use are
understood: the normalizers NFC, Replace and Lowercase, and one splitting pattern. Anything else
raises, so that no file is read wrongly.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class TokenizerFile:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only plain BPE files without a decoder are understood")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self._steps = []
        for step in self._sequence(spec["normalizer"], "normalizers"):
            if step["type"] == "NFC":
                self._steps.append(lambda s: unicodedata.normalize("NFC", s))
            elif step["type"] == "Lowercase":
                self._steps.append(lambda s: s.lower() if s.isascii() else "".join(c.lower() for c in s))
            elif step["type"] == "Replace":
                pattern = regex.compile(step["pattern"]["Regex"])
                self._steps.append(lambda s, p=pattern, put=step["content"]: p.sub(lambda _: put, s))
            else:
                raise ValueError(f"normalizer {step['type']} is not understood")
        split, *others = self._sequence(spec["pre_tokenizer"], "pretokenizers")
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or [o["type"] for o in others] != ["ByteLevel"]:
            raise ValueError("this way of splitting is not understood")
        self._pattern = regex.compile(split["pattern"]["Regex"])
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _sequence(step: dict | None, name: str) -> list[dict]:
        return [] if step is None else step[name] if step["type"] == "Sequence" else [step]

    def pieces(self, text: str) -> list[str | int]:
        """The pieces of a text in the byte alphabet; a special token stands as its id."""
        out: list[str | int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for step in self._steps:
                part = step(part)
            for piece in self._pattern.findall(part):
                out.append("".join([self.alphabet[b] for b in piece.encode()]))
        return out
