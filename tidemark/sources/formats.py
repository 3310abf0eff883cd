"""Extractors of RTF, YAML, office files and mail: plain functions from a file's bytes to text.

They run inside the Arrow function of ``extract``, one file a call, where an error becomes the row's error.
"""

from __future__ import annotations

import codecs
import email
import email.policy
import io
import re
import zipfile
from xml.etree import ElementTree

# RTF

#: Groups whose content is no text.
RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote fldinst".split())
#: Control words that stand for characters.
RTF_CHARACTERS = {"par": "\n", "line": "\n", "tab": "\t", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emdash": "—", "endash": "–", "bullet": "•"}
_RTF_TOKEN = re.compile(r"\\'(?P<hex>[0-9a-fA-F]{2})|\\(?P<word>[a-zA-Z]+)(?P<number>-?\d+)? ?|\\(?P<symbol>.)|(?P<brace>[{}])|(?P<text>[^\\{}\r\n]+)|.", re.DOTALL)


def rtf_text(content: bytes) -> str:
    """Text of an RTF file: a stack of groups, each with what it skips and how many fallback characters follow its ``\\u``.

    Groups marked ignorable are skipped; bytes are read in the file's code page, Windows-1252 if it names none that is known.
    """
    source = content.decode("latin-1")
    page, out, at = "cp1252", [], 0
    groups, skipped, fallback = [], False, 1
    pending = 0  # fallback characters still to be left out
    opened = False  # nothing but the brace has come in this group

    def put(text: str) -> None:
        nonlocal pending
        left = min(pending, len(text))
        pending -= left
        if not skipped:
            out.append(text[left:])

    while (token := _RTF_TOKEN.match(source, at)) is not None:
        at, first, opened = token.end(), opened, False
        if token["brace"] == "{":
            groups.append((skipped, fallback))
            opened, pending = True, 0
        elif token["brace"] == "}":
            skipped, fallback = groups.pop() if groups else (False, 1)
            pending = 0
        elif token["hex"]:
            put(bytes([int(token["hex"], 16)]).decode(page, "replace"))
        elif token["symbol"]:
            if token["symbol"] == "*" and first:
                skipped = True
            elif token["symbol"] in "\\{}":
                put(token["symbol"])
            elif token["symbol"] == "~":
                put(" ")
        elif token["text"]:
            put(token["text"].encode("latin-1").decode(page, "replace"))
        elif (word := token["word"]) is not None:
            number = int(token["number"]) if token["number"] else None
            if first and word in RTF_SKIPPED:
                skipped = True
            elif word == "bin":
                at += max(0, number or 0)
            elif word == "u" and number is not None:
                pending = 0
                put(chr(number % 65536))
                pending = fallback
            elif word == "uc" and number is not None:
                fallback = max(0, number)
            elif word == "ansicpg" and number is not None:
                try:
                    page = codecs.lookup(f"cp{number}").name
                except LookupError:
                    pass
            elif word in RTF_CHARACTERS:
                put(RTF_CHARACTERS[word])
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # halves of a pair come as two \u
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# YAML


class YamlError(ValueError):
    """Text that isn't YAML, or a form of it that isn't read: anchors, aliases, tags, complex keys, further documents."""


_INTEGER = re.compile(r"[-+]?\d+")
_FLOAT = re.compile(r"[-+]?(\.\d+|\d+(\.\d*)?)([eE][-+]?\d+)?")
_KEY = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|(?![?-]\s)[^\s#&*!|>'"%@`{}\[\],](?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|$)""")
#: Scalars and keys without any mark, whose value by the flow rules is their own text.
_UNMARKED = re.compile(r"[A-Za-z0-9_.]+(?: [A-Za-z0-9_.]+)*")
_SPACE = re.compile(r"(?:\s|(?:(?<=\s)|^)#[^\n]*)*")
_COMPLEX = re.compile(r"\?(\s|$)")
_PAIR = re.compile(r":(\s|$)")
_COMMENT = re.compile(r"(^|\s)#")
_QUOTED = {'"': re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL), "'": re.compile(r"'((?:[^']|'')*)'", re.DOTALL)}
#: Plain text in a flow form, by what ends it.
_BARE = {
    ends: re.compile(rf".*?(?=\s#|:(?:\s|$|[{re.escape(ends)}])|[{re.escape(ends)}]|$)" if ends else r".*?(?=\s#|$)", re.DOTALL) for ends in ("", ",]", ",}")
}
#: Escapes of double-quoted text.
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": " ", "P": " "}


def _plain(text: str) -> object:
    """A plain scalar by the core schema."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if text[0].isalpha():  # no form of a number
        return text
    if _INTEGER.fullmatch(text):
        return int(text)
    if re.fullmatch(r"0o[0-7]+|0x[0-9a-fA-F]+", text):
        return int(text, 0)
    if _FLOAT.fullmatch(text):
        return float(text)
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)", text):
        return "-Infinity" if text[0] == "-" else "Infinity"
    return "NaN" if text in (".nan", ".NaN", ".NAN") else text


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES:
            raise YamlError(f"unknown escape \\{m[2]}")
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|(.))", one, text, flags=re.DOTALL)


def _folded_lines(text: str) -> str:
    """Line breaks inside quoted or plain text: one becomes a space, n + 1 become n."""
    return text if "\n" not in text else re.sub(r"[ \t]*\n[ \t]*((?:\n[ \t]*)*)", lambda m: "\n" * m[1].count("\n") or " ", text)


class _Flow:
    """Flow forms: [..], {..}, quoted and plain scalars, over a text that may have line breaks."""

    def __init__(self, text: str):
        self._text, self._at = text, 0

    def whole(self) -> object:
        if _UNMARKED.fullmatch(self._text):
            return _plain(self._text)
        value = self.value("")
        self._space()
        if self._at < len(self._text):
            raise YamlError("text after a flow value")
        return value

    def _space(self) -> None:
        c = self._text[self._at : self._at + 1]
        if c == "#" or c.isspace():
            self._at = _SPACE.match(self._text, self._at).end()

    def _peek(self) -> str:
        self._space()
        return self._text[self._at : self._at + 1]

    def value(self, ends: str) -> object:
        c = self._peek()
        if c in ("[", "{"):
            return self._list() if c == "[" else self._map()
        if c in ('"', "'"):
            return self._quoted(c)
        if c and c in "&*!|>%@`":
            raise YamlError(f"{c} isn't read")
        if c == "?" and _COMPLEX.match(self._text[self._at : self._at + 2]):
            raise YamlError("complex keys aren't read")
        return _plain(self._bare(ends))

    def _quoted(self, c: str) -> str:
        m = _QUOTED[c].match(self._text, self._at)
        if m is None:
            raise YamlError("quote without an end")
        self._at = m.end()
        if c == "'":
            return _folded_lines(m[1]).replace("''", "'")
        return _unescaped(_folded_lines(re.sub(r"\\\n[ \t]*", "", m[1])))

    def _bare(self, ends: str) -> str:
        m = _BARE[ends].match(self._text, self._at)
        self._at = m.end()
        if not ends and _PAIR.search(m[0]):
            raise YamlError("a pair inside a value")
        return _folded_lines(m[0].strip())

    def _list(self) -> list:
        self._at += 1
        out = []
        while self._peek() != "]":
            item = self.value(",]")
            if self._peek() == ":":  # a pair stands for a map of one
                self._at += 1
                item = {_key(item): self.value(",]")}
            out.append(item)
            self._comma("]")
        self._at += 1
        return out

    def _map(self) -> dict:
        self._at += 1
        out = {}
        while self._peek() != "}":
            key, value = _key(self.value(",}")), None
            if self._peek() == ":":
                self._at += 1
                value = self.value(",}")
            _put(out, key, value)
            self._comma("}")
        self._at += 1
        return out

    def _comma(self, end: str) -> None:
        c = self._peek()
        if c == ",":
            self._at += 1
        elif c != end:
            raise YamlError(f"no {end}")


def _key(value: object) -> str:
    if isinstance(value, (list, dict)):
        raise YamlError("a key is a scalar")
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def _put(out: dict, key: str, value: object) -> None:
    if key in out:
        raise YamlError(f"{key} stands twice")
    out[key] = value


class _Yaml:
    """Block forms by indentation."""

    def __init__(self, text: str):
        self._lines, self._at = text.split("\n"), 0
        self._seen: tuple[str | None, tuple[int, str] | None] = (None, None)
        self._keyed: tuple[str | None, re.Match | None] = (None, None)

    def _key_of(self, body: str) -> re.Match | None:
        """The key that a line's content begins with; the last one is asked for again and again."""
        if self._keyed[0] is not body:
            self._keyed = body, _KEY.match(body)
        return self._keyed[1]

    def _next(self) -> tuple[int, str] | None:
        """Indent and content of the next line with content; comments and blank lines are passed."""
        while self._at < len(self._lines):
            line = self._lines[self._at]
            if line is self._seen[0]:
                return self._seen[1]
            body = line.lstrip(" ")
            if body.strip() and not body.startswith("#"):
                if body.startswith("\t"):
                    raise YamlError("a tab indents")
                self._seen = line, (len(line) - len(body), body.rstrip())
                return self._seen[1]
            self._at += 1
        return None

    def whole(self) -> object:
        first = self._next()
        while first is not None and first[1].startswith("%"):
            self._at += 1
            first = self._next()
        if first is not None and re.match(r"---(\s|$)", first[1]):
            self._lines[self._at] = "   " + self._lines[self._at][3:]
        value = self.node(-1)
        rest = self._next()
        if rest is not None and rest[1] == "...":
            self._at += 1
            rest = self._next()
        if rest is not None:
            raise YamlError(f"line {self._at + 1} belongs to nothing")
        return value

    def node(self, outer: int) -> object:
        """The value that stands deeper than ``outer``."""
        line = self._next()
        if line is None or line[0] <= outer:
            return None
        indent, body = line
        if body == "-" or body.startswith("- "):
            return self._list(indent)
        if self._key_of(body) and not body.startswith(("[", "{")):
            return self._map(indent)
        return self._scalar(body, outer)

    def _list(self, indent: int) -> list:
        out = []
        while (line := self._next()) is not None and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            rest = line[1][1:]
            if rest.strip() and not rest.lstrip().startswith("#"):
                # What follows the dash is a node of its own, indented to where it stands.
                self._lines[self._at] = " " * (indent + 1) + self._lines[self._at][indent + 1 :]
                rest = rest.strip()
                out.append(self.node(indent) if self._is_block(rest) else self._value(rest, indent))
            else:
                self._at += 1
                out.append(self.node(indent))
        return out

    def _is_block(self, body: str) -> bool:
        return body == "-" or body.startswith("- ") or (bool(self._key_of(body)) and not body.startswith(("[", "{")))

    def _map(self, indent: int) -> dict:
        out = {}
        while (line := self._next()) is not None and line[0] == indent and (m := self._key_of(line[1])):
            rest = line[1][m.end() :].strip()
            key = _key(_Flow(m[1]).whole())
            if rest and not rest.startswith("#"):
                value = self._value(rest, indent)
            else:
                self._at += 1
                following = self._next()
                # A list may stand as deep as its key.
                flat = following is not None and following[0] == indent and (following[1] == "-" or following[1].startswith("- "))
                value = self._list(indent) if flat else self.node(indent)
            _put(out, key, value)
        if (line := self._next()) is not None and line[0] > indent:
            raise YamlError(f"line {self._at + 1} is indented too far")
        return out

    def _value(self, body: str, outer: int) -> object:
        if body[0] in "|>":
            return self._block(body, outer)
        return self._scalar(body, outer)

    def _block(self, head: str, outer: int) -> str:
        m = re.fullmatch(r"([|>])(?:([-+])|([1-9]))?(?:([-+])|([1-9]))?(?:\s+#.*)?", head)
        if m is None:
            raise YamlError("unknown head of a block")
        chomp, given = m[2] or m[4] or "", m[3] or m[5]
        self._at += 1
        lines, indent = [], outer + int(given) if given and outer >= 0 else int(given) if given else None
        while self._at < len(self._lines):
            line = self._lines[self._at]
            if line.strip():
                depth = len(line) - len(line.lstrip(" "))
                if indent is None and depth > outer:
                    indent = depth
                if indent is None or depth < indent:
                    break
            lines.append(line[indent or 0 :] if line.strip() or indent is None else line[indent:])
            self._at += 1
        body = [x if x.strip() else x.strip(" ") for x in lines]
        end = len(body)
        while end and not body[end - 1]:
            end -= 1
        text = "\n".join(body[:end]) if m[1] == "|" else self._fold(body[:end])
        return text + ("\n" * (len(body) - end + 1) if chomp == "+" and end else "" if chomp == "-" or not end else "\n")

    @staticmethod
    def _fold(lines: list[str]) -> str:
        out, blank = "", 0
        for i, line in enumerate(lines):
            if not line:
                blank += 1
                continue
            if i and out:
                more = line[0] in " \t" or lines[i - 1 - blank][:1] in (" ", "\t")
                out += "\n" * (blank + 1) if more else "\n" * blank or " "
            else:
                out += "\n" * blank
            out, blank = out + line, 0
        return out

    def _scalar(self, body: str, outer: int) -> object:
        """A flow value or scalar that may go on in deeper lines."""
        text = body
        self._at += 1
        quote = body[0] if body[0] in "\"'" else ""
        while self._at < len(self._lines):
            line = self._lines[self._at]
            if quote or body[0] in "[{":
                try:
                    return _Flow(text).whole()
                except YamlError:
                    pass
            elif _COMMENT.search(text.rsplit("\n", 1)[-1]):
                break
            depth = len(line) - len(line.lstrip(" "))
            if line.strip() and (depth <= outer or (not quote and body[0] not in "[{" and _KEY.match(line.strip()))):
                break
            text += "\n" + line.strip()
            self._at += 1
        return _Flow(text.rstrip("\n")).whole()


def yaml_value(text: str) -> object:
    """The value of a YAML document: maps, lists, flow forms, block scalars and quotes."""
    return _Yaml(text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")).whole()


# Office files

#: Bytes of a member as stored, of a member unpacked, and of all that is unpacked.
MOST_STORED, MOST_MEMBER, MOST_TOTAL = 8 << 20, 32 << 20, 64 << 20


class Members:
    """Members of a zip file within bounds, whatever sizes its directory claims."""

    def __init__(self, content: bytes):
        self._zip, self._left = zipfile.ZipFile(io.BytesIO(content)), MOST_TOTAL
        self.names = self._zip.namelist()

    def numbered(self, pattern: str) -> list[str]:
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]

    def read(self, name: str) -> bytes:
        info = self._zip.getinfo(name)
        if info.compress_size > MOST_STORED:
            raise ValueError(f"{name} is larger than {MOST_STORED} bytes")
        most = min(MOST_MEMBER, self._left)
        with self._zip.open(info) as member:
            out = member.read(most + 1)
        if len(out) > most:
            raise ValueError(f"{name} unpacks to more than is allowed")
        self._left -= len(out)
        return out

    def root(self, name: str) -> ElementTree.Element:
        content = self.read(name)
        if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
            raise ValueError(f"{name} declares entities")
        return ElementTree.fromstring(content)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _below(e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if _local(x) in names]


def docx_text(content: bytes) -> str:
    """Paragraphs of a document, a blank line between them; tabs and line breaks of runs are kept.

    Text that stands in no paragraph is one by itself; so is a paragraph inside another, after what the outer one held before it.
    """
    shown, paragraphs = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}, [[]]

    def walk(e: ElementTree.Element, in_run: bool) -> None:
        name = _local(e)
        if name == "p":
            paragraphs.append([])
        if name == "t":
            paragraphs[-1].append(e.text or "")
        elif in_run and name in shown:  # properties hold tab stops of the same name
            paragraphs[-1].append(shown[name])
        for x in e:
            walk(x, name == "r")
        if name == "p":
            paragraphs.append([])

    walk(Members(content).root("word/document.xml"), False)
    # Empty paragraphs are kept as such, the lists that only close one are not.
    closed = [x for i, x in enumerate(paragraphs) if x or i % 2]
    return "\n\n".join(map("".join, closed)).strip()


def pptx_text(content: bytes) -> str:
    members = Members(content)
    slides = [" ".join(t.text or "" for t in _below(members.root(n), "t")) for n in members.numbered(r"ppt/slides/slide(\d+)\.xml")]
    return "\n\n".join(s for s in slides if s)


def _column(reference: str | None, following: int) -> int:
    """Column of a cell from 0, by its reference such as AB12, or else the one after the last."""
    letters = re.match(r"[A-Z]+", reference or "")
    if letters is None:
        return following
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _cells(row: ElementTree.Element, strings: list[str]) -> list[str]:
    out: dict[int, str] = {}
    at = 0
    for c in row:
        if _local(c) != "c":
            continue
        at = _column(c.get("r"), at)
        text = "".join(x.text or "" for x in _below(c, "t" if c.get("t") == "inlineStr" else "v"))
        if c.get("t") == "s" and text:
            text = strings[int(text)] if int(text) < len(strings) else ""
        out[at] = text
        at += 1
    if out and max(out) > 16_384:
        raise ValueError("a cell stands beyond the last column")
    return [out.get(i, "") for i in range(max(out) + 1)] if out else []


def _sheet(root: ElementTree.Element, strings: list[str]) -> str:
    rows = [cells for row in _below(root, "row") if (cells := _cells(row, strings))]
    if not rows:
        return ""
    head, *body = rows
    if not body:
        return ", ".join(head)
    return "\n".join(", ".join(f"{h}: {row[i] if i < len(row) else ''}" for i, h in enumerate(head)) for row in body)


def xlsx_text(content: bytes) -> str:
    """Sheets in the order of their numbers, the first row of each naming the columns of the others."""
    members = Members(content)
    strings = []
    if "xl/sharedStrings.xml" in members.names:
        strings = ["".join(t.text or "" for t in _below(si, "t")) for si in _below(members.root("xl/sharedStrings.xml"), "si")]
    return "\n\n".join(_sheet(members.root(n), strings) for n in members.numbered(r"xl/worksheets/sheet(\d+)\.xml"))


# Mail


def mail_parts(content: bytes) -> tuple[str, str, str, str]:
    """Header lines, plain body, HTML body (only without a plain one) and list of attachments."""
    mail = email.message_from_bytes(content, policy=email.policy.default)
    head = [f"{k}: {mail[k]}" for k in ("Subject", "From", "To", "Cc", "Date") if mail[k]]
    plain, html = mail.get_body(("plain",)), mail.get_body(("html",))
    files = [f"- {a.get_filename()} ({len(a.get_payload(decode=True) or b'')} bytes)" for a in mail.iter_attachments()]
    body = plain.get_content().strip() if plain else ""
    return "\n".join(head), body, html.get_content() if html and not body else "", "Attachments:\n" + "\n".join(files) if files else ""
