"""Readers of file formats, sampled fingerprints, filters over open metadata, and ranks by histogram passes."""

import hashlib
import io
import json
import math
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.filters import compile_open_filter
from tidemark.operators import evaluate, ingest
from tidemark.sources import extract, formats

YAML = [
    ("a: 1\nb:\n  - x\n  - y: 2\n    z: [1, two, {q: r}]\nc: {}\n", {"a": 1, "b": ["x", {"y": 2, "z": [1, "two", {"q": "r"}]}], "c": {}}),
    ("name: deploy\nsteps:\n- run: a b\n  env:\n    K: 'it''s'\n- run: \"x\\ty\"\n", {"name": "deploy", "steps": [{"run": "a b", "env": {"K": "it's"}}, {"run": "x\ty"}]}),
    ("a: |\n  one\n    two\n\n  three\nb: >-\n  f\n  g\n\n  h\nc: ~\n", {"a": "one\n  two\n\nthree\n", "b": "f g\nh", "c": None}),
    ("# c\n---\nk: v # comment\nu: http://x.y/z#frag\nt: 12:30\nn: -1.5e3\ni: 0x1F\no: 0o17\nb: True\ns: 'true'\n", {"k": "v", "u": "http://x.y/z#frag", "t": "12:30", "n": -1500.0, "i": 31, "o": 15, "b": True, "s": "true"}),
    ("- - a\n  - b\n-\n  - c\n- \n", [["a", "b"], ["c"], None]),
    ("plain text\n  goes on\n", "plain text goes on"),
    ("a: multi\n  line\n  value\nb: 2", {"a": "multi line value", "b": 2}),
    ("a: [1,\n  2, # x\n  3]\nb: \"q\n  r\"\n", {"a": [1, 2, 3], "b": "q r"}),
    ("", None),
    ("[]", []),
    ("a: []\r\nb: ''", {"a": [], "b": ""}),
    ("a: |+\n  x\n\nb: |2\n    y\n", {"a": "x\n\n", "b": "  y\n"}),
    ("\"quoted key\": 1\n'q': 2\nkey with spaces: 3\n", {"quoted key": 1, "q": 2, "key with spaces": 3}),
    ("a: >\n  x\n   y\n  z\n", {"a": "x\n y\nz\n"}),
    ("1: a\ntrue: b\nnull: c\nd: .inf\n", {"1": "a", "true": "b", "": "c", "d": "Infinity"}),
]


@pytest.mark.parametrize("text,value", YAML)
def test_yaml(text, value):
    assert formats.yaml_value(text) == value


@pytest.mark.parametrize("text", ["a: &x 1", "a: 1\na: 2", "a:\n\tb: 1", "a: [1", "a: 1\n---\nb: 2", "a: !!str 1", "a: 'x", "? x", "b: x: y", "a: 1\n   b: 2", "a: \"\\q\""])
def test_yaml_that_is_refused(text):
    with pytest.raises(formats.YamlError):
        formats.yaml_value(text)


def test_rtf():
    text = formats.rtf_text(
        rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator X;}Hello \b bold\b0 , caf\'e9 \u8217?s{\uc2 \u8364\'80x!}\par\par\par\par "
        rb"next{\info{\author Me{\b deep}}}\bin5 {}}{}after \{x\}\\y\emdash z\u55357?\u56832?"
        b"\r\n{nested {groups \\tab here}}}"
    )
    assert text == "Hello bold, café ’s€!\n\nnextafter {x}\\y—z😀nested groups \there"
    assert formats.rtf_text(rb"{\rtf1\ansicpg1251 \'cf}") == "П"
    assert formats.rtf_text(b"") == "" and formats.rtf_text(b"}}}{{a") == "a"


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet(rows):
    return f"<worksheet {S}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>"


def test_docx_keeps_paragraphs_apart():
    p = lambda *runs: "<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"
    body = p("<w:t>One </w:t>", "<w:t>line</w:t>") + p("<w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t>")
    assert formats.docx_text(packed(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})) == "One line\n\na\tb\nc"


def test_xlsx_sheets_and_missing_cells():
    shared = f"<sst {S}><si><t>name</t></si><si><r><t>si</t></r><r><t>ze</t></r></si></sst>"
    first = ['<c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c>', '<c r="C2"><v>3.5</v></c>', '<c r="A3" t="inlineStr"><is><t>x &amp; y</t></is></c><c r="B3"><v>1</v></c>']
    file = packed(**{"xl__sharedStrings.xml": shared, "xl__worksheets__sheet10.xml": sheet(['<c r="A1"><v>last</v></c>']), "xl__worksheets__sheet2.xml": sheet(first), "xl__worksheets__sheet3.xml": sheet([])})
    assert formats.xlsx_text(file) == "name: , : , size: 3.5\nname: x & y, : 1, size: \n\n\n\nlast"


def test_guards_of_zip_files():
    bomb = packed(**{"word__document.xml": b"<w/>" + b" " * (33 << 20)})
    with pytest.raises(ValueError, match="more than is allowed"):
        formats.docx_text(bomb)
    many = packed(**{f"ppt__slides__slide{i}.xml": b"<w/>" + b" " * (20 << 20) for i in range(4)})
    with pytest.raises(ValueError, match="more than is allowed"):
        formats.pptx_text(many)
    with pytest.raises(ValueError, match="larger than"):
        formats.docx_text(packed(**{"word__document.xml": random.Random(1).randbytes(9 << 20)}))
    with pytest.raises(ValueError, match="entities"):
        formats.docx_text(packed(**{"word__document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}))
    with pytest.raises(ValueError, match="last column"):
        formats.xlsx_text(packed(**{"xl__worksheets__sheet1.xml": sheet(['<c r="ZZZZZZ1"><v>1</v></c>'])}))


HTML_MAIL = b"Subject: Hi\nFrom: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/html\n\n<p>Some <b>bold</b> text</p>\n--X\nContent-Type: text/plain\nContent-Disposition: attachment; filename=n.txt\n\nabc\n--X--\n"


def test_extraction_as_a_column(spark):
    rows = [("eml", HTML_MAIL), ("eml", b"Subject: S\n\nplain body\n"), ("yaml", b"a: [1]"), ("yaml", b"a: [1"), ("rtf", rb"{\rtf1 x}"), ("xlsx", b"no zip"), ("pdf", b"%PDF"), (None, b"x"), ("txt", None), ("html", b"<p>a</p>")]
    df = spark.createDataFrame(rows, "kind string, content binary").select("kind", extract.extracted(F.col("kind"), F.col("content")).alias("e"))
    got = [(r["kind"], r["e"]["text"], (r["e"]["error"] or "").partition(":")[0]) for r in df.collect()]
    assert got == [
        ("eml", "Subject: Hi\nFrom: a@b.c\n\nSome **bold** text\n\nAttachments:\n- n.txt (3 bytes)", ""), ("eml", "Subject: S\n\nplain body", ""), ("yaml", "a[0]: 1", ""),
        ("yaml", None, "YamlError"), ("rtf", "x", ""), ("xlsx", None, "BadZipFile"), ("pdf", None, "ValueError"), (None, None, "ValueError"), ("txt", "", ""), ("html", "a", ""),
    ]


def test_large_files_are_fingerprinted_by_their_ends(spark, tmp_path):
    size = (100 << 20) + 12_345
    with (tmp_path / "large.txt").open("wb") as f:
        f.write(b"head" * 20_000)
        f.seek(size - 70_000)
        f.write(b"tail" * 17_500)
    (tmp_path / "small.txt").write_bytes(b"abc")
    (tmp_path / "left.bin").write_bytes(b"abc")
    content = (tmp_path / "large.txt").read_bytes()
    assert len(content) == size
    assert ingest.ends_of(f"file:{tmp_path}/large.txt", size) == (content[:65_536], content[-65_536:])
    got = {r["path"].rpartition("/")[2]: r["fingerprint"] for r in ingest.scan_files(spark, str(tmp_path)).collect()}
    ms = (tmp_path / "large.txt").stat().st_mtime_ns // 1_000_000
    assert got == {"small.txt": hashlib.sha256(b"abc").hexdigest(), "large.txt": hashlib.sha256(content[:65_536] + content[-65_536:] + f"{size}:{ms}".encode()).hexdigest()}


def kind(x):
    return "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x)


def passes(document, stored):
    """The rules on plain Python values."""
    same = lambda a, b: kind(a) == kind(b) and a == b and not isinstance(a, (list, dict))

    def test(field, condition):
        missing = field not in stored
        value = stored.get(field)
        if condition is None:
            return True
        if isinstance(condition, list):
            return not missing and any(same(value, c) for c in condition)
        if not isinstance(condition, dict):
            return not missing and same(value, condition)
        for op, wanted in condition.items():
            ordered = not missing and kind(value) == kind(wanted) and kind(value) in ("number", str)
            inside = isinstance(wanted, list) and not missing and any(same(value, w) for w in wanted)
            known = {"$gt": ordered and value > wanted, "$gte": ordered and value >= wanted, "$lt": ordered and value < wanted, "$lte": ordered and value <= wanted,
                     "$ne": missing or not same(value, wanted), "$in": inside, "$nin": not inside}
            if not known.get(op, False):
                return False
        return True

    if not isinstance(document, dict):
        return True
    return isinstance(stored, dict) and all(test(f, c) for f, c in document.items())


def test_filters_over_open_metadata(spark):
    values = [2022, 2022.0, -3, 10**12, 0.1, "2022", "published", "", True, False, None, ["a"], [], {"x": 1}]
    stored = [{"f": v} for v in values] + [{}, {"g": 1}, {"it's": 5, "a.b": "x"}, [1], "text", 5, None]
    texts = [json.dumps(s) for s in stored] + ["{broken", None]
    stored += [None, None]
    operands = [2022, "2022", "published", True, None, 0.1, 3]
    documents = [{"f": v} for v in operands] + [{"f": {op: v}} for op in ("$gt", "$gte", "$lt", "$lte", "$ne", "$what") for v in operands]
    documents += [{"f": {op: v}} for op in ("$in", "$nin") for v in ([2022, "a"], ["published", None], [], "published", [True])]
    documents += [{"f": [2022, "published"]}, {"f": []}, {}, None, "x", {"it's": 5}, {"a.b": "x"}, {"f": {"$gt": 0, "$lt": 3000}, "g": None}, {"f": {"$ne": 1}, "g": {"$nin": [1]}}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    rows = df.select("i", *[compile_open_filter(d, F.col("m")).alias(f"d{k}") for k, d in enumerate(documents)]).collect()
    for r in rows:
        for k, d in enumerate(documents):
            assert r[f"d{k}"] == passes(d, stored[r["i"]]), (d, texts[r["i"]])


def test_ranks_without_gathering_a_key(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "PARTS", 64)
    r = random.Random(5)
    groups = {"one": [1.0] * 50, "few": [3.0, 1.0], "spread": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(400)], "ties": [float(r.randrange(5)) for _ in range(333)], "wide": [-1.7e308, 1.7e308, 0.0], None: [2.0, 7.0, 5.0], "hot": [r.gauss(0, 1) for _ in range(2000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None)]
    got = {x["k"]: x for x in evaluate.ranked_values(spark.createDataFrame(rows, "k string, v double").withColumnRenamed("v", "x"), "x", {"median": 500, "p95": 950, "least": 0}, "k").withColumnRenamed("of_k", "k").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs.sort()
        assert (got[k]["median"], got[k]["p95"], got[k]["least"]) == (vs[math.ceil(len(vs) / 2) - 1], vs[-(-len(vs) * 950 // 1000) - 1], vs[0])
    plain = {x["k"]: x for x in evaluate.latency(spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None)], "k string, v double"), "v", "k").collect()}
    assert (plain["a"]["median"], plain["a"]["p95"], plain["a"]["most"], plain["b"]["median"]) == (1.0, 4.0, 4.0, None)


def test_yaml_asks_for_a_key_once_a_line(monkeypatch):
    """A line's key is looked for once, and plain scalars don't go through the flow parser: the time of large YAML files is there."""
    asked = []

    class Counted:
        def __init__(self, pattern):
            self._pattern = pattern

        def match(self, text):
            asked.append(text)
            return self._pattern.match(text)

    monkeypatch.setattr(formats, "_KEY", Counted(formats._KEY))
    text = "---\n- id: 1\n  props:\n    k: a b\n    n: 2.50\n- id: x\n  t: ~"
    assert formats.yaml_value(text) == [{"id": 1, "props": {"k": "a b", "n": 2.5}}, {"id": "x", "t": None}]
    assert len(asked) <= 8  # eleven, when each step looked again


def test_few_files_stand_as_objects():
    """Of a batch of files only a few are Python objects at a time."""
    taken = []

    class Watched:
        def __init__(self, column):
            self._column = column

        def __len__(self):
            return len(self._column)

        def slice(self, at, n):
            return Watched(self._column.slice(at, n))

        def to_pylist(self):
            taken.append(len(self._column))
            return self._column.to_pylist()

    n = 200
    kinds, files = pa.array(["rtf"] * n), pa.array([b"{\\rtf1 %d}" % i for i in range(n)])
    made = extract._extract.func(Watched(kinds), Watched(files))
    assert made.field("text").to_pylist() == [str(i) for i in range(n)] and made.field("error").null_count == n
    assert max(taken) <= 64
    assert len(extract._extract.func(kinds[:0], files[:0])) == 0
