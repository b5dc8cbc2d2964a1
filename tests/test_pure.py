"""Parts without Spark: the chunker, label lines, ignore rules."""

import re

import numpy as np
import pytest

from hayrake.engine import MockEmbedder, check_query
from hayrake.functions import chunker
from hayrake.functions.paths import ignore_patterns
from hayrake.functions.vectors import hashed_vector
from hayrake.operators.labels import inserted_lines


def table(path, source):
    return [(c.symbol, c.symbol_type, c.line_start, c.line_end) for c in chunker.chunk_file(path, source)]


RUST = """//! About this file.
pub fn first(a: [u8; 4]) -> Vec<u8> {
    let brace = "}";  // {
    vec![]
}

/// Said of second.
/// More of it.
#[inline]
async fn second() {}

pub struct Point<T> {
    x: T,
}

struct Unit;

impl<T> Show for Point<T> {
    fn show(&self) -> char { '{' }
}

enum Kind { A, B }

trait Walk {
    fn walk(&self);
    fn run(&self) { self.walk() }
}

mod inner {
    mod deep { fn leaf() {} }
}
"""


def test_rust():
    assert table("a/x.rs", RUST) == [
        ("first", "function", 1, 5), ("second", "function", 7, 10), ("Point", "struct", 12, 14), ("Unit", "struct", 16, 16), ("Point", "impl", 18, 20), ("Point::show", "function", 19, 19),
        ("Kind", "enum", 22, 22), ("Walk", "trait", 24, 27), ("Walk::run", "function", 26, 26), ("inner", "module", 29, 31), ("inner::deep", "module", 30, 30), ("inner::deep::leaf", "function", 30, 30),
    ]
    found = {c.symbol: c for c in chunker.chunk_file("x.rs", RUST)}
    assert found["second"].doc_first_line == "/// Said of second." and found["second"].signature == "async fn second() {}"
    assert "fn run" not in found["Walk"].body and "fn walk(&self);" in found["Walk"].body


def test_python():
    source = '"""About."""\nimport os\n\n\n# Said of it.\ndef one(a):\n    """Own words."""\n    def within():\n        pass\n    return a\n\n\nclass Box:\n    size = 1\n\n    async def open(self):\n        return 2\n'
    assert table("x.py", source) == [("one", "function", 5, 10), ("one::within", "function", 8, 9), ("Box", "class", 13, 17), ("Box::open", "function", 16, 17)]
    found = {c.symbol: c for c in chunker.chunk_file("x.py", source)}
    assert found["one"].doc_first_line == "# Said of it." and found["Box"].doc_first_line is None and "open" not in found["Box"].body


def test_scripts():
    source = "// Adds.\nfunction add(a, b) {\n  if (a) { return `}${b}`; }\n}\n\nexport class Cart extends Base {\n  total = 0;\n  constructor(x) {\n    super(x);\n  }\n  get size() { return 1; }\n  async load(id) {\n    for (const a of id) { add(a); }\n  }\n}\nconst arrow = () => { return 1; };\n"
    want = [("add", "function", 1, 4), ("Cart", "class", 6, 15), ("Cart::constructor", "function", 8, 10), ("Cart::size", "function", 11, 11), ("Cart::load", "function", 12, 14)]
    assert table("x.js", source) == want
    assert table("x.tsx", source.replace("(a, b)", "(a: number, b: string): number")) == want


def test_go_and_c():
    go = "package p\n\n// Opens.\nfunc Open(n string) (*Box, error) {\n\treturn nil, nil\n}\n\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Close() error {\n\treturn nil\n}\n"
    assert table("x.go", go) == [("Open", "function", 3, 6), ("Box", "type", 8, 10), ("Box::Close", "function", 12, 14)]
    c = "/* Adds. */\nstatic int add(int a, int b)\n{\n    if (a) { return b; }\n    return a;\n}\n\nint later(void);\n\nstruct pair {\n    int a;\n};\n"
    assert table("x.h", c) == [("add", "function", 1, 6), ("pair", "struct", 10, 12)]
    cpp = "class Shape {\npublic:\n    Shape() : n(0) {}\n    virtual double area() const { return n; }\nprivate:\n    int n;\n};\n\nnamespace geo {\ntemplate <class T> T twice(T x) { return x + x; }\n}\n"
    assert table("x.hpp", cpp) == [("Shape", "class", 1, 7), ("Shape::Shape", "function", 3, 3), ("Shape::area", "function", 4, 4), ("twice", "function", 10, 10)]


def test_prelude_split_and_errors():
    head = "// " + "x" * 90 + "\nuse a::b;\n\n"
    first = chunker.chunk_file("x.rs", head + "fn f() {}\n")[0]
    assert (first.symbol, first.line_start) == (chunker.PRELUDE, 1) and chunker.chunk_file("x.rs", "// short\nfn f() {}\n")[0].symbol == "f"
    assert chunker.chunk_file("x.rs", "// " + "only words " * 20)[0].symbol == chunker.PRELUDE
    long = "fn big() {\n" + "".join(f"    let a{k} = call({k});\n" for k in range(300)) + "}\n"
    parts = chunker.chunk_file("x.rs", long)
    assert len(parts) > 2 and all(len(p.body) <= chunker.MAX_CHARS and p.body.startswith("fn big() {") for p in parts)
    assert [p.fragment for p in parts] == list(range(len(parts)))
    assert all(p in "".join(c.body for c in parts) for p in re.findall(r"let a\d+ = call\(\d+\);", long))
    with pytest.raises(chunker.Unparsable):
        chunker.chunk_file("x.rs", "fn a() { {{{{ let x = 1;\n" * 10)
    assert [c.symbol for c in chunker.chunk_file("x.rs", "fn a() {}\n" * 20 + "fn b( {\n")][:1] == ["a"]
    with pytest.raises(chunker.Unparsable):
        chunker.chunk_file("x.py", "def (:\n" * 5)
    assert chunker.chunk_file("x.txt", "fn a() {}") == [] and chunker.language_of("A.RS") is None and chunker.language_of("a.b/c") is None
    same = [c.body for c in chunker.chunk_file("x.rs", RUST)]
    assert same == [c.body for c in chunker.chunk_file("x.rs", RUST.replace("\n", "\r\n"))]


def test_hard_split():
    text = "a" * 50 + "\n" + "b" * 120 + "\n" + "c\n" * 30
    parts = chunker.hard_split(text, 60)
    assert "".join(parts) == text and max(map(len, parts)) <= 60
    assert chunker.hard_split("") == []


def test_inserted_lines():
    assert inserted_lines(None, "a\nb\n") == [1, 2] and inserted_lines("a\nb\n", None) == []
    assert inserted_lines("a\nb\nc\n", "a\nx\nc\nd\n") == [2, 4] and inserted_lines("a\nb", "b") == []


def test_ignore_rules():
    rules = ignore_patterns("# c\n*.log\n!keep.log\n/build/\ndocs/*.md\n**/tmp\n")
    said = lambda p: [back for back, rx in rules if rx.fullmatch(p)][-1:] == [False]
    assert [said(p) for p in ("a.log", "x/y.log", "x/keep.log", "build/a", "x/build/a", "docs/a.md", "docs/x/a.md", "a/tmp/b", "tmp")] == [True, True, False, True, False, True, False, True, True]


def test_hashed_vector():
    v = hashed_vector("some text", 64)
    assert v.shape == (64,) and np.isclose(np.linalg.norm(v), 1, atol=1e-3) and (v == hashed_vector("some text", 64)).all()
    assert hashed_vector("", 4).tolist() == [1, 0, 0, 0] and not (v == hashed_vector("other text", 64)).all()
    assert MockEmbedder(dims=8).embed(["a", "b"], "query").shape == (2, 8)


@pytest.mark.parametrize("query, k", [("", 5), (" ", 5), ("x" * 1001, 5), ("x", 0), ("x", 21)])
def test_bounds(query, k):
    with pytest.raises(ValueError):
        check_query(query, k)
