"""Symbol chunks of source files, by a scanner of braces (or `ast` for Python).

No grammar library is at hand, so each language has patterns of the lines
that open a symbol; strings and comments are blanked first. Symbols of a
container stand on their own, and its chunk is what is left without them.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass

MAX_CHARS = 2048
MIN_SPLIT = 1024
LEAST_PRELUDE = 80
MOST_ERRORS = 0.5
PRELUDE = "<file_prelude>"

LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_C_FUNCTION = r"(?:^|(?<=[;{}\n:]))[ \t]*(?:template\s*<[^<>]*>\s*)?(?!(?:if|for|while|switch|return|else|do|case|new|delete|throw|struct|class|enum|union|namespace|typedef|public|private|protected)\b)(?P<at>(?:[A-Za-z_][\w:<>,~]*[ \t*&\n]+)*?)(?P<name>~?[A-Za-z_]\w*)[ \t]*\([^;{}()]*(?:\([^;{}()]*\)[^;{}()]*)*\)[ \t\n]*(?:const|noexcept|override|final|[ \t\n])*(?::[^;{}]*)?(?=\{)"
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", rf"(?P<at>(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn)\s+{_NAME}"),
        ("struct", rf"(?P<at>(?:pub(?:\([^)]*\))?\s+)?struct)\s+{_NAME}"),
        ("enum", rf"(?P<at>(?:pub(?:\([^)]*\))?\s+)?enum)\s+{_NAME}"),
        ("trait", rf"(?P<at>(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait)\s+{_NAME}"),
        ("module", rf"(?P<at>(?:pub(?:\([^)]*\))?\s+)?mod)\s+{_NAME}"),
        ("impl", r"(?P<at>(?:unsafe\s+)?impl)\b(?:\s*<[^{;]*?>)?\s+(?:[\w:<>,\s&']+?\s+for\s+)?(?P<name>[A-Za-z_]\w*)"),
    ],
    "typescript": [
        ("function", rf"(?P<at>(?:async\s+)?function\b)\s*\*?\s*{_NAME}"),
        ("class", rf"(?P<at>(?:abstract\s+)?class)\s+{_NAME}"),
        ("method", rf"(?:^|(?<=[;{{}}\n]))[ \t]*(?P<at>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*)\*?\s*(?!(?:if|for|while|switch|catch|return|function|new|with|do|else)\b){_NAME}\s*(?:<[^>(){{}}]*>)?\([^{{}};]*\)\s*(?::[^{{}};=]+)?(?=\{{)"),
    ],
    "go": [
        ("function", rf"^(?P<at>func)\s+{_NAME}"),
        ("method", rf"^(?P<at>func)\s*\(\s*(?:\w+\s+)?\*?(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*{_NAME}"),
        ("type", rf"^type\s+(?P<at>){_NAME}\s+(?:struct|interface)\b"),
    ],
    "c": [("function", _C_FUNCTION), ("struct", rf"(?P<at>struct)\s+{_NAME}\s*(?=\{{)")],
    "cpp": [("function", _C_FUNCTION), ("class", rf"(?P<at>class)\s+{_NAME}[^;{{}}()]*(?=\{{)"), ("struct", rf"(?P<at>struct)\s+{_NAME}[^;{{}}()]*(?=\{{)")],
}
PATTERNS["javascript"] = PATTERNS["typescript"]
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in PATTERNS.items()}
_BLANK = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n]){1,8}'", re.S
)


class Unparsable(ValueError):
    """Too much of a file is broken."""


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int


@dataclass
class Chunk:
    symbol: str
    symbol_type: str
    signature: str
    doc_first_line: str | None
    line_start: int
    line_end: int
    body: str
    fragment: int | None = None


def language_of(path: str) -> str | None:
    """By the extension, as it is written."""
    stem, dot, ext = path.rpartition("/")[2].rpartition(".")
    return LANGUAGES.get(ext) if dot else None


def blanked(source: str) -> str:
    """source with what stands in strings and comments made blank, newlines kept."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _pairs(code: str) -> tuple[dict[int, int], int]:
    """Closing place of each opening brace, and the characters in the reach of a brace without partner."""
    stack, to, bad = [], {}, 0
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            to[stack.pop()] = m.start()
        else:
            bad = max(bad, m.start())
    if stack:
        bad = max(bad, len(code) - stack[0])
    return to, bad


def _scan(language: str, source: str) -> list[Symbol]:
    code = blanked(source)
    to, bad = _pairs(code)
    if code.strip() and bad / max(1, len(code)) >= MOST_ERRORS:
        raise Unparsable(f"{bad} of {len(code)} characters")
    found: dict[tuple[int, int], Symbol] = {}
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(code):
            start = m.start("at") if m["at"] else m.start("name")
            stop = re.compile(r"[{;]").search(code, m.end())
            if kind in ("function", "method") and language in ("rust", "go"):
                stop = _after_parameters(code, m.end())
            if stop is None:
                continue
            if code[stop.start()] == "{":
                if stop.start() not in to:
                    continue
                end = to[stop.start()] + 1
                if language in ("c", "cpp") and kind in ("class", "struct") and code[end : end + 1] == ";":
                    pass
            elif language == "rust" and kind in ("struct", "module"):
                end = stop.end()
            else:
                continue
            name = f"{m['recv']}::{m['name']}" if kind == "method" and language == "go" else m["name"]
            if kind == "method":
                kind_ = "function"
                if language in ("typescript", "javascript") and not any(s.kind == "class" and s.start < start < s.end for s in found.values()):
                    continue
            else:
                kind_ = kind
            found.setdefault((start, end), Symbol(kind_, name, start, end))
    return sorted(found.values(), key=lambda s: (s.start, s.end))


def _after_parameters(code: str, at: int) -> re.Match | None:
    """The brace or semicolon behind a parameter list and a result type."""
    depth = 0
    for m in re.compile(r"[()\[\]{;]").finditer(code, at):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif depth <= 0:
            return m
    return None


def _python(source: str) -> list[Symbol]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as error:
        line = getattr(error, "lineno", None) or 1
        total = source.count("\n") + 1
        if (total - line + 1) / total >= MOST_ERRORS:
            raise Unparsable(str(error)) from error
        kept = "\n".join(source.split("\n")[: line - 1])
        return _python(kept) if kept.strip() else []
    starts = _line_starts(source)
    raw = source.split("\n")
    place = lambda line, column: starts[line - 1] + len(raw[line - 1].encode()[:column].decode("utf-8", "ignore"))
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append(Symbol(kind, node.name, place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)))
    return sorted(out, key=lambda s: (s.start, s.end))


def _line_starts(source: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", source))]


def qualified(symbols: list[Symbol]) -> list[str]:
    """Names after those of their containers, outermost first."""
    out = []
    for s in symbols:
        above = [o for o in symbols if o is not s and o.start <= s.start and s.end <= o.end and (o.start, o.end) != (s.start, s.end)]
        out.append("::".join([*(o.name for o in sorted(above, key=lambda o: (o.start, -o.end))), s.name]))
    return out


def without_members(source: str, symbol: Symbol, symbols: list[Symbol]) -> str:
    inner = [o for o in symbols if o is not symbol and symbol.start <= o.start and o.end <= symbol.end and (o.start, o.end) != (symbol.start, symbol.end)]
    parts, at = [], symbol.start
    for o in sorted(inner, key=lambda o: o.start):
        if o.start >= at:
            parts.append(source[at : o.start])
            at = o.end
        else:
            at = max(at, o.end)
    return "".join([*parts, source[at : symbol.end]])


def is_doc_line(line: str) -> bool:
    return line.lstrip().startswith(("//", "/*", "*", "#"))


def attached_doc(lines: list[str], first: int) -> tuple[int, str | None]:
    """First line of the comment above a line (both from 0) and its text; blank lines between do not part them."""
    at, top = first - 1, first
    while at >= 0 and (is_doc_line(lines[at]) or not lines[at].strip()):
        if lines[at].strip():
            top = at
        at -= 1
    return top, lines[top].strip() if top < first else None


def hard_split(text: str, most: int = MAX_CHARS) -> list[str]:
    """Whole lines packed into parts of at most `most` characters; longer lines are cut."""
    out, held = [], ""
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        while len(line) > most:
            if held:
                out.append(held)
                held = ""
            out.append(line[:most])
            line = line[most:]
        if len(held) + len(line) > most:
            out.append(held)
            held = ""
        held += line
    return [*out, held] if held else out


def split_oversize(text: str, signature: str) -> list[str]:
    """Parts of 1024 to 2048 characters that end where a statement does, each with the signature before it."""
    if len(text) <= MAX_CHARS:
        return [text]
    ends = [m.end() for m in re.finditer(r"[;}]\s*\n|\n(?=\s*\n)|\n(?=\S)", text)]
    out, at = [], 0
    room = MAX_CHARS - len(signature) - 1 if len(signature) < MIN_SPLIT else MAX_CHARS
    while at < len(text):
        if len(text) - at <= room:
            out.append(text[at:])
            break
        fit = [e for e in ends[bisect_right(ends, at) : bisect_right(ends, at + room)]]
        late = [e for e in fit if e - at >= MIN_SPLIT]
        if late or fit:
            to = (late or fit)[-1]
        else:
            to = at + len(hard_split(text[at : at + room + 1], room)[0])
        out.append(text[at:to])
        at = to
    put = lambda part: part if room == MAX_CHARS or part.startswith(signature) else f"{signature}\n{part}"
    return [put(p) for p in out if p.strip()]


def chunk_file(path: str, source: str, language: str | None = None) -> list[Chunk]:
    """Chunks of a source file in order; Unparsable if half of it or more is broken."""
    language = language or language_of(path)
    if language is None:
        return []
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    symbols = _python(source) if language == "python" else _scan(language, source)
    starts, lines = _line_starts(source), source.split("\n")
    line_of = lambda at: bisect_right(starts, at)
    out = []
    for s, name in zip(symbols, qualified(symbols)):
        first = line_of(s.start) - 1
        alone = not source[starts[first] : s.start].strip()  # else something else begins the line
        top, doc = attached_doc(lines, first) if alone else (first, None)
        raw = source[s.start : s.end]
        body = without_members(source, s, symbols)
        signature = next((x.strip() for x in raw.split("\n") if x.strip()), "")
        if not body.strip():
            continue
        parts = [body] if len(body) <= MAX_CHARS and len(raw) <= MAX_CHARS or len(body) <= MAX_CHARS else split_oversize(raw, signature)
        for k, part in enumerate(parts):
            out.append(Chunk(name, s.kind, signature, doc, top + 1, line_of(max(s.start, s.end - 1)), part, k if len(parts) > 1 else None))
    before = source[: symbols[0].start] if symbols else source
    if len(before.strip()) >= LEAST_PRELUDE:
        text = before.strip()
        first = source.index(text)
        own = Chunk(PRELUDE, "other", text.split("\n")[0].strip(), None, line_of(first), line_of(first + len(text) - 1), text)
        out.insert(0, own)
    return out
