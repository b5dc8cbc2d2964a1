"""String functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hayrake.schema import HASH_SCHEME

PREVIEW_BYTES = 320
MAINTENANCE = ("wip", "fixup", "typo", "bump", "lint")


def split_identifier(token: Column) -> Column:
    """Lower-case parts of an identifier, each once: the whole first if it is one plain word.

    ASCII letters and digits only; every other character separates. A part
    begins at a capital after a small letter, and at the last capital of a
    run that a small letter follows.
    """
    whole = F.when(token.rlike("^[A-Za-z0-9_-]+$"), F.array(F.lower(token))).otherwise(F.expr("cast(array() as array<string>)"))
    spaced = F.regexp_replace(token, "([A-Z])([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.concat(whole, F.split(F.lower(spaced), " ")), lambda x: x != ""))


def blank_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def marked_words(text: Column) -> Column:
    """Words between white space, lower-case, as `terms_of_word` takes them.

    Parts are set off over the whole text, by a handful of expressions
    whatever the number of words: \x01 stands between parts, \x02 for other
    characters, which are left out about a word of one part.
    """
    marked = F.regexp_replace(text, r"[^A-Za-z0-9_\s-]+", "\x02")
    marked = F.regexp_replace(marked, "([A-Z])([A-Z][a-z])", "$1\x01$2")
    marked = F.regexp_replace(marked, "([a-z])([A-Z])", "$1\x01$2")
    marked = F.regexp_replace(marked, r"(?<!\S)\x02?([A-Za-z0-9]++)\x02?(?!\S)", "$1")
    return F.filter(F.split(F.lower(marked), r"\s+"), lambda x: x != "")


def terms_of_word(word: Column) -> Column:
    """The terms of a word of `marked_words`, as `split_identifier` finds them."""
    plain = F.when(F.contains(word, F.lit("\x02")), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.replace(word, F.lit("\x01"), F.lit(""))))
    parts = F.array_distinct(F.filter(F.concat(plain, F.split(word, "[\x01\x02_-]+")), lambda x: x != ""))
    return F.when(word.rlike("^[a-z0-9]+$"), F.array(word)).otherwise(parts)


def code_tokens(text: Column) -> Column:
    """Terms of a text in order; parts of one word follow each other, repeats over words stay."""
    return F.flatten(F.transform(marked_words(text), terms_of_word))


def token_positions(text: Column) -> Column:
    """Array of (term, position): the parts of a word share its position; words without terms have none."""
    words = F.filter(F.transform(marked_words(text), terms_of_word), lambda x: F.size(x) > 0)
    return F.flatten(F.transform(words, lambda x, i: F.transform(x, lambda t: F.struct(t.alias("term"), i.alias("position")))))


def query_terms(text: Column) -> Column:
    return F.array_distinct(code_tokens(text))


def normalise_body(text: Column) -> Column:
    """Line ends unified, trailing blanks and outer blank lines cut, the common indent taken off.

    All by expressions over the whole text, linear in its length.
    """
    unified = F.regexp_replace(text, "\r\n?", "\n")
    inner = F.trim(F.regexp_replace(unified, r"(?<![ \t\x0B\f])[ \t\x0B\f]++(?=\n|\z)", ""), F.lit("\n"))
    indents = F.regexp_extract_all(F.translate(inner, "\t", " "), F.lit(r"(?<![^\n])( *+)[^\n]"), 1)  # blanks only, so the least is the shortest
    indent = F.coalesce(F.length(F.array_min(indents)), F.lit(0)).cast("string")
    return F.regexp_replace(inner, F.concat(F.lit(r"(?<![^\n])[ \t]{"), indent, F.lit("}")), F.lit(""))


def content_hash(language: Column, symbol: Column, body: Column) -> Column:
    """Digest of language, symbol and normalised body (null: empty); the path plays no part."""
    fields = [F.lit(str(HASH_SCHEME)), language, symbol, normalise_body(body)]
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f, F.lit("")) for f in fields)), 256)


def preview(body: Column) -> Column:
    """The first 320 bytes, cut back to whole characters."""
    head = F.make_valid_utf8(F.substring(body.cast("binary"), 1, PREVIEW_BYTES).cast("string"))
    return F.when(F.octet_length(body) <= PREVIEW_BYTES, body).otherwise(F.regexp_replace(head, r"\x{FFFD}+$", ""))


def signature_line(body: Column) -> Column:
    """The first line with something on it, trimmed; null without one."""
    return F.trim(F.try_element_at(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), F.lit(1)))


def is_doc_comment(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^(//|/\*|\*|#)")


def strip_doc_comments(body: Column) -> Column:
    """Without the lines that begin with `///` or `//!`."""
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.ltrim(x).rlike("^//[/!]")), "\n")


def line_count(text: Column) -> Column:
    return F.lit(1) + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def byte_to_line(text: Column, at: Column) -> Column:
    """1 and the newlines before a byte (counted from 0)."""
    return line_count(F.substring(text.cast("binary"), F.lit(1), at).cast("string"))


def commit_subject(message: Column) -> Column:
    return F.trim(F.element_at(F.split(message, "\n"), 1))


def word_count(text: Column) -> Column:
    return F.size(blank_words(text))


def maintenance_pattern(subject: Column, patterns: Sequence[str] = MAINTENANCE) -> Column:
    """The first of the patterns, taken literally, that is a word of the subject, else null; one outside the fixed list is called custom."""
    said = lambda p: F.lit(p.lower() if p.lower() in MAINTENANCE else "custom")
    return F.coalesce(*(F.when(subject.rlike(rf"(?i)\b{re.escape(p)}\b"), said(p)) for p in patterns), F.lit(None).cast("string"))


def length_bucket(query: Column) -> Column:
    n = word_count(query)
    return F.when(n <= 4, "short").when(n <= 10, "medium").otherwise("long")


def with_prefix(prefix: str | None, text: Column) -> Column:
    return F.concat(F.lit(prefix or ""), text)


def truncated(tokens: Column, most: int = 512) -> Column:
    return F.size(tokens) > most


def repo_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


_KINDS = {
    "function": ("function_item", "function_definition", "function_declaration", "method_definition", "method_declaration"),
    "struct": ("struct_item", "struct_specifier"),
    "type": ("type_spec", "type_declaration"),
    "class": ("class_definition", "class_declaration", "class_specifier"),
    "impl": ("impl_item",),
    "module": ("mod_item",),
    "enum": ("enum_item",),
    "trait": ("trait_item",),
}


def map_kind(kind: Column) -> Column:
    """Symbol type of a grammar's node kind."""
    return F.coalesce(*(F.when(kind.isin(*names), F.lit(to)) for to, names in _KINDS.items()), F.lit("other"))
