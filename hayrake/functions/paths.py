"""Which files are indexed: exclusions in their order of precedence, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hayrake.functions.chunker import LANGUAGES

MOST_BYTES = 1_048_576
SNIFFED_BYTES = 8192
VENDOR_DIRS = ("node_modules", "vendor", "target", "dist", ".venv")
SECRETS = (r"\.env", r"\.env\..*", r".*\.pem", r".*\.key", r"id_rsa.*", r"credentials\..*", r"secrets\..*")
GENERATED = (r".*_pb2\.py", r".*\.generated\..*")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_secret(path: Column) -> Column:
    return base_name(path).rlike("^(?:" + "|".join(SECRETS) + ")$")


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRS)))


def is_generated(path: Column) -> Column:
    return base_name(path).rlike("^(?:" + "|".join(GENERATED) + ")$")


def language(path: Column) -> Column:
    """By extension, case-sensitive; null if it is none of ours."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFFED_BYTES), F.lit(b"\x00"))


def ignore_patterns(gitignore: str) -> list[tuple[bool, re.Pattern]]:
    """Rules of a root .gitignore in order: whether they take back, and what they match (paths or their folders)."""
    out = []
    for line in gitignore.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[back:].removeprefix("\\")
        folder = line.endswith("/")
        body = line.strip("/")
        anchored = "/" in line.rstrip("/")
        rx, k = "", 0
        while k < len(body):
            if body.startswith("**/", k):
                rx, k = rx + "(?:.*/)?", k + 3
            elif body.startswith("/**", k) and k + 3 == len(body):
                rx, k = rx + "/.*", k + 3
            elif body[k] == "*":
                rx, k = rx + "[^/]*", k + 1
            elif body[k] == "?":
                rx, k = rx + "[^/]", k + 1
            elif body[k] == "[" and "]" in body[k:]:
                end = body.index("]", k)
                rx, k = rx + "[" + body[k + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                rx, k = rx + re.escape(body[k]), k + 1
        out.append((back, re.compile(("" if anchored else "(?:.*/)?") + rx + ("/.*" if folder else "(?:/.*)?"))))
    return out


def is_ignored(path: Column, gitignore: str) -> Column:
    """Whether the last rule that fits ignores the path; nothing leaves the JVM."""
    out = F.lit(False)
    for back, pattern in ignore_patterns(gitignore):
        out = F.when(path.rlike(f"^{pattern.pattern}$"), F.lit(not back)).otherwise(out)
    return out


def skip_reason(path: Column, gitignore: str = "") -> Column:
    """secret, vendor, generated, gitignore or language in this order; null for a path to read."""
    return (
        F.when(is_secret(path), "secret").when(is_vendored(path), "vendor").when(is_generated(path), "generated")
        .when(is_ignored(path, gitignore), "gitignore").when(language(path).isNull(), "language")
    )


def content_reason(length: Column, content: Column) -> Column:
    """too_large, binary or not_utf8, else null."""
    return F.when(length > MOST_BYTES, "too_large").when(is_binary(content), "binary").when(~F.is_valid_utf8(content.cast("string")), "not_utf8")
