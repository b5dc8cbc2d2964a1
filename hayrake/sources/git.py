"""History and changes of a git work tree, read by the git program on the driver.

Lists of paths and commits are metadata of one repository; file contents are
read by executors.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from hayrake.errors import DirtyWorktree, RevisionMismatch
from hayrake.schema import CHANGE
from hayrake.session import prepare


def _git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").decode().strip()


def require_revision(root: str, pinned: str) -> None:
    if (now := head(root)) != pinned:
        raise RevisionMismatch(f"the work tree is at {now}, not {pinned}")


def _changes(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"ord int, {CHANGE}")


def diff(spark: SparkSession, root: str, base: str, to: str = "HEAD") -> DataFrame:
    """ord, op (A, M, D or R), path and from_path between two commits, with renames."""
    parts = _git(root, "diff", "--name-status", "-M", "-z", base, to).decode("utf-8", "replace").split("\0")
    rows, k = [], 0
    while k < len(parts) - 1:
        op = parts[k][:1]
        if op in "RC":
            rows.append(("R" if op == "R" else "A", parts[k + 2], parts[k + 1] if op == "R" else None))
            k += 3
        else:
            rows.append((op if op in "AD" else "M", parts[k + 1], None))
            k += 2
    return _changes(spark, rows)


def dirty_paths(root: str) -> list[tuple[str, str, str | None]]:
    parts = _git(root, "status", "--porcelain", "-z", "--untracked-files=all").decode("utf-8", "replace").split("\0")
    rows, k = [], 0
    while k < len(parts) - 1:
        flags, path = parts[k][:2], parts[k][3:]
        if "R" in flags:
            rows.append(("R", path, parts[k + 1]))
            k += 1
        else:
            rows.append(("D" if "D" in flags else "A" if flags in ("??", "A ") else "M", path, None))
        k += 1
    return rows


def dirty(spark: SparkSession, root: str) -> DataFrame:
    """Changes of the work tree that no commit has."""
    return _changes(spark, dirty_paths(root))


def apply_policy(spark: SparkSession, root: str, policy: str) -> tuple[DataFrame, str]:
    """Dirty changes to index and the name of the state: index_worktree, index_commit_only or refuse."""
    found, commit = dirty_paths(root), head(root)
    if policy == "refuse" and found:
        raise DirtyWorktree("not committed: " + ", ".join(sorted(p for _, p, _ in found)))
    if policy == "index_worktree" and found:
        return _changes(spark, found), f"{commit}+dirty"
    return _changes(spark, []), commit


def commits(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """commit_id, ts, parents, message of HEAD's history, the latest first."""
    out = _git(root, "log", "--format=%H%x1f%ct%x1f%P%x1f%B%x1e", *([f"-n{most}"] if most else [])).decode("utf-8", "replace")
    rows = []
    for item in out.split("\x1e"):
        if item.strip():
            commit, ts, parents, message = item.lstrip("\n").split("\x1f")
            rows.append((commit, int(ts), len(parents.split()), message.strip("\n")))
    return spark.createDataFrame(rows, "commit_id string, ts bigint, parents int, message string")


def commit_changes(spark: SparkSession, root: str, history: DataFrame) -> DataFrame:
    """commit_id, file, old_text, new_text of the files that each commit changes against its first parent."""
    prepare(spark)

    def show(name: str) -> str | None:
        got = subprocess.run(["git", "-C", root, "show", name], capture_output=True)
        return got.stdout.decode("utf-8", "replace") if got.returncode == 0 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for commit in batch["commit_id"]:
                names = subprocess.run(["git", "-C", root, "diff-tree", "--no-commit-id", "--name-only", "-r", "--root", "-z", commit], capture_output=True, check=True).stdout
                for file in filter(None, names.decode("utf-8", "replace").split("\0")):
                    rows.append((commit, file, show(f"{commit}^:{file}"), show(f"{commit}:{file}")))
            yield pd.DataFrame(rows, columns=["commit_id", "file", "old_text", "new_text"])

    return history.select("commit_id").mapInPandas(run, "commit_id string, file string, old_text string, new_text string")


def files_at(spark: SparkSession, root: str, files: DataFrame, commit: str = "HEAD") -> DataFrame:
    """file and text of paths as a commit has them (null where it has none)."""
    prepare(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch["file"]:
                got = subprocess.run(["git", "-C", root, "show", f"{commit}:{file}"], capture_output=True)
                rows.append((file, got.stdout.decode("utf-8", "replace") if got.returncode == 0 else None))
            yield pd.DataFrame(rows, columns=["file", "text"])

    return files.select("file").mapInPandas(run, "file string, text string")
