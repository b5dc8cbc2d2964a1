"""Quality by hierarchical empirical Bayes.

A logistic classifier of form features gives each document's evidence. Sites
have two levels, host and path below it. Labels, and at a lower weight the
evidence of unlabelled documents, are summed by host and path over all
documents; a host's rate is shrunk towards the global one and a path's towards
its host's, the more the fewer documents it has. The strength of each
shrinkage is estimated from the spread of the rates. A document's logit is
moved by how far its path's posterior is from the global rate, where that
posterior is the one of all other documents: its own label and evidence are
left out, so a document moves others and never itself.

The classifier is fitted on a bounded sample of labelled documents. Defined
results: null and empty texts have the features of an empty text; a null host
or path is a level of its own; several labels of one document are averaged;
without labels, or with labels of one class only, the global rate decides;
repeated rows are judged alike, each by all rows but itself; a document alone
at its site has the global rate there; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.session import materialise, prepare

#: Labelled documents used for fitting, at most about so many (a hash of the id chooses them).
MAX_TRAIN_DOCS = 8000
#: Weight of an unlabelled document's evidence in its site's rate.
UNLABELLED = 0.2
#: Kept from this probability on.
THRESHOLD = 0.5
#: Site tables of at most so many rows are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 500_000
_MARKS = re.compile(r"[!?$%&*#|<>{}\[\]\\~^=+@]")
N_FEATURES = 12


def features(text: str | None) -> list[float]:
    """Form features of a whole text, all between 0 and about 10."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = len(_MARKS.findall(text))
    upper = sum(map(str.isupper, words))
    ends = text.count(".") + text.count(",")
    return [
        np.log1p(len(words)), len(text) / w / 10, upper / w, min(5.0, marks / w), min(5.0, text.count("!") / w), text.count("|") / w,
        min(2.0, ends / w), len(set(words)) / w, len(set(lines)) / max(1, len(lines)), len(lines) / w, sum(c in "0123456789" for c in text) / n if re.search("[0-9]", text) else 0.0, text.count(" ") / n,
    ]


class Classifier:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Classifier:
        """Ridge logistic regression by Newton's method."""
        if not len(y) or y.min() == y.max():
            rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
            return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([np.log(rate / (1 - rate)), *np.zeros(N_FEATURES)]))
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), 1.0)
        ridge[0] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-z @ w))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -15, 15)))


def _with_features(docs: DataFrame) -> DataFrame:
    names = [c for c in docs.columns if c != "text"]
    docs = docs.select(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*names, "features"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, kind + ", features array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Classifier:
    """The classifier of documents (doc_id, text) with labels (doc_id, label), from about max_docs of them."""
    n = labels.count()
    if n > max_docs:
        labels = labels.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    rows = _with_features(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("label", "text")).collect()
    return Classifier.fit(np.array([r.features for r in rows]).reshape(-1, N_FEATURES), np.array([float(r.label >= 0.5) for r in rows]))


def strength(groups: DataFrame, prior: str) -> float:
    """Pseudo-documents of the prior, by moments: groups (n, a) about their prior rates."""
    got = groups.filter("n > 0").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("a") / F.col("n") - F.col(prior), 2)).alias("between"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("within"), F.count("*").alias("k")
    ).first()
    if not got.n:
        return 1.0
    noise = got.within / got.n
    excess = got.between / got.n - noise * got.k / got.n
    return float(min(1e6, max(1.0, noise / excess - 1))) if excess > 1e-12 else 1e6


def judge(docs: DataFrame, labels: DataFrame, host_col: str, path_col: str, label_col: str = "quality", threshold: float = THRESHOLD, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """doc_id, host, path, p_document, p_host, p_path, p_others, p_quality and kept of each document.

    p_host and p_path are the posteriors of its host and path; p_others is
    p_path without the document itself, and the one that moves p_quality.
    """
    spark = prepare(docs.sparkSession)
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    labels = materialise(labels, "labels")
    shared = spark.sparkContext.broadcast(fit(docs, labels, max_docs))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    narrow = docs.select("doc_id", text(host_col).alias("host"), text(path_col).alias("path"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(3)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shared.value(x), pa.float64())], ["doc_id", "host", "path", "p_document"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(run, f"doc_id {kind}, host string, path string, p_document double").join(labels, "doc_id", "left")
    weight = F.when(F.col("label").isNotNull(), 1.0).otherwise(UNLABELLED)
    scored = scored.withColumn("w", weight).withColumn("e", F.col("w") * F.coalesce("label", "p_document")).drop("label")
    scored = materialise(scored, "scored")
    paths = materialise(scored.groupBy("host", "path").agg(F.sum("w").alias("n"), F.sum("e").alias("a")), "paths")
    all_ = paths.agg(F.sum("n").alias("n"), F.sum("a").alias("a")).first()
    rate = min(1 - 1e-6, max(1e-6, (all_.a + 0.5) / (all_.n + 1))) if all_.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("a").alias("a_host"))
    of_hosts = strength(hosts.select(F.col("n_host").alias("n"), F.col("a_host").alias("a"), F.lit(rate).alias("rate")), "rate")
    shrunk = lambda a, n, k, prior: (a + k * prior) / (n + k)
    sites = materialise(paths.join(hosts, "host").withColumn("p_host", shrunk(F.col("a_host"), F.col("n_host"), of_hosts, rate)), "sites")
    of_paths = strength(sites, "p_host")
    sites = sites.withColumn("p_path", shrunk(F.col("a"), F.col("n"), of_paths, F.col("p_host")))
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites
    logit = lambda c: F.log(F.greatest(F.lit(1e-6), c) / F.greatest(F.lit(1e-6), 1 - c))
    others = lambda c, own: F.greatest(F.lit(0.0), F.col(c) - F.col(own))
    host = shrunk(others("a_host", "e"), others("n_host", "w"), of_hosts, rate)
    out = scored.join(sites, ["host", "path"]).withColumn("p_others", shrunk(others("a", "e"), others("n", "w"), of_paths, host))
    moved = logit(F.col("p_document")) + logit(F.col("p_others")) - float(np.log(rate / (1 - rate)))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-moved)))
    return out.select("doc_id", "host", "path", "p_document", "p_host", "p_path", "p_others", "p_quality", (F.col("p_quality") >= threshold).alias("kept"))
