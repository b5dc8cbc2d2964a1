"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word
falls back to its character n-grams, the longest known ones first: each
position takes the longest n-gram from there that the model knows.

The model is fitted on a bounded sample of labelled documents and has all the
words and n-grams of the sample that are seen often enough in it; prediction
covers every whole text.

Defined results: null texts and texts without a letter are `und` with score
0; without any labelled document all texts are `und`; repeated rows are
predicted alike; an empty table gives an empty result; ties go to the first
language in alphabetical order; columns besides id, text and lang are ignored
or kept.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.llm import texts as T
from hayrake.session import prepare

#: At most about so many labelled documents are used for fitting (a hash of the id chooses them).
MAX_TRAIN_DOCS = 6000
#: A word of the model is seen at least so often in the sample, an n-gram of several characters so often.
LEAST_WORD = 2
LEAST_GRAM = 3
LONGEST = 5
#: Words of evidence that count in full towards the score; of more, the mean evidence of so many.
EVIDENCE = 40
#: Bytes of the words that a worker remembers, and what stands between blanks and holds other characters than ASCII and Latin-1 (up to so many characters).
REMEMBERED_BYTES = 64 << 20
REMEMBERED_FORMS = 50_000
LONGEST_FORM = 64
WORD = re.compile(r"[^\W\d_]+")
UND = "und"

_predictors: dict[str, Predictor] = {}


class Model:
    """Languages, log frequencies of words and of n-grams by language: numbers of the rows of two tables."""

    def __init__(self, languages: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray, name: str = "") -> None:
        self.languages, self.words, self.word_logs, self.grams = languages, words, word_logs, grams
        self.gram_logs = np.concatenate([gram_logs, np.full((1, len(languages)), -12.0)])  # the last: no known character
        self.name = name or uuid.uuid4().hex

    def parts(self) -> tuple:
        return self.languages, self.words, self.word_logs, self.grams, self.gram_logs[:-1], self.name

    @classmethod
    def fit(cls, counts: pa.Table) -> Model:
        """From columns lang, word and n."""
        names, said = counts["lang"].combine_chunks().dictionary_encode(), counts["word"].combine_chunks().dictionary_encode()
        languages = sorted(names.dictionary.to_pylist())
        column = np.array([languages.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)
        number = {w: k for k, w in enumerate(said.dictionary.to_pylist())}
        by_word = np.zeros((len(number), len(languages)))
        np.add.at(by_word, (said.indices.to_numpy(), column[names.indices.to_numpy()]), counts["n"].to_numpy())

        def logs(table: dict[str, int], n: np.ndarray, least: int) -> tuple[list[str], np.ndarray]:
            kept = np.flatnonzero(n.sum(axis=1) >= least)
            names = list(table)
            return [names[k] for k in kept.tolist()], np.log((n[kept] + 0.5) / (n.sum(axis=0) + 0.5 * len(kept)))

        words, word_logs = logs(number, by_word, LEAST_WORD)
        grams: list[str] = []
        tables = [np.zeros((0, len(languages)))]
        padded = [f" {w} " for w in number]
        for size in range(1, LONGEST + 1):
            own: dict[str, int] = {}
            code = np.fromiter((own.setdefault(w[i : i + size], len(own)) for w in padded for i in range(len(w) - size + 1)), dtype=np.int64)
            of = np.repeat(np.arange(len(padded)), np.fromiter((max(0, len(w) - size + 1) for w in padded), dtype=np.int64))
            n = np.column_stack([np.bincount(code, by_word[of, k], len(own)) for k in range(len(languages))]) if languages else np.zeros((0, 0))
            names, table = logs(own, n, 1 if size == 1 else LEAST_GRAM)
            grams += names
            tables.append(table)
        return cls(languages, {w: k for k, w in enumerate(words)}, word_logs, {g: k for k, g in enumerate(grams)}, np.concatenate(tables))

    def word(self, word: str) -> np.ndarray:
        """Log evidence of a lower-case word."""
        known = self.words.get(word)
        if known is not None:
            return self.word_logs[known]
        padded, found, at, grams = f" {word} ", [], 0, self.grams
        last = len(padded) - 1
        while at < last:
            size = min(LONGEST, last + 1 - at)
            while size > 1 and padded[at : at + size] not in grams:
                size -= 1
            found.append(self.gram_logs[grams.get(padded[at : at + size], -1)])
            at += max(1, size - 1)
        return sum(found[1:], found[0]) * (1.5 / len(found))

    def form(self, form: str) -> np.ndarray:
        """Evidence and number of words of a written form (what stands between blanks)."""
        out = np.zeros(len(self.languages) + 1)
        for w in WORD.findall(form.lower()):
            if w.isalpha() or any(map(str.isalpha, w)):  # else superscripts and the like only
                out[:-1] += self.word(w)
                out[-1] += 1
        return out


class Predictor:
    """Predicts whole columns: words of ASCII and Latin-1 letters in bulk, others by the model's own functions."""

    def __init__(self, model: Model) -> None:
        self.model = model
        plain = {g: k for g, k in model.grams.items() if all(c < "\x7f" or "ß" <= c <= "ÿ" for c in g)}
        self.gram = T.Numbers(np.array([int.from_bytes(g.encode("latin-1"), "little") for g in plain], dtype=np.uint64))
        self.gram_row = np.array([*plain.values(), -1], dtype=np.int64)
        self.places = T.Remembered(REMEMBERED_BYTES // (24 + 8 * max(1, len(model.languages))))
        self.values = np.zeros((len(self.places.keys), len(model.languages)))
        self.forms: dict[str, np.ndarray] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """Log evidence of lower-case words of ASCII and Latin-1 letters."""
        rows = np.array([self.model.words.get(w, -1) for w in words], dtype=np.int64)
        out = self.model.word_logs[rows] if len(self.model.word_logs) else np.zeros((len(words), len(self.model.languages)))
        other = np.flatnonzero(rows < 0)
        if not len(other):
            return out
        raw = f" {' '.join([words[k] for k in other.tolist()])} ".encode("latin-1")
        data = np.frombuffer(raw + bytes(8), dtype=np.uint8)
        blanks = np.flatnonzero(data == 32)
        at, last = blanks[:-1], blanks[1:]
        eight = np.ndarray((len(raw),), "<u8", buffer=data, strides=(1,))
        size, row = np.ones(len(raw), dtype=np.int64), np.full(len(raw), -1, dtype=np.int64)
        left = np.arange(len(raw))
        for n in range(LONGEST, 0, -1):  # a longer n-gram than the word has a blank inside: none is known
            found = self.gram(eight[left] & np.uint64((1 << 8 * n) - 1))
            hit = found != self.gram.none
            size[left[hit]], row[left[hit]] = n, self.gram_row[found[hit]]
            left = left[~hit]
        total, count, live = np.zeros((len(other), out.shape[1])), np.zeros(len(other)), np.arange(len(other))
        while len(live):
            total[live] += self.model.gram_logs[row[at]]
            count[live] += 1
            at = at + np.maximum(1, size[at] - 1)
            go = at < last[live]
            at, live = at[go], live[go]
        out[other] = total * (1.5 / count)[:, None]
        return out

    def form(self, form: str) -> np.ndarray:
        got = self.forms.get(form)
        if got is None:
            got = self.model.form(form)
            if len(form) <= LONGEST_FORM:
                if len(self.forms) >= REMEMBERED_FORMS:
                    self.forms.clear()
                self.forms[form] = got
        return got

    def __call__(self, column: pa.Array) -> list[tuple[str, float]]:
        data, offsets = T.text_bytes(column)
        total = np.zeros((len(column), len(self.model.languages) + 1))
        for a, z in T.pieces(data, offsets, T.NOT_BLANK) if self.model.languages else ():
            part = data[a:z]
            lo, hi = np.searchsorted(offsets, a), np.searchsorted(offsets, z)
            s, e, kind, low = T.units(part, np.unique(offsets[lo:hi] - a))
            own = np.flatnonzero(kind == T.LETTER)
            s, e, s_odd, e_odd = s[own], e[own], s[kind == T.ODD], e[kind == T.ODD]
            keys, place, hit = self.places.find(low, s, e - s)
            found = self.values[place]
            new = np.flatnonzero(~hit)
            if len(new):
                first, back = T.distinct(keys[new])
                first = new[first]
                raw = low.tobytes()
                made = self.words([raw[x:y].decode() for x, y in zip(s[first].tolist(), e[first].tolist())])
                found[new] = made[back]
                put = self.places.put(keys[first], place[first])
                self.values[place[first[put]]] = made[put]
            row = np.searchsorted(offsets, s + a, side="right") - 1
            for c in range(found.shape[1]):
                total[:, c] += np.bincount(row, found[:, c], len(column))
            total[:, -1] += np.bincount(row, minlength=len(column))
            for x, y, r in zip(s_odd.tolist(), e_odd.tolist(), (np.searchsorted(offsets, s_odd + a, side="right") - 1).tolist()):
                total[r] += self.form(part[x:y].tobytes().decode())
        return [self._said(x) for x in total]

    def _said(self, total: np.ndarray) -> tuple[str, float]:
        n = total[-1]
        if not n or not self.model.languages:
            return UND, 0.0
        logs = total[:-1] * (min(n, EVIDENCE) / n)
        best = int(np.argmax(np.round(logs, 9)))
        return self.model.languages[best], 1.0 / sum(math.exp(min(0.0, x - logs[best])) for x in logs)


def forget() -> None:
    _predictors.clear()


def predictor(parts: tuple) -> Predictor:
    """The predictor of a model, which a worker keeps from task to task."""
    if parts[-1] not in _predictors:
        _predictors.clear()
        _predictors[parts[-1]] = Predictor(Model(*parts))
    return _predictors[parts[-1]]


def fit(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """The model of (doc_id, text, lang) rows, from a sample of about max_docs of them."""
    labelled = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    n = labelled.select("lang").count()
    if n > max_docs:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(batch.column(1), batch.column(2).to_pylist()):
                counts.update((lang, w) for w in WORD.findall(text.as_py().lower()))
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": pa.array(counts.values(), pa.int64())})

    counts = labelled.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model.fit(counts.toArrow())  # words of the sample only


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score as new last columns (columns of these names are replaced)."""
    spark = prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    at, names = docs.columns.index("text"), docs.columns
    shared = spark.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.begin("langid", forget)
        own = predictor(shared.value)
        for batch in batches:
            found = own(batch.column(at))
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, "lang_pred", "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, kind + ", lang_pred string, score double")


def held_out() -> F.Column:
    """Whether a document stays out of fitting: crc32 of its id as text, modulo 5, is 0 (a null id: text '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def accept(docs: DataFrame, least_score: float = 0.5, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """docs whose language is recognised: not `und`, and with at least that score."""
    model = fit(docs.filter(~held_out()), max_docs)
    names = docs.columns
    marked = predict(docs.select(*[F.col(c).alias(f"c{k}") if c in ("lang_pred", "score") else F.col(c) for k, c in enumerate(names)]), model)
    kept = marked.filter((F.col("lang_pred") != UND) & (F.col("score") >= least_score))
    return kept.select(*[F.col(f"c{k}").alias(c) if c in ("lang_pred", "score") else F.col(c) for k, c in enumerate(names)])
