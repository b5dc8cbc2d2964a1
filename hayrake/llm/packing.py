"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Pieces of one length are interchangeable, so the packing is planned on the
histogram of lengths (at most ``capacity`` counts, whatever the corpus size)
and executors look their pieces' places up by rank within the length:

* large-item matching: pieces above a third of the capacity pair at most
  twice per sequence, the longest first with the longest partner that fits;
* smaller pieces go, longest first, to the sequence with the least
  sufficient room (best fit), or open a new one.

Nothing but the histogram reaches the driver. Defined results: null text is
an empty document (the end-of-document id only); an empty table gives an
empty result; repeated rows are packed once for each row; only documents
longer than the capacity are cut; columns besides id and text are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hayrake.llm import texts as T
from hayrake.session import materialise, prepare

CAPACITY = 2048
#: Classes of equal length are dealt over so many tasks.
SALTS = 64
#: Places for words in each worker's memory (some 50 bytes each), and ids of a word that have room there.
PLACES = 1 << 20
WIDTH = 10
#: What stands between blanks and goes to the tokenizer itself is remembered too: at most twice so many, up to so many characters each.
REMEMBERED = 50_000
LONGEST_FORM = 64
#: Files whose words are merged here (fixed values of the format): NFC, white space dropped, lower case; letters, single digits, runs of other marks.
WORD_BPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    "added": [],
}

_tokenizers: dict[str, WordIds] = {}


class Merges:
    """Byte-pair merges of many words at once, for vocabularies of bytes with an end-of-word mark."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str) -> None:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        sign = [chr(b if b in plain else next(other)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in sign], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in sign], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.numbers = T.Numbers(np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.uint64))
        self.none = self.numbers.none
        self.made = np.array([*(vocab[a + b] for a, b in pairs), 0], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; none for what is no pair."""
        return self.numbers((a << 20 | b).ravel().view(np.uint64)).reshape(a.shape)

    def __call__(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (one row a word) and their number, of rows of byte values, n of them each."""
        out, sizes = np.zeros_like(symbols, dtype=np.uint32), np.zeros(len(n), dtype=np.int64)
        columns = np.arange(symbols.shape[1])
        now = self.inner[symbols]
        row = np.arange(len(n))
        now[row, n - 1] = self.last[symbols[row, n - 1]]
        n = n.copy()
        rank = np.full(now.shape, self.none, dtype=np.int32)
        rank[:, :-1] = self.rank(now[:, :-1], now[:, 1:])
        rank[columns >= n[:, None] - 1] = self.none
        while len(row):
            at = rank.argmin(axis=1)
            k = np.arange(len(row))
            best = rank[k, at]
            done = best == self.none
            if done.any():
                out[row[done]], sizes[row[done]] = now[done], n[done]
                go = ~done
                row, now, n, rank, at, best = row[go], now[go], n[go], rank[go], at[go], best[go]
                k = k[: len(row)]
                if not len(row):
                    break
            now[k, at] = self.made[best]
            behind = columns[:-1] > at[:, None]
            now[:, :-1] = np.where(behind, now[:, 1:], now[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            n -= 1
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.rank(now[left, at[left] - 1], now[left, at[left]])
            rank[k, at] = self.none
            right = np.flatnonzero(at < n - 1)
            rank[right, at[right]] = self.rank(now[right, at[right]], now[right, at[right] + 1])
        return out, sizes


class WordIds:
    """Token ids of whole texts.

    The vocabulary's pre-tokenizer drops white space and never joins across
    it. Between blanks, runs of letters of ASCII and Latin-1, single digits
    and runs of ASCII marks are its words, whose ids are remembered by their
    exact bytes and found by merging many words at once. What stands between
    blanks and holds other characters, a contraction or a special token goes
    to the tokenizer itself, as all texts do for files of another kind.
    """

    def __init__(self, path: str, places: int = PLACES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        model = kind["model"]
        self.known = fingerprint(kind) == WORD_BPE
        if self.known:
            self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
            self.places = T.Remembered(places)
            self.ids = np.zeros((len(self.places.keys), WIDTH), dtype=np.uint16 if max(model["vocab"].values()) < 1 << 16 else np.uint32)
            self.sizes = np.zeros(len(self.places.keys), dtype=np.uint8)
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}

    def _odd(self, forms: list[str]) -> list[np.ndarray]:
        """Ids of what stands between blanks, by the tokenizer itself."""
        new = []
        for form in dict.fromkeys(forms):
            if form not in self.young:
                ids = self.old.get(form)
                if ids is None:
                    new.append(form)
                else:
                    self.young[form] = ids
        made = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        got = {f: np.asarray(e.ids, dtype=np.uint32) for f, e in zip(new, made)}
        ids = [got[f] if f in got else self.young[f] for f in forms]
        self.young |= {f: x for f, x in got.items() if len(f) <= LONGEST_FORM}
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return ids

    def _merged(self, low: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = np.zeros((len(s), T.UNIT_BYTES), dtype=np.uint32), np.zeros(len(s), dtype=np.int64)
        for least, most in ((1, 4), (5, 8), (9, 12), (13, 16), (17, T.UNIT_BYTES)):
            own = np.flatnonzero((n >= least) & (n <= most))
            for at in range(0, len(own), 1 << 14):
                k = own[at : at + (1 << 14)]
                out[k, :most], sizes[k] = self.merges(low[s[k][:, None] + np.arange(most)], n[k])
        return out, sizes

    def _piece(self, part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a piece, the starts of its units and where their ids begin (and one more: where they end)."""
        kind = T.KIND[part]
        quote, angle = np.flatnonzero(part[:-1] == 39), np.flatnonzero(part[:-1] == 60)
        odd = np.concatenate([quote[(kind[quote + 1] == T.LETTER) | (kind[quote + 1] == T.ODD)], angle[part[angle + 1] == 124]])
        s, e, kind, low = T.units(part, rows, odd)
        sizes = np.zeros(len(s), dtype=np.int64)
        plain, whole = np.flatnonzero(kind != T.ODD), np.flatnonzero(kind == T.ODD)
        n = (e - s)[plain]
        keys, place, hit = self.places.find(low, s[plain], n)
        new = np.flatnonzero(~hit)
        sizes[plain] = self.sizes[place]
        if len(new):
            first, back = T.distinct(keys[new])
            first = new[first]
            made, made_sizes = self._merged(low, s[plain[first]], n[first])
            sizes[plain[new]] = made_sizes[back]
        forms = self._odd([part[a:z].tobytes().decode() for a, z in zip(s[whole].tolist(), e[whole].tolist())]) if len(whole) else []
        sizes[whole] = [len(x) for x in forms]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(starts[-1]), dtype=np.uint32)

        def put(which: np.ndarray, table: np.ndarray, row: np.ndarray) -> None:
            column = 0
            while len(which):
                out[starts[which] + column] = table[row, column]
                column += 1
                more = sizes[which] > column
                which, row = which[more], row[more]

        put(plain[hit], self.ids, place[hit])
        if len(new):
            put(plain[new], made, back)
            short = np.flatnonzero(made_sizes <= WIDTH)
            own = short[self.places.put(keys[first[short]], place[first[short]])]
            at = place[first[own]]
            self.ids[at], self.sizes[at] = made[own, :WIDTH], made_sizes[own]
        if forms:
            where = np.repeat(starts[whole] - np.concatenate([[0], np.cumsum(sizes[whole])[:-1]]), sizes[whole])
            out[where + np.arange(len(where))] = np.concatenate(forms)
        return out, s, starts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where those of each text begin (and the last ones end)."""
        if not self.known:
            texts = [data[a:z].tobytes().decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids = [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, dtype=np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        found, bounds, total = [np.zeros(0, dtype=np.uint32)], np.zeros(len(offsets), dtype=np.int64), 0
        for a, z in T.pieces(data, offsets, T.NOT_BLANK):
            lo, hi = np.searchsorted(offsets, a), np.searchsorted(offsets, z)
            ids, s, starts = self._piece(data[a:z], np.unique(offsets[lo:hi] - a))
            bounds[lo:hi] = total + starts[np.searchsorted(s, offsets[lo:hi] - a)]
            total += len(ids)
            found.append(ids)
        bounds[np.searchsorted(offsets, len(data)) :] = total
        return np.concatenate(found), bounds


def fingerprint(kind: dict) -> dict:
    """What a tokenizer file says about normalising, splitting and merging."""
    said = {k: kind[k] for k in ("normalizer", "pre_tokenizer", "post_processor")}
    said["model"] = {k: v for k, v in kind["model"].items() if k not in ("vocab", "merges")}
    said["added"] = [t["content"] for t in kind["added_tokens"] if not (t["content"].startswith("<|") and t["special"])]
    return said


def forget() -> None:
    _tokenizers.clear()


def word_ids(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32 (and ids, on request)."""
    kind = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint".format(docs.schema["doc_id"].dataType.simpleString())
    kind += ", ids array<bigint>" if with_ids else ""
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.begin("packing", forget)
        words = word_ids(tokenizer)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            lists = []
            ids, bounds = words.encode(*T.text_bytes(batch.column(1)))
            raw, bounds = ids.astype("<u4", copy=False).tobytes(), bounds.tolist()
            for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
                for piece, at in enumerate(range(0, z - a + 1, capacity)):
                    part = raw[4 * (a + at) : 4 * min(z, a + at + capacity)]
                    if at + capacity > z - a:
                        part += tail
                    rows.append(k)
                    for c, v in zip(cols, (piece, at, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
                    if with_ids:
                        lists.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(lists, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Places for counts[length] pieces of each length.

    Returns, by length, runs (first rank, number, first sequence, offset):
    the piece of rank first + i goes to sequence first + i at that offset.
    Second: the number of sequences. The number of runs depends on the number
    of lengths, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is not within the capacity")
    total, done, runs = 0, dict.fromkeys(left, 0), {n: [] for n in left}
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, number)

    def put(n: int, k: int, sequence: int, offset: int) -> None:
        runs[n].append((done[n], k, sequence, offset))
        done[n] += k
        left[n] -= k

    large = sorted(n for n in left if 3 * n > capacity)
    for x in reversed(large):
        while left[x]:
            at = bisect.bisect_right(large, min(x, capacity - x)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == x else 1):
                at -= 1
            y = large[at] if at >= 0 else 0
            k = (left[x] // 2 if y == x else min(left[x], left[y])) if y else left[x]
            put(x, k, total, 0)
            if y:
                put(y, k, total, x)
            room.setdefault(capacity - x - y, []).append((total, k))
            total += k
    rooms = sorted(room)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                per = capacity // n
                k = -(-left[n] // per)
                first, gap = (total, capacity)
                total += k
                rest = 0
            else:
                gap = rooms[at]
                first, k = room[gap].pop()
                if not room[gap]:
                    del room[gap], rooms[at]
                rest = max(0, k - left[n])
                k -= rest
            if rest:
                if gap not in room:
                    bisect.insort(rooms, gap)
                room.setdefault(gap, []).append((first + k, rest))
            put(n, min(k, left[n]), first, capacity - gap)
            if gap - n not in room:
                bisect.insort(rooms, gap - n)
            room.setdefault(gap - n, []).append((first, k))
    return runs, total


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs all documents: their pieces with sequence_id and offset."""
    spark = prepare(docs.sparkSession)
    pieces = materialise(tokenise(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    pieces = pieces.withColumn("_salt", salt)
    counts: dict[int, dict[int, int]] = {}
    for n, s, c in pieces.groupBy("length", "_salt").count().collect():  # at most capacity * SALTS rows
        counts.setdefault(n, {})[s] = c
    runs, _ = plan({n: sum(c.values()) for n, c in counts.items()}, capacity)
    before = np.zeros((capacity + 1, SALTS), dtype=np.int64)
    for n, c in counts.items():
        before[n] = np.cumsum([0, *(c.get(s, 0) for s in range(SALTS - 1))])
    places = spark.sparkContext.broadcast((before, {n: np.array(r, dtype=np.int64) for n, r in runs.items()}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = places.value
        for batch in batches:
            n, s, rank = (batch.column(c).to_numpy() for c in ("length", "_salt", "_rank"))
            rank = rank - 1 + base[n, s]
            sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                own = np.flatnonzero(n == length)
                run = table[int(length)]
                at = np.searchsorted(run[:, 0], rank[own], side="right") - 1
                sequence[own], offset[own] = run[at, 2] + rank[own] - run[at, 0], run[at, 3]
            keep = [c for c in batch.schema.names if c not in ("_salt", "_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")).cast("bigint"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_salt")
    return ranked.mapInArrow(place, kind + ", sequence_id bigint, offset bigint")
