"""Best-fit packing with length patterns fitted by non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths (at most
``capacity`` bins, whatever the corpus) goes to the driver.  There the patterns of up to three long pieces that
fill a sequence are enumerated on a coarse length grid, non-negative least squares fits how often each repeats,
and the counts are rounded down.  A pattern is realised by lengths of its bins that fill the sequence to the last
token; what closes no sequence, and every short piece, is packed best-fit, longest first.  The plan is a list of runs over (length, rank);
executors look their pieces up in it.

Defined cases: null and empty texts are the one end token; equal texts and repeated rows are separate pieces; a
text longer than the capacity is cut into full pieces and a last shorter one; pieces of equal length tie and are ranked
by doc_id, piece and digest; an empty table packs to no rows; null ids stay null; no other column of the input,
whatever its name, is read.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, slices, table

CAPACITY = 4096
END_ID = 1
#: Beyond these characters, or where a special token may be spelt, the whole text goes through the tokenizer.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]|[\xb2\xb3\xb9\xbc-\xbe\u0130]|<\|")
#: The vocabulary's own pre-token pattern, for the characters that are left.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[\W_]+")
_MEMO_WORDS = 400_000
_MEMO_KEPT = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """Exact ids by looking words up in a memo of two bounded generations; only unseen pieces are encoded.

    The vocabulary never joins symbols across white space, and the last token of each pre-token is marked as a
    word end, so many pieces are encoded as one text and told apart by those marks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def forget(self) -> None:
        """Keep only the longest known words at a task's end: idle workers share their executor with other stages."""
        self.old_words, self.old_parts = {}, {}
        self.words, self.parts = (dict(islice(d.items(), _MEMO_KEPT)) for d in (self.words, self.parts))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_parts(self, parts: set[str]) -> None:
        if len(self.parts) > _MEMO_WORDS:
            self.old_parts, self.parts = self.parts, {}
        new = []
        for p in parts:
            known = self.old_parts.get(p)
            if known is None:
                new.append(p)
            else:
                self.parts[p] = known
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some):
                raw, lo = ids.tobytes(), 0
                for p, hi in zip(some, stops):
                    self.parts[p] = raw[4 * lo:4 * hi]
                    lo = hi
            else:
                self.parts.update((p, self.whole(p)) for p in some)

    def _learn_words(self, distinct: list[str]) -> list[bytes]:
        if len(self.words) > _MEMO_WORDS:
            self.old_words, self.words = self.words, {}
        words, out = self.words, []
        cut = {}
        for i, w in enumerate(distinct):
            known = words.get(w)
            if known is None:
                known = self.old_words.get(w)
                if known is None:
                    cut[i] = _PIECES.findall(w.lower())
                else:
                    words[w] = known
            out.append(known)
        parts = self.parts
        self._learn_parts({p for ps in cut.values() for p in ps if p not in parts})
        parts, old = self.parts, self.old_parts
        for i, ps in cut.items():
            out[i] = words[distinct[i]] = b"".join([parts[p] if p in parts else old[p] for p in ps])
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, without the end token."""
        plain = pa.array(["" if _UNUSUAL.search(t) else t for t in texts], pa.string())
        split = pc.utf8_split_whitespace(plain)
        encoded = split.flatten().dictionary_encode()
        ids = pa.array(self._learn_words(encoded.dictionary.to_pylist()), pa.large_binary()).take(encoded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[ids.offset:][np.asarray(split.offsets)].tolist() if data is not None and len(ids) else [0] * (len(texts) + 1)
        data = memoryview(data) if data is not None else b""
        return [bytes(data[lo:hi]) if p or not t else self.whole(t)
                for t, p, lo, hi in zip(texts, plain.to_pylist(), at, at[1:])]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    return _encoder(path)(texts)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def cut(batch: pa.RecordBatch):
        for part in slices(batch, "text", 12 << 20):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text").to_pylist(), tokenizer)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    for c, v in zip(cols, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.table([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names=names[:n])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), cut, schema,
                       lambda: _encoder(tokenizer).forget(), gather=12 << 20)


# == the plan, from a histogram


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    """argmin |ax - b| over x >= 0 by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram_b = a.T @ b
    scale = max(1.0, float(np.abs(gram_b).max(initial=0)))
    for _ in range(3 * a.shape[0] + 10):
        w = gram_b - a.T @ (a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol * scale:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            s, *_ = np.linalg.lstsq(a[:, on], b, rcond=None)
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300))
            x[on] = x[on] + step * (s - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


class Plan:
    """Runs of pieces: ranks [rank, rank+count) of a length go to sequences first, first+1, ... ``per`` in each."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.capacity = capacity
        self.left = histogram.astype(np.int64).copy()
        self.next_rank = np.zeros(capacity + 1, np.int64)
        self.space: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # free tokens -> groups [first, count]
        self.free = np.zeros(capacity + 1, np.int64)
        self.sequences = self.closed = 0  # closed: runs that patterns placed
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def _place(self, length: int, first: int, bins: int, per: int, offset: int) -> None:
        count = bins * per
        self.runs.append((length, int(self.next_rank[length]), count, first, per, offset))
        self.next_rank[length] += count
        self.left[length] -= count

    def _open(self, free: int, first: int, count: int) -> None:
        if free and count:
            self.space[free].append([first, count])
            self.free[free] += count

    def _take(self, free: int, count: int) -> tuple[int, int]:
        group = self.space[free][-1]
        k = min(count, group[1])
        first = group[0]
        group[0] += k
        group[1] -= k
        if not group[1]:
            self.space[free].pop()
        self.free[free] -= k
        return first, k

    def close(self, bins: list[np.ndarray], times: int) -> None:
        """Up to ``times`` sequences of one length from each of ``bins`` that fill the capacity to the last token."""
        def fill(parts: list[int], bins: list[np.ndarray]) -> None:
            nonlocal times
            rest = self.capacity - sum(parts)
            for n in bins[0][::-1].tolist() if len(bins) > 1 else [rest] if rest in bins[0] else []:
                if not times or n > rest or not self.left[n]:
                    continue
                if len(bins) > 1:
                    fill([*parts, n], bins[1:])
                    continue
                own, at = [*parts, n], 0
                k = min(times, *(int(self.left[m]) // own.count(m) for m in own))
                for m in own if k else ():
                    self._place(m, self.sequences, k, 1, at)
                    at += m
                self.sequences += k
                times -= k

        fill([], bins)

    def best_fit(self) -> None:
        """Pack what is left, longest first, each into the smallest space that holds it."""
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                count = int(self.left[length])
                fits = np.flatnonzero(self.free[length:])
                if len(fits):
                    free = length + int(fits[0])
                    per = free // length
                    if per > count:
                        per = count
                    first, k = self._take(free, count // per)
                else:
                    free = self.capacity
                    per = min(self.capacity // length, count)
                    k = count // per
                    first = self.sequences
                    self.sequences += k
                self._place(length, first, k, per, self.capacity - free)
                self._open(free - per * length, first, k)


def plan_packing(histogram: np.ndarray, capacity: int = CAPACITY, grid: int = 128, short: int = 16) -> Plan:
    """Fit patterns of up to three pieces from ``grid`` length bins, close them exactly, best-fit the rest.

    Pieces of fewer than ``short`` grid steps are in no pattern.  A closed sequence wastes nothing, so only the residual
    can, and it keeps all the short pieces, with which best fit fills the holes.
    """
    histogram = np.asarray(histogram, np.int64)
    plan = Plan(histogram, capacity)
    step = max(1, capacity // grid)
    bin_of = -(-np.arange(capacity + 1) // step)
    target = np.bincount(bin_of[:capacity], weights=histogram[:capacity])
    target[:short] = 0
    used = np.flatnonzero(target)
    patterns = _patterns(used, capacity / step)
    if patterns:
        row = {int(b): i for i, b in enumerate(used)}
        a = np.zeros((len(used), len(patterns)))
        for j, p in enumerate(patterns):
            for part in p:
                a[row[part], j] += 1
        weight = 1 / np.sqrt(np.maximum(target[used], 1))
        repeats = np.floor(nnls(a * weight[:, None], target[used] * weight) + 1e-9).astype(np.int64)
        members = {int(b): np.flatnonzero((bin_of == b) & (np.arange(capacity + 1) < capacity)) for b in used}
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] > 0:
                plan.close([members[b] for b in patterns[j]], int(repeats[j]))
    plan.closed = len(plan.runs)
    plan.best_fit()
    return plan


def _patterns(used: np.ndarray, full: float) -> list[tuple[int, ...]]:
    """Descending bins of one, two or three pieces whose mean lengths (half a step below the bin) make about ``full`` steps."""
    present = set(used.tolist())
    out = [(int(b),) for b in used if b >= full]
    for a in used[::-1].tolist():
        last = round(full + 1 - a)
        if last in present and last <= a:
            out.append((a, last))
        for b in used[used <= a].tolist():
            for total in {math.floor(full + 1.5), math.ceil(full + 1.5)}:
                c = total - a - b
                if c in present and c <= b:
                    out.append((a, b, c))
    return out


def ranked(cut: DataFrame, rows_per_bucket: int = 50_000) -> tuple[DataFrame, np.ndarray]:
    """Number the pieces of each length from 0, and the histogram.

    A length that a third of all pieces share is numbered in hash buckets whose offsets come from counts, so
    no window partition grows with the corpus.
    """
    total = cut.count()
    buckets = max(1, -(-total // rows_per_bucket))
    salted = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    first = counts.select("length", "_b", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_o"))
    histogram = np.zeros(CAPACITY + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        if r.length >= len(histogram):
            histogram = np.pad(histogram, (0, r.length + 1 - len(histogram)))
        histogram[r.length] = r.n
    own = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    out = (salted.withColumn("_r", own).join(first, ["length", "_b"], "left")
           .withColumn("rank", F.col("_r") + F.coalesce("_o", F.lit(0))).drop("_b", "_r", "_o"))
    return out, histogram


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to pieces; every piece is placed once, gapless from offset 0."""
    rows, histogram = ranked(cut)
    histogram = histogram[:capacity + 1] if len(histogram) > capacity + 1 else np.pad(histogram, (0, capacity + 1 - len(histogram)))
    plan = plan_packing(histogram, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    shared = cut.sparkSession.sparkContext.broadcast((runs[:, 0] * (1 << 44) + runs[:, 1], runs))
    names = [c for c in cut.columns]

    def place(batch: pa.RecordBatch):
        keys, plan_runs = shared.value
        length, rank = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "rank"))
        run = plan_runs[np.maximum(np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1, 0)] if len(rank) else np.zeros((0, 6), np.int64)
        j = rank - run[:, 1]
        per = np.maximum(run[:, 4], 1)
        yield pa.table([*(batch.column(c) for c in names), pa.array(run[:, 3] + j // per), pa.array(run[:, 5] + j % per * length)],
                       names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return map_batches(rows.select(*names, F.col("rank").cast("long").alias("rank")), place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once so that numbering sees the same rows as the plan."""
    cut = materialise(pieces(docs, tokenizer or default_tokenizer(), capacity, keep_ids=keep_ids), "pieces")
    return pack(cut, capacity)


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
