"""Exact substring deduplication over bytes by column-wise construction over many documents.

A byte goes if a string of ``WINDOW`` bytes that covers it starts anywhere else.  Equal windows have equal smallest
k-grams at equal places, so every window is filed under its anchor, the rightmost smallest k-gram in it, and can only
equal windows with the same anchor hash and the same distance to the anchor.  Anchors are about one in 170 bytes; a
hash seen once has no equal window.  Runs of windows with the same anchor form one context; contexts that occur twice
as a whole are settled by their 128-bit hash.  The others of each anchor group are strings of at most 736 bytes,
aligned at the anchor, and are settled by column-wise construction: from the last column to the first, one symbol per
string is inserted into the sorted collection, whose order, next symbols (its Burrows-Wheeler slice) and longest
common prefixes follow from the round before by one sequential pass; a window repeats if a neighbour shares a prefix
of at least ``WINDOW``.  The columns of a batch are sequential buffers of bounded size instead of disk files, because
the batch is cut to fit; a group above ``ROWS`` contexts never comes to one task: its window hashes are counted.

Passages of more than 50 words may be shorter than ``WINDOW`` bytes.  They are reported beside the removed bytes:
``n_repeated_words`` counts the words covered by runs of ``WORDS`` words (separated by ASCII white space, exactly as
written) that another doc_id holds too; the same anchors, over words, find them.

Defined cases: null text is empty; shorter texts lose nothing; equal texts of at least ``WINDOW`` bytes lose all;
overlaps and matches inside one document count for bytes, matches never cross documents, and strings are judged on the
input; ids may be null or repeated (for repeated words, rows without an id are one document); texts of any length are
read whole; ties do not matter, every equal string being treated alike; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, release, ship, slices, table
from .neardup import _word_hashes

WINDOW = 400
GRAM = 64
SPAN = WINDOW - GRAM  # an anchor lies at most this far behind the start of its windows
#: A repeated passage of words, and its anchors.
WORDS, WORD_GRAM = 51, 8
ROWS = 8192
_POSITION = 23
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return (h ^ (h >> np.uint64(29))) * _B


class _Rolling:
    """Prefix sums of a polynomial hash modulo 2**64 with random byte values; any range's hash in O(1)."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << int(n).bit_length()
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse, np.uint64)]), dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Over bytes, or over symbols that are hashes already."""
        self.powers(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum((self.values[data] if data.dtype == np.uint8 else data) * self.up[:len(data)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((prefix[end] - prefix[start]) * self.down[start])


@lru_cache(maxsize=1)
def _rollings() -> tuple[_Rolling, _Rolling]:
    return _Rolling(0x5851F42D4C957F2D, 1), _Rolling(0x14057B7EF767814F, 2)


def anchors(data: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For documents one after another in ``data``: (doc, anchor, first window, last window, h, c1, c2) of each run
    of windows with one anchor; positions are absolute in ``data``."""
    none = np.zeros(0, np.int64)
    n, span = len(data), window - gram
    if n < window:
        return none, none, none, none, none, none, none
    one, two = _rollings()
    p1 = one.prefix(data)
    m = n - gram + 1
    h = _mix((p1[gram:] - p1[:m]) * one.down[:m])
    mask = np.uint64((1 << _POSITION) - 1)
    key = (h & ~mask) | (mask - np.arange(m, dtype=np.uint64))
    width = span + 1
    padded = np.full(-(-(m + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - window + 1
    low = np.minimum(after[:windows], before[width - 1:width - 1 + windows])
    anchor = (mask - (low & mask)).astype(np.int64)
    sizes = np.diff(starts)
    valid = np.zeros(n + 1, np.int32)
    long = sizes >= window
    np.add.at(valid, starts[:-1][long], 1)
    np.add.at(valid, starts[1:][long] - window + 1, -1)
    ok = np.cumsum(valid)[:windows] > 0
    doc_start = np.zeros(n + 1, bool)
    doc_start[starts[:-1]] = True
    change = np.ones(windows, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1]) | doc_start[1:windows]
    first = np.flatnonzero(change)
    last = np.append(first[1:], windows) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    a = anchor[first]
    doc = np.searchsorted(starts, first, side="right") - 1
    p2 = two.prefix(data)
    shape = (_mix(((a - first).astype(np.uint64) << np.uint64(20)) | (a - last).astype(np.uint64)))
    c1 = one.ranges(p1, first, last + window) ^ shape
    c2 = two.ranges(p2, first, last + window) + shape
    return doc, a, first, last, h[a].view(np.int64), c1.view(np.int64), c2.view(np.int64)


#: kind 0: an anchor with its context; kind 1: windows [at, c1] that repeat inside their own document; kind 2: an
#: anchor over words with its context.
_ANCHORS = "kind tinyint, h long, c1 long, c2 long, o1 long, o2 long, d long, at long, lo int, hi int, n int"
_KINDS = [pa.int8(), *[pa.int64()] * 7, pa.int32(), pa.int32(), pa.int32()]


def owners(docs: DataFrame) -> DataFrame:
    """The text's bytes, its owner (o1, o2), 128 bits of hash computed where the text is read, and the document d."""
    text = F.coalesce("text", F.lit(""))
    return (docs.withColumn("_bytes", text.cast("binary")).withColumn("o1", F.xxhash64(text)).withColumn("o2", F.xxhash64(F.lit(0x5DEECE66D), text))
            .withColumn("d", F.xxhash64(F.col("doc_id").cast("long"))))


#: Texts that can hold a repeated string or passage.
_ABLE = f"octet_length(_bytes) >= {min(WINDOW, 2 * WORDS - 1)}"


def anchor_rows(docs: DataFrame) -> DataFrame:
    source = owners(docs).where(_ABLE).select("o1", "o2", "d", "_bytes")

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "_bytes", 1 << 20):
            raw = part.column("_bytes").to_pylist()
            groups, size = [[]], 0
            for k, r in enumerate(raw):  # positions must fit their bits; a longer text is alone and told apart by blocks
                if size + len(r) >= (1 << _POSITION) and groups[-1]:
                    groups.append([])
                    size = 0
                groups[-1].append(k)
                size += len(r)
            own = [np.asarray(part.column(c)) for c in ("o1", "o2", "d")]
            for g in groups:
                for base, at, texts in _cuts(g, raw):
                    yield _anchor_table(base, texts, *(x[at] for x in own))
            hashes, starts = word_hashes(part.column("_bytes"))
            for base, at, lo, hi in _word_cuts(starts):
                yield _word_table(base, hashes[lo:hi], np.clip(starts[at] - lo, 0, hi - lo), *(x[at[:-1]] for x in own))

    return map_batches(source, run, _ANCHORS)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of every text, and where each text starts; ``texts`` are UTF-8 bytes."""
    as_text = pa.Array.from_buffers(pa.string() if texts.type == pa.binary() else pa.large_string(), len(texts), texts.buffers(), offset=texts.offset)
    split = pc.ascii_split_whitespace(as_text)
    encoded = split.flatten().dictionary_encode()
    hashes = _word_hashes(encoded.dictionary)
    hashes[np.asarray(pc.binary_length(encoded.dictionary)) == 0] = 0
    flat = hashes[np.asarray(encoded.indices)] if len(encoded) else np.zeros(0, np.uint64)
    offsets = np.asarray(split.offsets).astype(np.int64)
    real = np.concatenate([[0], np.cumsum(flat != 0)])  # leading and trailing white space give empty words
    return flat[flat != 0], real[offsets - offsets[0]]


def _word_cuts(starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(base, texts' numbers with one more at the end, first word, last word) of runs whose positions fit their bits."""
    limit, k, n = (1 << _POSITION) - 1, 0, len(starts) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(starts, starts[k] + limit, side="right")) - 1)
        lo, hi = int(starts[k]), int(starts[stop])
        if hi - lo <= limit:
            yield 0, np.arange(k, stop + 1), lo, hi
        else:
            for at in range(lo, hi - WORDS + 1, limit - WORDS + 1):
                yield at - lo, np.array([k, k + 1]), at, min(hi, at + limit)
        k = stop


def _cuts(group: list[int], raw: list[bytes]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Texts to process together; a text too long for the position bits in pieces that overlap by a window less one."""
    limit = (1 << _POSITION) - 1
    if len(group) == 1 and len(raw[group[0]]) > limit:
        text = raw[group[0]]
        for at in range(0, len(text) - WINDOW + 1, limit - WINDOW + 1):
            yield at, group, [text[at:at + limit]]
    elif group:
        yield 0, group, [raw[k] for k in group]


def _anchor_table(base: int, texts: list[bytes], o1: np.ndarray, o2: np.ndarray, d: np.ndarray) -> pa.Table:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    doc, a, first, last, h, c1, c2 = anchors(np.frombuffer(b"".join(texts), np.uint8), starts)
    same = _mix(_mix(h.view(np.uint64) ^ _mix(c1.view(np.uint64))) + c2.view(np.uint64) + doc.astype(np.uint64) * _A)
    _, at, inverse, counts = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    lo, hi = (a - last).astype(np.int32), (a - first).astype(np.int32)
    relative = starts[doc] - base
    one = [np.zeros(len(at), np.int8), h[at], c1[at], c2[at], o1[doc[at]], o2[doc[at]], d[doc[at]], (a - relative)[at], lo[at], hi[at], counts.astype(np.int32)]
    again = np.flatnonzero(counts[inverse] > 1)
    s, e, own = first[again], last[again], doc[again]
    if len(again):
        new = np.concatenate([[True], (s[1:] != e[:-1] + 1) | (own[1:] != own[:-1])])
        k = np.flatnonzero(new)
        s, e, own = s[k], e[np.append(k[1:], len(e)) - 1], own[k]
    zero = np.zeros(len(s), np.int64)
    shift = starts[own] - base if len(s) else zero
    runs = [np.ones(len(s), np.int8), zero, e - shift, zero, o1[own], o2[own], d[own], s - shift, *[zero.astype(np.int32)] * 3]
    names = [f.split()[0] for f in _ANCHORS.split(", ")]
    return pa.table([pa.array(np.concatenate([x, y]), t) for x, y, t in zip(one, runs, _KINDS)], names=names)


def _word_table(base: int, hashes: np.ndarray, starts: np.ndarray, o1: np.ndarray, o2: np.ndarray, d: np.ndarray) -> pa.Table:
    doc, a, first, last, h, c1, c2 = anchors(hashes, starts, WORDS, WORD_GRAM)
    n = len(doc)
    columns = [np.full(n, 2, np.int8), h, c1, c2, o1[doc], o2[doc], d[doc], a - starts[doc] + base, (a - last).astype(np.int32), (a - first).astype(np.int32), np.ones(n, np.int32)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=[f.split()[0] for f in _ANCHORS.split(", ")])


def column_wise(group: np.ndarray, contexts: list[bytes], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For strings aligned at their anchors: (rows, SPAN+1) flags of window starts, by distance SPAN..0 to the anchor,
    that another string of the same group shares; ``group`` is sorted."""
    n, columns = len(contexts), SPAN + WINDOW
    begin, end = SPAN - hi, SPAN - lo + WINDOW
    symbols = np.zeros((columns, n), np.uint8)  # one sequential buffer per round
    for i, c in enumerate(contexts):
        symbols[begin[i]:end[i], i] = np.frombuffer(c, np.uint8)
    repeated = np.zeros((n, SPAN + 1), bool)
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int32)
    entering = np.argsort(-end, kind="stable")
    next_in = 0
    group_key = group.astype(np.int64) << 8
    for c in range(int(end.max(initial=0)) - 1, int(begin.min(initial=0)) - 1, -1):
        fresh = next_in
        while next_in < n and end[entering[next_in]] == c + 1:
            next_in += 1
        new = entering[fresh:next_in]
        rows = np.concatenate([new, order])
        if c < SPAN and not (begin <= c).all():
            live = begin[rows] <= c
        else:
            live = None
        at = np.arange(len(rows)) if live is None else np.flatnonzero(live)
        key = group_key[rows[at]] | symbols[c][rows[at]]
        by = at[np.argsort(key, kind="stable")]
        sorted_key = group_key[rows[by]] | symbols[c][rows[by]]
        fresh_lcp = np.zeros(len(by), np.int32)
        if len(by) > 1:
            pair = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
            u, v = by[pair - 1], by[pair]
            all_lcp = np.concatenate([np.zeros(len(new), np.int32), lcp])
            shared = np.zeros(len(pair), np.int32)
            old = np.flatnonzero(u >= len(new))
            step = v[old] - u[old]
            near = old[step == 1]
            shared[near] = all_lcp[v[near]]
            far = old[step > 1]
            if len(far):
                edges = np.empty(2 * len(far), np.int64)
                edges[0::2], edges[1::2] = u[far] + 1, v[far] + 1
                shared[far] = np.minimum.reduceat(np.append(all_lcp, 0), edges)[0::2]
            fresh_lcp[pair] = np.minimum(shared + 1, WINDOW)
        order, lcp = rows[by], fresh_lcp
        if c <= SPAN:
            hit = np.flatnonzero(lcp >= WINDOW)
            if len(hit):
                repeated[order[hit], c] = True
                repeated[order[hit - 1], c] = True
    return repeated


#: What a text gives in the second pass: contexts, or windows of words (h null; n = 1: held by two documents as known).
_CONTEXTS = "h long, o1 long, o2 long, d long, at long, lo int, hi int, n long, m long, context binary, w1 long, w2 long"
_CONTEXT_TYPES = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_CONTEXT_NAMES = [f.split()[0] for f in _CONTEXTS.split(", ")]
_RUNS = "o1 long, o2 long, first long, last long"


def flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the maximal runs of true flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return row, first, stop - 1


def _settle(rows: int):
    """The mapper over contexts sorted by (h, o1, o2, at), groups of at most ``rows``: column-wise, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def settle(part: list[dict]):
            h, at, lo, hi, n, o1, o2 = (np.array([r[k] for r in part], np.int64) for k in ("h", "at", "lo", "hi", "n", "o1", "o2"))
            _, group = np.unique(h, return_inverse=True)
            flags = column_wise(np.sort(group), [r["context"] for r in part], lo, hi) if len(part) > 1 else np.zeros((len(part), SPAN + 1), bool)
            flags[n > 1] = False  # settled as a whole
            row, a, b = flag_runs(flags)
            yield pa.RecordBatch.from_arrays([pa.array(o1[row]), pa.array(o2[row]), pa.array(at[row] - SPAN + a), pa.array(at[row] - SPAN + b)],
                                             names=["o1", "o2", "first", "last"])

        previous = None
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["h"], r["o1"], r["o2"], r["at"])
                if own == previous:
                    continue  # a repeated row of the same document
                previous = own
                if held and r["h"] != held[-1]["h"] and len(held) >= rows // 2:
                    yield from settle(held)
                    held = []
                held.append(r)
        if held:
            yield from settle(held)

    return run


def _by_window(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of repeated windows in groups too large for one batch, by counting 128-bit window hashes; and their table."""
    def run(batch: pa.RecordBatch):
        one, two = _rollings()
        for r in batch.to_pylist():
            data = np.frombuffer(r["context"], np.uint8)
            count = r["hi"] - r["lo"] + 1
            s = np.arange(count)
            w1 = one.ranges(one.prefix(data), s, s + WINDOW).view(np.int64)
            w2 = two.ranges(two.prefix(data), s, s + WINDOW).view(np.int64)
            k = lambda v, t=pa.int64(): pa.array(np.full(count, v), t)
            yield pa.table([pa.array(w1), pa.array(w2), k(r["h"]), k(r["o1"]), k(r["o2"]), pa.array(r["at"] - r["hi"] + s), k(r["n"])],
                           names=["w1", "w2", "h", "o1", "o2", "first", "n"])

    one_each = hot.dropDuplicates(["h", "o1", "o2", "at"])  # rows of one document that are repeated
    windows = materialise(map_batches(one_each, run, "w1 long, w2 long, h long, o1 long, o2 long, first long, n long"), "substr-windows")
    many = windows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2")
    return windows.where("n = 1").join(many, ["w1", "w2"]).select("o1", "o2", "first", F.col("first").alias("last")), windows


def _second_pass(batch: pa.RecordBatch):
    """The contexts and windows of words that are wanted of each text."""
    one, two = _rollings()
    for part in slices(batch, "_bytes"):
        wanted = part.column("wanted").to_pylist()
        o1, o2, d = (part.column(c).to_pylist() for c in ("o1", "o2", "d"))
        cols: list[list] = [[] for _ in range(10)]
        for k, (data, own) in enumerate(zip(part.column("_bytes").to_pylist(), wanted)):
            for w in own:
                if w["kind"] == 0:
                    start, stop = w["at"] - w["hi"], w["at"] - w["lo"] + WINDOW
                    for c, v in zip(cols, (w["h"], o1[k], o2[k], d[k], w["at"], w["lo"], w["hi"], w["n"], w["m"], data[start:stop])):
                        c.append(v)
        empty = pa.nulls(len(cols[0]), pa.int64())
        yield pa.table([*(pa.array(c, t) for c, t in zip(cols, _CONTEXT_TYPES)), empty, empty], names=_CONTEXT_NAMES)
        some = [k for k, own in enumerate(wanted) if any(w["kind"] == 2 for w in own)]
        if not some:
            continue
        hashes, starts = word_hashes(part.column("_bytes").take(pa.array(some)))
        who, at, across, h1, h2 = [], [], [], [], []
        for j, k in enumerate(some):
            own = hashes[starts[j]:starts[j + 1]]
            p1, p2 = one.prefix(own), two.prefix(own)
            for w in wanted[k]:
                if w["kind"] == 2:
                    s = np.arange(w["at"] - w["hi"], w["at"] - w["lo"] + 1)
                    at.append(s)
                    h1.append(one.ranges(p1, s, s + WORDS))
                    h2.append(two.ranges(p2, s, s + WORDS))
                    who.append(np.full(len(s), k))
                    across.append(np.full(len(s), w["n"]))
        who, at = np.concatenate(who), np.concatenate(at)
        own = [pa.array(np.asarray(part.column(c))[who]) for c in ("o1", "o2", "d")]
        none = lambda t: pa.nulls(len(who), t)
        yield pa.table([none(pa.int64()), *own, pa.array(at), none(pa.int32()), none(pa.int32()), pa.array(np.concatenate(across)), none(pa.int64()), none(pa.binary()),
                        pa.array(np.concatenate(h1).view(np.int64)), pa.array(np.concatenate(h2).view(np.int64))], names=_CONTEXT_NAMES)


def _byte_contexts(every: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(runs settled by equal contexts, the contexts that the second pass must cut, the tables behind both)."""
    shared = every.groupBy("h").agg(F.sum("n").alias("n_h")).where("n_h > 1").select("h")
    known = materialise(every.join(shared, "h"), "substr-shared")
    contexts = materialise(known.groupBy("h", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("o1", "o2", "d", "at", "lo", "hi")).alias("x")), "substr-contexts")
    whole = contexts.where("n > 1").select("h", "c1", "c2")
    settled = known.where("n = 1").join(whole, ["h", "c1", "c2"]).select("o1", "o2", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))
    open_groups = contexts.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("h", "m")
    return settled, contexts.join(open_groups, "h").select(F.lit(0).alias("kind"), "h", "x.*", "n", "m"), [known, contexts]


def _word_contexts(every: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The same over words; what counts is that two documents hold a context, not that it occurs twice."""
    across = F.min("d") != F.max("d")
    shared = every.groupBy("h").agg(across.alias("a")).where("a").select("h")
    known = materialise(every.join(shared, "h"), "substr-word-shared")
    contexts = known.groupBy("h", "c1", "c2").agg(across.alias("a"), F.min(F.struct("o1", "o2", "d", "at", "lo", "hi")).alias("x"))
    contexts = materialise(contexts, "substr-word-contexts")
    whole = contexts.where("a").select("h", "c1", "c2")
    settled = known.join(whole, ["h", "c1", "c2"], "left_semi").select("o1", "o2", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))
    open_groups = contexts.groupBy("h").agg(F.bool_and("a").alias("all_a"), F.count("*").alias("m")).where("m > 1 AND NOT all_a").select("h")
    row = lambda df, n: df.select(F.lit(2).alias("kind"), "h", "o1", "o2", "d", "at", "lo", "hi", F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))
    single = known.join(open_groups, "h", "left_semi").join(whole, ["h", "c1", "c2"], "left_anti")
    # a context that two documents hold is settled; one of them still shows its windows to the others of its group
    shown = contexts.where("a").join(open_groups, "h", "left_semi").select("h", "x.*")
    return settled, row(single, 0).unionByName(row(shown, 1)), [known, contexts]


def repeated_runs(docs: DataFrame, rows: int = ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """(words, o1, o2, first, last), distinct: runs of starts of byte strings (words false) that start elsewhere too,
    and of passages of words that another document holds, by owner; and the tables they are read from."""
    ship(docs.sparkSession)
    found = materialise(anchor_rows(docs), "substr-anchors")
    local = found.where("kind = 1").select("o1", "o2", F.col("at").alias("first"), F.col("c1").alias("last"))
    settled, byte_wanted, b = _byte_contexts(found.where("kind = 0").drop("kind"), rows)
    word_settled, word_wanted, w = _word_contexts(found.where("kind = 2").drop("kind"))
    wanted = byte_wanted.unionByName(word_wanted).groupBy("o1", "o2", "d").agg(F.collect_list(F.struct("kind", "h", "at", "lo", "hi", "n", "m")).alias("wanted"))
    wanted = materialise(wanted, "substr-wanted")
    texts = owners(docs).where(_ABLE).select("o1", "o2", "d", "_bytes")
    # the document is part of the key: one row of many copies is cut, and the copies do not meet in one task
    strings = materialise(map_batches(texts.join(wanted, ["o1", "o2", "d"]), _second_pass, _CONTEXTS), "substr-strings")
    contexts = strings.where("h IS NOT NULL")
    fine = contexts.where(F.col("m") <= rows).select("h", "o1", "o2", "at", "lo", "hi", "n", "context")
    fine = fine.repartition("h").sortWithinPartitions("h", "o1", "o2", "at").mapInArrow(_settle(rows), _RUNS)
    runs = local.unionByName(settled).unionByName(fine)
    hot = contexts.where(F.col("m") > rows)
    if hot.select("h").head(1):
        more, table_of = _by_window(hot.select("h", "o1", "o2", "at", "lo", "hi", "n", "context"))
        runs = runs.unionByName(more)
        w.append(table_of)
    windows = strings.where("h IS NULL")
    many = windows.groupBy("w1", "w2").agg(((F.min("d") != F.max("d")) | (F.max("n") > 0)).alias("a"), F.min("n").alias("least")).where("a AND least = 0").select("w1", "w2")
    passages = windows.where("n = 0").join(many, ["w1", "w2"], "left_semi").select("o1", "o2", F.col("at").alias("first"), F.col("at").alias("last"))
    passages = word_settled.unionByName(passages)
    runs = runs.withColumn("words", F.lit(False)).unionByName(passages.withColumn("words", F.lit(True))).distinct()
    return runs, [found, *b, *w, wanted, strings]


def covered(runs: list[tuple[int, int]]) -> int:
    """Words under the passages that start in the runs."""
    total = at = 0
    for first, last in sorted(runs):
        total += max(0, last + WORDS - max(first, at))
        at = max(at, last + WORDS)
    return total


def remove(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) for runs (first, last) of repeated window starts."""
    kept, at, removed, spans = [], 0, 0, 0
    for first, last in sorted(runs):
        stop = last + WINDOW
        if first > at or not spans:
            kept.append(data[at:first])
            spans += 1
            removed += stop - first
        else:
            removed += max(0, stop - at)
        at = max(at, stop)
    kept.append(data[at:])
    return b"".join(kept), removed, spans


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long"


def deduplicate(docs: DataFrame, keep_text: bool = False, rows: int = ROWS) -> DataFrame:
    """One row per document: sizes, removed bytes and spans, the digest of what is left, the words of repeated passages
    and, if asked, the bytes that are left."""
    found, behind = repeated_runs(docs, rows)
    runs = materialise(found.groupBy("o1", "o2").agg(F.collect_list(F.struct("words", "first", "last")).alias("runs")), "substr-runs")
    release(*behind)
    source = owners(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_bytes", "o1", "o2")
    able = F.expr(_ABLE)  # shorter texts have no runs: they are spread, not joined by their few common texts
    source = source.withColumn("o1", F.when(able, F.col("o1")).otherwise(F.monotonically_increasing_id())).withColumn("o2", F.when(able, F.col("o2")).otherwise(0))
    source = source.join(runs, ["o1", "o2"], "left")
    schema = RESULT + (", kept binary" if keep_text else "")

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "_bytes"):
            out = []
            for data, own in zip(part.column("_bytes").to_pylist(), part.column("runs").to_pylist()):
                own = own or ()
                left, removed, spans = remove(data, [(r["first"], r["last"]) for r in own if not r["words"]])
                out.append((len(data), removed, spans, hashlib.sha256(left).hexdigest(), covered([(r["first"], r["last"]) for r in own if r["words"]]), left))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()][:6 if keep_text else 5]
            yield pa.table([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[f.split()[0] for f in schema.split(", ")])

    return map_batches(source.select("doc_id", "_bytes", "runs"), run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated 400-byte strings cover; its words under repeated passages beside."""
    return deduplicate(table(spark, sf_dir, "documents"))
