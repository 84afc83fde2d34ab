"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

The benchmark is indexed, not the corpus: its posting lists, cut into blocks with their largest impacts, are
broadcast in shards of bounded size.  Counts, document frequencies and the average length are taken once over all
items, so a score does not depend on the shards.  Every passage (overlapping windows of words covering each whole
document) is a query; items are indexed by length, from one power of two words to the next, and a passage is twice as
long as the longest items of its index may be, so what short items match does not depend on long ones.  An impact is
divided by the score its item needs (a share of the item's score against itself), so one threshold of 1 serves all
items.  A vectorised bound over the terms an item cannot do without, summed over postings, drops the passages that cannot
reach any item; block-max WAND retrieves every item at or above the threshold for the others; a hit counts if both the
item's question part and its answer part overlap the passage.

Defined cases: null and empty texts and items have no terms and match nothing; equal items each match; repeated
documents each report; a document that holds an item many times reports it once, with its best passage, of equal ones the
first; texts of any length are read whole; an empty benchmark or corpus gives no rows.  An item without columns
``question`` and ``answer`` is split before its last sentence.  Other columns, whatever their names, are carried by
``keep_clean`` and read by nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, slices, table

K1, B = 1.2, 0.75
SHARE = 0.5  # of an item's score against itself
OVERLAP = 0.5  # of the question's and of the answer's word triples
BLOCK = 16
#: Words of the shortest passages' half.
MIN_STRIDE = 64
#: Characters of benchmark text in one broadcast index; larger benchmarks are searched shard by shard.
SHARD_CHARS = 8_000_000
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: the answer is the last sentence, or the last quarter of a single one."""
    body = text.rstrip().rstrip(".!?").rstrip()
    cut = max((m.end() for m in re.finditer(r"[.!?\n](?=\s|\w)", body)), default=0)
    q, a = words(text[:cut]), words(text[cut:])
    if not q or not a:
        all_words = q + a
        cut = max(1, len(all_words) - max(1, len(all_words) // 4))
        q, a = all_words[:cut], all_words[cut:]
    return q, a


def grams(terms) -> set[tuple]:
    """Word triples, or single words where there are fewer than five."""
    terms = list(terms)
    if len(terms) < 5:
        return {(t,) for t in terms}
    return {tuple(terms[i:i + 3]) for i in range(len(terms) - 2)}


class Statistics:
    """Number, average length and document frequencies of all items."""

    def __init__(self, docs: list[list[str]]):
        self.n = len(docs)
        self.average = sum(map(len, docs)) / max(1, self.n) or 1.0
        self.df = Counter(t for d in docs for t in set(d))

    def impacts(self, doc: list[str]) -> dict[str, float]:
        out = {}
        for t, tf in Counter(doc).items():
            idf = math.log(1 + (self.n - self.df[t] + 0.5) / (self.df[t] + 0.5))
            out[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(doc) / self.average))
        return out


class Index:
    """Posting lists of (item ordinal, impact / needed score) in blocks, over interned terms; ``reach`` bounds its items' words."""

    def __init__(self, items: list[tuple[object, list[str], list[str]]], share: float = SHARE, statistics: Statistics | None = None, reach: int | None = None):
        self.ids = [i for i, _, _ in items]
        docs = [q + a for _, q, a in items]
        statistics = statistics or Statistics(docs)
        df = statistics.df
        self.vocab: dict[str, int] = {}
        for d in docs:
            for t in d:
                self.vocab.setdefault(t, len(self.vocab))
        self.question = [grams(self.vocab[t] for t in q) for _, q, _ in items]
        self.answer = [grams(self.vocab[t] for t in a) for _, _, a in items]
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        essential: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.rest = np.zeros(len(docs))
        for o, d in enumerate(docs):
            impact = statistics.impacts(d)
            need = share * sum(impact.values())
            if not need:
                continue
            left = 1.0
            for t in sorted(impact, key=lambda t: (-df[t], t)):  # the commonest terms that cannot reach 1 together
                w = impact[t] / need
                lists[self.vocab[t]].append((o, w))
                if w < left - 1e-9 and left > 0.4 and df[t] > 2:
                    left -= w
                    self.rest[o] += w
                else:
                    essential[self.vocab[t]].append((o, w))
        self.postings = {t: (np.array([o for o, _ in p], np.int64), np.array([w for _, w in p])) for t, p in lists.items()}
        self.lists = {t: (o.tolist(), w.tolist()) for t, (o, w) in self.postings.items()}
        self.terms = pa.array(list(self.vocab), pa.string())
        self.top = {t: float(w.max()) for t, (_, w) in self.postings.items()}
        self.blocks = {t: [(int(o[min(k + BLOCK, len(o)) - 1]), float(w[k:k + BLOCK].max())) for k in range(0, len(o), BLOCK)]
                       for t, (o, w) in self.postings.items()}
        size = len(self.vocab)
        counts = np.array([len(essential.get(t, ())) for t in range(size)], np.int64)
        self.e_start = np.concatenate([[0], np.cumsum(counts)])
        self.e_item = np.array([o for t in range(size) for o, _ in essential.get(t, ())], np.int64)
        self.e_weight = np.array([w for t in range(size) for _, w in essential.get(t, ())])
        self.reach = max(map(len, docs), default=0) if reach is None else reach

    def wand(self, terms: set[int]) -> list[tuple[int, float]]:
        """Every item whose score reaches 1, by block-max WAND over the passage's posting lists."""
        cursors = []  # item now, place, items, impacts, largest impact, blocks, block now
        for t in sorted(terms):
            if t in self.lists:
                items, impacts = self.lists[t]
                cursors.append([items[0], 0, items, impacts, self.top[t], self.blocks[t], 0])
        found, end, first = [], len(self.ids), itemgetter(0)

        def seek(c, o):
            c[1] = at = bisect_left(c[2], o, c[1])
            c[0] = c[2][at] if at < len(c[2]) else end

        while cursors:
            cursors.sort(key=first)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                if c[0] == end:
                    del cursors[i:]
                    break
                bound += c[4]
                if bound >= 1 - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            o = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == o:
                pivot += 1
            block_bound, next_end = 0.0, end
            for c in cursors[:pivot + 1]:
                blocks, k = c[5], c[6]
                while k < len(blocks) and blocks[k][0] < o:
                    k += 1
                c[6] = k
                if k < len(blocks):
                    block_bound += blocks[k][1]
                    next_end = min(next_end, blocks[k][0] + 1)
            if block_bound < 1 - 1e-9:
                after = max(o + 1, min(next_end, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else next_end)
                for c in cursors[:pivot + 1]:
                    seek(c, after)
            elif cursors[0][0] == o:
                s = sum([c[3][c[1]] for c in cursors[:pivot + 1]])
                if s >= 1 - 1e-9:
                    found.append((o, s))
                for c in cursors[:pivot + 1]:
                    c[1] += 1
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else end
            else:
                for c in cursors[:pivot]:
                    if c[0] < o:
                        seek(c, o)
        return found


#: What may stand around a word without being of it, and letters that Arrow lowers otherwise than Python.
_AROUND, _OTHER_CASE = ".,;:!?\"'()[]{}<>*#%&$/|=+~^`\\-–—…«»“”„‘’", "[\u0130\u03a3]"


def _stream(texts: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Term ids of all texts one after another (-1: in no item), and where each text starts."""
    split = pc.utf8_split_whitespace(texts)
    encoded = split.flatten().dictionary_encode()
    bare = pc.utf8_trim(encoded.dictionary, characters=_AROUND)
    plain = np.asarray(pc.and_(pc.utf8_is_alpha(bare), pc.invert(pc.match_substring_regex(bare, _OTHER_CASE))))
    ids = np.asarray(pc.fill_null(pc.index_in(pc.utf8_lower(bare), value_set=index.terms), -1)).astype(np.int64)
    get = index.vocab.get
    rest = np.flatnonzero(~plain)
    others = [[get(x, -1) for x in _WORD.findall(w.lower())] for w in encoded.dictionary.take(pa.array(rest)).to_pylist()]
    many = np.ones(len(plain), np.int64)
    many[rest] = [len(o) for o in others]
    ends = np.concatenate([[0], np.cumsum(many)])
    terms = np.empty(ends[-1], np.int64)
    terms[ends[:-1][plain]] = ids[plain]
    if len(rest):
        flat = np.array([t for o in others for t in o], np.int64)
        own = many[rest]
        terms[np.repeat(ends[:-1][rest] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(len(flat))] = flat
    at = np.asarray(encoded.indices, dtype=np.int64) if len(encoded) else np.zeros(0, np.int64)
    counts = many[at]
    first = np.concatenate([[0], np.cumsum(counts)])
    out = terms[np.repeat(ends[:-1][at] - first[:-1], counts) + np.arange(first[-1])] if len(at) else terms[:0]
    return out, first[np.asarray(split.offsets)]


#: Postings that are summed at once, and the cells a table of sums may have for each of them.
_CHUNK, _DENSE = 1 << 17, 4


def live_rows(index: Index, row: np.ndarray, terms: np.ndarray, follows: np.ndarray) -> list[int]:
    """The rows (sorted, of ``terms`` with postings) from which, or from which with the next row of the same document,
    the bound of some item reaches 1; ``follows`` says which rows have a next one."""
    hits = index.e_start[terms + 1] - index.e_start[terms]
    n, need = len(index.ids), 1 - 1e-9 - index.rest
    live: list[np.ndarray] = []
    ends = np.cumsum(hits)
    at = first = 0
    rows = len(follows)
    while first < rows and at < len(row):
        first = int(row[at])
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, side="right"))
        last = rows if stop >= len(row) else max(first + 1, int(row[stop]))  # rows [first, last) are decided
        upto = int(np.searchsorted(row, last + 1))  # with what the last of them needs of the next
        own, h = slice(at, upto), hits[at:upto]
        place = np.repeat(index.e_start[terms[own]] - np.concatenate([[0], np.cumsum(h)[:-1]]), h) + np.arange(int(h.sum()))
        cell = np.repeat((row[own] - first) * n, h) + index.e_item[place]
        weight, size = index.e_weight[place], last + 1 - first
        if size * n <= _DENSE * len(cell) + 4096:
            bound = np.bincount(cell, weights=weight, minlength=size * n).reshape(size, n)
            single = (bound[:-1] >= need).any(1)
            pair = (bound[:-1] + bound[1:] >= need).any(1)
            live.append(first + np.flatnonzero(single | pair & follows[first:last][:len(single)]) if last <= rows else first + np.flatnonzero(single))
        else:  # few postings for the items there are: sums of sorted cells
            before = np.flatnonzero((cell >= n) & follows[np.maximum(first + cell // n - 1, 0)])
            cell, weight = np.concatenate([cell, cell[before] - n]), np.concatenate([weight, weight[before]])
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            sums = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0)
            cell = cell[starts]
            found = np.unique(first + cell[sums >= need[cell % n]] // n)
            live.append(found[found < last])
        at, first = int(np.searchsorted(row, last)), last
    return np.concatenate(live).tolist() if live else []


def search_texts(index: Index, texts: pa.Array) -> list[list[tuple[int, float, float, float, int]]]:
    """For each text its items as (ordinal, score, question overlap, answer overlap, first word of the passage)."""
    stride = max(MIN_STRIDE, index.reach)
    out: list[list] = [[] for _ in range(len(texts))]
    if not index.vocab:
        return out
    terms, starts = _stream(texts, index)
    sizes = np.diff(starts)
    rows = -(-sizes // stride)
    row_at = np.concatenate([[0], np.cumsum(rows)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    row = row_at[:-1][owner] + (np.arange(len(terms)) - starts[:-1][owner]) // stride
    known = np.flatnonzero(terms >= 0)
    known = known[index.e_start[terms[known] + 1] > index.e_start[terms[known]]]
    doc_of_row = np.repeat(np.arange(len(sizes)), rows)
    follows = np.append(doc_of_row[1:] == doc_of_row[:-1], False) if len(doc_of_row) else np.zeros(0, bool)
    for r in live_rows(index, row[known], terms[known], follows):
        d = int(doc_of_row[r])
        lo = int(starts[d] + (r - row_at[d]) * stride)
        window = terms[lo:min(lo + 2 * stride, int(starts[d + 1]))].tolist()
        found = index.wand({t for t in window if t >= 0})
        if not found:
            continue
        triples = {tuple(window[i:i + 3]) for i in range(len(window) - 2)} | {(t,) for t in window}
        for o, s in found:
            q, a = index.question[o], index.answer[o]
            qo = len(q & triples) / len(q) if q else 1.0
            ao = len(a & triples) / len(a) if a else 1.0
            if qo >= OVERLAP and ao >= OVERLAP:
                out[d].append((o, s * SHARE, qo, ao, (r - int(row_at[d])) * stride))
    return out


def shards(benchmark: DataFrame, shard_chars: int = SHARD_CHARS) -> Iterator[list[Index]]:
    """Groups of indexes, each group of bounded size and of all items' statistics, that together hold every item."""
    if {"question", "answer"} <= set(benchmark.columns):
        items = benchmark.select("item_id", F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    else:
        items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("q"), F.lit(None).cast("string").alias("a"))
    total = items.agg(F.sum(F.length("q") + F.coalesce(F.length("a"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-int(total) // shard_chars))

    def part(k: int) -> list[tuple]:
        rows = items.where(F.pmod(F.xxhash64("q", "item_id"), F.lit(n)) == k).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.q))
        parts = [(r.item_id, *((words(r.q), words(r.a)) if r.a is not None else split_item(r.q))) for r in rows]
        return [p for p in parts if p[1] or p[2]]

    statistics = Statistics([])
    length = 0
    for k in range(n):  # once over all items; the driver holds a shard and the frequencies
        docs = [q + a for _, q, a in part(k)]
        own = Statistics(docs)
        statistics.n += own.n
        statistics.df.update(own.df)
        length += sum(map(len, docs))
    statistics.average = length / max(1, statistics.n) or 1.0
    for k in range(n):
        by_reach: dict[int, list] = {}
        for p in part(k):
            by_reach.setdefault(max(MIN_STRIDE, 1 << (len(p[1]) + len(p[2]) - 1).bit_length()), []).append(p)
        yield [Index(by_reach[reach], statistics=statistics, reach=reach) for reach in sorted(by_reach)]


MATCHES = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start int"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlaps, passage) for each document and item that match; nothing is shuffled."""
    spark, out = docs.sparkSession, None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for group in shards(benchmark):
        shared = spark.sparkContext.broadcast(group)

        def run(batch: pa.RecordBatch, shared=shared):
            for part in slices(batch, "text", 4 << 20):
                cols: list[list] = [[], [], [], [], [], []]
                docs_of = part.column("doc_id").to_pylist()
                for own in shared.value:
                    for doc, hits in zip(docs_of, search_texts(own, part.column("text"))):
                        best: dict[int, tuple] = {}
                        for h in hits:
                            if h[0] not in best or h[1:4] > best[h[0]][1:4]:
                                best[h[0]] = h
                        for o, s, q, a, at in sorted(best.values()):
                            for c, v in zip(cols, (doc, own.ids[o], min(s, 1.0), q, a, at)):
                                c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                yield pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in MATCHES.split(", ")])

        found = map_batches(source, run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, over all documents and all items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; matching and dropping are one pass without a shuffle."""
    names, spark, out = docs.columns, docs.sparkSession, docs
    for group in shards(benchmark):
        shared = spark.sparkContext.broadcast(group)

        def run(batch: pa.RecordBatch, shared=shared):
            for part in slices(batch, "text", 4 << 20):
                for index in shared.value:
                    found = search_texts(index, pc.fill_null(part.column("text"), ""))
                    part = part.filter(pa.array([not h for h in found], pa.bool_()))
                yield part

        out = map_batches(out.select(*names), run, docs.schema)
    return out
