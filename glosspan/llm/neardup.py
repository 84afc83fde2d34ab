"""Near-duplicate detection: SimHash fingerprints joined by a May-Ozerov style recursion.

A 256-bit SimHash over weighted words stands for each distinct text.  One repetition draws disjoint random coordinate
strips.  On a strip, a fingerprint is kept by a random centre if its partial weight against it (the number of
differing coordinates) is at most one; each fingerprint follows the first of its centres in that repetition's
random order, so the next strip is applied inside ever smaller lists, and the last lists are compared by brute
force.  Levels and strips are such that a list of unlike texts holds about ``LIST`` of them, whatever the number of
texts, and there are as many repetitions as bring two fingerprints at exactly ``THRESHOLD`` together with the chance
``RECALL``; nearer ones meet more surely.

Lists are compared a tile of rows at a time, first on half of the bits: two fingerprints that differ in more than
``THRESHOLD`` of these, as nearly all unlike ones do, are done with, and the few pairs left are measured on all bits.
A pair is counted by the first repetition that brings both together, which each list can tell from the two
fingerprints alone, so no pair is ever shipped: a list sends one row per linked text with its count and the root of
its local component.  A near pair asks one earlier repetition after the other until one held both, and pairs are held
``PAIRS`` at a time, so a class of many near copies costs a little for each of its pairs in each list.  A list above ``BLOCK`` rows (of texts too alike for any strip to part) is not held: its rows are
dealt to pairs of blocks that other tasks compare, exactly.  Components are joined by alternating large-star and
small-star steps.

Defined cases: equal texts (also null and empty ones, null counting as empty) are one class without any search;
repeated rows are copies; a text without words is represented by its bytes; of documents of a class that tie the smallest
doc_id, then the smallest text hash represents it; ids may be null; texts of any length are read whole; an empty table
gives no rows; other columns, whatever their names, are carried by ``keep_representatives`` and read by nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, release, ship, slices, table
from .toxicity import word_slices

BITS = 256
THRESHOLD = 44
#: Weight of words of up to three letters, most of which any two texts of a language share.
SHORT = 0.3
LIST = 512
RECALL = 0.99
BLOCK = 4096
#: Rows compared at a time, and near pairs held at a time.
TILE = 128
PAIRS = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SALTS = np.array([0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x2545F4914F6CDD1D], np.uint64)
_PARTS = ["f0", "f1", "f2", "f3"]
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return (h ^ (h >> np.uint64(29))) * _B


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever it is computed."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * powers[within], dtype=np.uint64)])
    return _mix(total[offsets[1:]] - total[offsets[:-1]] + np.uint64(1))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash of each text's words, weighted by the log of their counts, short ones less: (texts, 32) bytes."""
    words, index, offsets = word_slices(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    size = np.asarray(pc.utf8_length(words)) if len(words) else np.zeros(0, np.int64)
    real = size[index] > 0
    pair, count = np.unique(owner[real] * np.int64(max(len(words), 1)) + index[real], return_counts=True)
    owner, word = pair // max(len(words), 1), pair % max(len(words), 1)
    feature = _word_hashes(words)[word] if len(words) else np.zeros(0, np.uint64)
    weight = np.log1p(count) * np.where(size[word] <= 3, SHORT, 1.0)
    bare = np.flatnonzero(np.bincount(owner, minlength=n) == 0)
    if len(bare):
        own = texts.take(pa.array(bare)).to_pylist()
        raw = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little") for t in own]
        feature, owner, weight = np.append(feature, np.array(raw, np.uint64)), np.append(owner, bare), np.append(weight, np.ones(len(bare)))
    cell = owner * 256
    out = np.zeros((n, BITS // 8), np.uint8)
    for k, salt in enumerate(_SALTS):
        mixed = _mix(feature ^ salt).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            histogram = np.bincount(cell + mixed[:, b], weights=weight, minlength=n * 256).reshape(n, 256).astype(np.float32)
            out[:, 8 * k + b] = np.packbits(histogram @ _SIGNS > 0, axis=1)[:, 0]
    return out


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, f0..f3) for every row; h1 and h2 are 128 bits of the text's own hash."""
    source = with_text_hash(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_h1").alias("h1"), F.col("_h2").alias("h2"),
                                         F.coalesce("text", F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text", 2 << 20):
            fp = fingerprints(part.column("text")) if part.num_rows else np.zeros((0, 32), np.uint8)
            yield pa.table([part.column("doc_id"), part.column("h1"), part.column("h2"), *_columns(fp)], names=["doc_id", "h1", "h2", *_PARTS])

    return map_batches(source, run, "doc_id long, h1 long, h2 long, f0 long, f1 long, f2 long, f3 long")


def with_text_hash(docs: DataFrame) -> DataFrame:
    """The documents with 128 bits of hash of their texts, _h1 and _h2, computed where they are read."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit(0x5DEECE66D), text))


@lru_cache(maxsize=8)
def _recursion(repeats: int, levels: int, strip: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (repeats, levels, strip) and the chosen centre of each strip value (repeats, levels, 2**strip)."""
    g = np.random.default_rng(seed)
    coords = np.stack([g.permutation(BITS)[:levels * strip].reshape(levels, strip) for _ in range(repeats)])
    values = np.arange(1 << strip)
    ball = np.concatenate([values[None], values[None] ^ (1 << np.arange(strip))[:, None]])
    centres = np.empty((repeats, levels, 1 << strip), np.int64)
    for r in range(repeats):
        for level in range(levels):
            order = g.permutation(1 << strip)
            centres[r, level] = np.take_along_axis(ball, order[ball].argmin(0)[None], 0)[0]
    return coords, centres


def meeting_chance(distance: int, strip: int) -> float:
    """The chance that two fingerprints at ``distance`` follow the same centre of one strip.

    They differ in j of its coordinates with the hypergeometric chance; their balls of ``strip`` + 1 centres share all
    (j = 0) or two (j = 1, 2) of them, and the first of all centres in random order is a shared one with the share's chance.
    """
    total = 0.0
    for j in range(3):
        chance = math.comb(distance, j) * math.comb(BITS - distance, strip - j) / math.comb(BITS, strip)
        total += chance * (1.0 if j == 0 else 2 / (2 * (strip + 1) - 2))
    return total


@lru_cache(maxsize=64)
def recursion_plan(texts: int, threshold: int = THRESHOLD, recall: float = RECALL, size: float = LIST) -> tuple[int, int, int]:
    """(levels, coordinates of a strip, repetitions): of the recursions whose last lists hold at most ``size`` unlike
    texts on average, the one with the fewest repetitions."""
    best = None
    for levels in range(2, 6):
        for strip in range(3, 13):
            if texts * meeting_chance(BITS // 2, strip) ** levels <= size and levels * strip <= 50:
                repeats = max(1, math.ceil(math.log(1 - recall) / math.log1p(-meeting_chance(threshold, strip) ** levels)))
                if best is None or repeats < best[2]:
                    best = (levels, strip, repeats)
    return best or (5, 10, math.ceil(math.log(1 - recall) / math.log1p(-meeting_chance(threshold, 10) ** 5)))


@lru_cache(maxsize=8)
def _strip_weights(repeats: int, levels: int, strip: int, seed: int) -> np.ndarray:
    """The matrix that makes of a row's bits the values of all its strips: (BITS, repeats * levels)."""
    coords, _ = _recursion(repeats, levels, strip, seed)
    out = np.zeros((BITS, repeats * levels), np.float32)  # values stay below 2**24, so they are exact
    out[coords.reshape(repeats * levels, strip), np.arange(repeats * levels)[:, None]] = 1 << np.arange(strip)
    return out


def list_keys(fp: np.ndarray, params, first: int | None = None) -> np.ndarray:
    """The list of each fingerprint in each repetition, or the ``first`` ones: (rows, repetitions)."""
    repeats, levels, strip, seed, _ = params
    _, centres = _recursion(repeats, levels, strip, seed)
    first = repeats if first is None else first
    weights = np.ascontiguousarray(_strip_weights(repeats, levels, strip, seed)[:, :first * levels])
    out = np.empty((len(fp), first), np.int64, order="F")
    for lo in range(0, len(fp), 4096):
        values = (np.unpackbits(fp[lo:lo + 4096], axis=1).astype(np.float32) @ weights).T.astype(np.int64)
        for r in range(first):
            key = np.full(values.shape[1], r, np.int64)
            for level in range(levels):
                key = (key << strip) | centres[r, level][values[r * levels + level]]
            out[lo:lo + 4096, r] = key
    return out


def _word_columns(fp: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fp.view(np.uint64).reshape(len(fp), -1).T)


def _components(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each row's component of the pairs."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def _near_pairs(words: np.ndarray, spans, threshold: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j within ``threshold`` and of one ``group``, about ``PAIRS`` at a time.

    ``words`` is (words, rows); each of ``spans`` is (first, last, start, stop): rows first..last against start..stop.
    """
    def near(left, right):
        i, j = np.concatenate(left), np.concatenate(right)
        kept = i < j if group is None else (i < j) & (group[i] == group[j])
        i, j = i[kept], j[kept]
        kept = sum(np.bitwise_count(word[i] ^ word[j]).astype(np.int16) for word in words) <= threshold
        return i[kept], j[kept]

    left, right, held = [], [], 0
    for first, last, start, stop in spans:
        differ = np.bitwise_count(words[0, first:last, None] ^ words[0, None, start:stop])
        differ += np.bitwise_count(words[1, first:last, None] ^ words[1, None, start:stop])
        i, j = np.divmod(np.flatnonzero(differ <= threshold), max(stop - start, 1))
        left.append(i + first)
        right.append(j + start)
        held += len(i)
        if held >= PAIRS:
            yield near(left, right)
            left, right, held = [], [], 0
    if held:
        yield near(left, right)


def _owned(i: np.ndarray, j: np.ndarray, rep: np.ndarray, fp: np.ndarray, params) -> np.ndarray:
    """Which pairs of rows, met in repetition ``rep``, no earlier repetition brought together."""
    own = np.ones(len(i), bool)
    before = int(rep.max(initial=0))
    if not before:
        return own
    linked = np.zeros(len(fp), bool)
    linked[i] = linked[j] = True
    place = np.cumsum(linked) - 1
    keys = list_keys(np.ascontiguousarray(fp[linked]), params, before)
    i, j, open_ = place[i], place[j], np.arange(len(i))
    least = int(rep.min())
    for r in range(before):
        if r >= least:
            later = rep[open_] > r
            i, j, open_ = i[later], j[later], open_[later]
        met = keys[:, r][i] == keys[:, r][j]
        own[open_[met]] = False
        i, j, open_ = i[~met], j[~met], open_[~met]
        if not len(open_):
            break
    return own


def _links(pairs, ids, fp, rep: np.ndarray, params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks of near rows i, j, met in i's repetition ``rep``: (ids, counts, roots) of the pairs they own.

    The counts of an id's rows add up, and the rows join what is linked, as one list or several chunks tell it.
    """
    found = []
    total = np.zeros(len(ids), np.int64)
    for i, j in pairs:
        own = _owned(i, j, rep[i], fp, params)
        i, j = i[own], j[own]
        if not len(i):
            continue
        counts = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        total += counts
        linked = np.flatnonzero(counts)
        local = np.full(len(ids), -1)
        local[linked] = np.arange(len(linked))
        found.append((linked, _components(len(linked), local[i], local[j], ids[linked])))
    if not found:
        return ids[:0], total[:0], ids[:0]
    rows = np.concatenate([f[0] for f in found])
    roots = np.concatenate([f[1] for f in found])
    counts = np.zeros(len(rows), np.int64)
    once, at = np.unique(rows, return_index=True)
    counts[at] = total[once]
    told = (counts > 0) | (roots != ids[rows])
    return ids[rows[told]], counts[told], roots[told]


def _compare(keys: np.ndarray, ids: np.ndarray, fp: np.ndarray, params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brute force inside every list of rows sorted by key."""
    ends = np.searchsorted(keys, keys, "right")
    spans = ((lo, min(lo + TILE, len(keys)), lo, int(ends[min(lo + TILE, len(keys)) - 1])) for lo in range(0, len(keys), TILE))
    pairs = _near_pairs(_word_columns(fp), spans, params[4], keys)
    return _links(pairs, ids, fp, keys >> (params[1] * params[2]), params)


_FOUND = "id long, links long, root long, key long, block int, f0 long, f1 long, f2 long, f3 long"


def _found_table(ids, counts, roots) -> pa.Table:
    n = len(ids)
    return pa.table([pa.array(ids), pa.array(counts, pa.int64()), pa.array(roots), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 4],
                    names=["id", "links", "root", "key", "block", *_PARTS])


def _columns(fp: np.ndarray) -> list[pa.Array]:
    words = np.ascontiguousarray(fp).view(np.int64).reshape(len(fp), len(_PARTS))
    return [pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(_PARTS))]


def _fp_matrix(batch) -> np.ndarray:
    words = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in _PARTS], 1)
    return np.ascontiguousarray(words).view(np.uint8).reshape(-1, BITS // 8)


def _search_lists(params, block: int):
    """The mapper over rows sorted by key: compares lists, hands lists above ``block`` rows on in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        hot: list = [None, 0]

        def flush(keys, ids, fp):
            sizes = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(sizes, len(keys)))
            big = np.repeat(lengths > block, lengths) | (keys == hot[0] if hot[0] is not None else False)
            if big.any():
                for k in np.unique(keys[big]):
                    at = np.flatnonzero(keys == k)
                    if hot[0] != k:
                        hot[:] = [k, 0]
                    numbers = (hot[1] + np.arange(len(at))) // block
                    hot[1] += len(at)
                    nothing = pa.nulls(len(at), pa.int64())
                    yield pa.table([pa.array(ids[at]), nothing, nothing, pa.array(keys[at]), pa.array(numbers.astype(np.int32)), *_columns(fp[at])],
                                   names=["id", "links", "root", "key", "block", *_PARTS])
                keys, ids, fp = keys[~big], ids[~big], np.ascontiguousarray(fp[~big])
            if len(keys) > 1:
                found = _compare(keys, ids, fp, params)
                if len(found[0]):
                    yield _found_table(*found)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((np.asarray(batch.column("key")), np.asarray(batch.column("id")), _fp_matrix(batch)))
            keys = np.concatenate([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            fp = np.concatenate([h[2] for h in held])
            cut = int(np.searchsorted(keys, keys[-1]))
            if len(keys) - cut > block or keys[-1] == hot[0]:
                cut = len(keys)
            for t in flush(keys[:cut], ids[:cut], np.ascontiguousarray(fp[:cut])):
                yield from t.to_batches()
            held = [(keys[cut:], ids[cut:], fp[cut:])] if cut < len(keys) else []
        for keys, ids, fp in held:
            for t in flush(keys, ids, np.ascontiguousarray(fp)):
                yield from t.to_batches()

    return run


def _block_pairs(deferred: DataFrame, params) -> DataFrame:
    """Compare the blocks of hot lists, each pair of blocks in a task of its own."""
    blocks = deferred.groupBy("key").agg((F.max("block") + 1).alias("n"))
    dealt = (deferred.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("key", "id", *_PARTS, "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")))
    shift = params[1] * params[2]

    def compare(key, t):
        t = t.combine_chunks()
        a, b, rep = key[1].as_py(), key[2].as_py(), key[0].as_py() >> shift
        block = np.asarray(t.column("block"))
        order = np.argsort(block, kind="stable")
        ids, fp = np.asarray(t.column("id"))[order], np.ascontiguousarray(_fp_matrix(t)[order])
        left = int((block == a).sum())
        spans = ((lo, min(lo + TILE, left), lo if a == b else left, len(ids)) for lo in range(0, left, TILE))
        got = _links(_near_pairs(_word_columns(fp), spans, params[4]), ids, fp, np.full(len(ids), rep), params)
        return pa.table([pa.array(got[0]), pa.array(got[1], pa.int64()), pa.array(got[2])], names=["id", "links", "root"])

    return dealt.groupBy("key", "a", "b").applyInArrow(compare, "id long, links long, root long")


def find_links(items: DataFrame, threshold: int = THRESHOLD, recall: float = RECALL, seed: int = 11,
               block: int = BLOCK, size: float = LIST) -> DataFrame:
    """(id, links, root) rows of items (id, f0..f3), ids being distinct: partial link counts and edges to local component roots."""
    levels, strip, repeats = recursion_plan(items.count(), threshold, recall, size)
    params = (repeats, levels, strip, seed, threshold)
    ship(items.sparkSession)

    def keys(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            own = list_keys(_fp_matrix(part), params)
            for r in range(repeats if part.num_rows else 0):
                yield pa.table([pa.array(own[:, r]), *(part.column(c) for c in ("id", *_PARTS))], names=["key", "id", *_PARTS])

    listed = map_batches(items.select("id", *_PARTS), keys, "key long, id long, f0 long, f1 long, f2 long, f3 long")
    sorted_lists = listed.repartition("key").sortWithinPartitions("key")
    found = materialise(sorted_lists.mapInArrow(_search_lists(params, block), _FOUND), "neardup-found")
    deferred = found.where(F.col("key").isNotNull())
    links = found.where(F.col("key").isNull()).select("id", "links", "root")
    if deferred.select("key").head(1):
        links = links.unionByName(_block_pairs(deferred.select("key", "block", "id", *_PARTS), params))
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (id, root): the smallest id of its component."""
    now = materialise(edges.where("id <> root").select(F.greatest("id", "root").alias("u"), F.least("id", "root").alias("v")).distinct(), "cc")
    previous = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, now = now, materialise(small, "cc")
        release(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == previous:
            out = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
            out.glosspan_path = now.glosspan_path
            return out
        previous = state


def classify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_links (other texts within the
    threshold), n_copies (rows with its very text), is_representative, and the text's hash (h1, h2)."""
    rows = materialise(fingerprint_rows(docs), "neardup-rows")
    texts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), *[F.min(c).alias(c) for c in _PARTS])
    texts = materialise(texts.withColumn("id", F.monotonically_increasing_id()), "neardup-texts")  # written, so that ids stay
    links = materialise(find_links(texts, **options), "neardup-links")
    root = components(links.select("id", "root"))
    counts = links.groupBy("id").agg(F.sum("links").alias("n_links"))
    known = (texts.select("h1", "h2", "first", "n_copies", "id").join(counts, "id", "left").join(root, "id", "left")
             .withColumn("root", F.coalesce("root", "id")))
    classes = known.groupBy("root").agg(F.min("first").alias("class_id"), F.min(F.struct("first", "h1", "h2")).alias("rep"))
    known = known.join(classes, "root").select("h1", "h2", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "first",
                                               ((F.col("rep.h1") == F.col("h1")) & (F.col("rep.h2") == F.col("h2"))).alias("of_rep"))
    known = materialise(known, "neardup-known")
    release(texts, links, root)
    return rows.select("doc_id", "h1", "h2").join(known, ["h1", "h2"]).select(
        "doc_id", "class_id", "n_links", "n_copies", (F.col("of_rep") & F.col("doc_id").eqNullSafe(F.col("first"))).alias("is_representative"), "h1", "h2")


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class and number of links to different texts."""
    return classify(table(spark, sf_dir, "documents")).drop("h1", "h2")


#: Rows to drop up to this many are broadcast, which spares the texts a shuffle; beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one row of each class, with their own columns.

    The row that stays is the one with the smallest doc_id; of several equal rows with that id one stays.
    """
    classes = materialise(classify(docs, **options), "neardup-classes")
    own = [F.col("doc_id").alias("_d"), F.col("h1").alias("_x"), F.col("h2").alias("_y")]
    drop = classes.where("NOT is_representative").select(*own).distinct()
    twice = classes.where("is_representative").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(*own)
    keyed = with_text_hash(docs.withColumn("_doc", F.col("doc_id").cast("long")))
    same = lambda t: keyed["_doc"].eqNullSafe(t["_d"]) & (keyed["_h1"] == t["_x"]) & (keyed["_h2"] == t["_y"])
    sized = lambda t: F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t
    kept = keyed.join(sized(drop), same(drop), "left_anti")
    if twice.head(1):
        keyed = kept
        kept = (keyed.join(sized(twice), same(twice), "left_anti")
                .unionByName(keyed.join(sized(twice), same(twice), "left_semi").dropDuplicates(["_doc", "_h1", "_h2"])))
    return kept.select(*docs.columns)
