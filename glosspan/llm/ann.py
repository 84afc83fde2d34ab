"""Approximate nearest neighbours by inner product with an inverted multi-index.

Each vector is cut into two halves that are quantised separately; a pair of centroids is a cell, and a cell's
vectors are packed in blocks of bounded size.  A query ranks the centroids of each half, walks the pairs in order
of their summed distance with a heap until the cells it has seen hold the share of all vectors that the target
recall needs, and the entries of those cells are reranked with the original vectors in double precision.

The codebooks grow with the vectors, so that a cell holds about ``PER_CELL`` of them, up to ``MOST`` centroids a half
(what is broadcast stays bounded; larger cells are more blocks).  They are fitted on at most ``SAMPLE`` vectors and the
share is calibrated on at most ``PROBES`` queries against the same sample by brute force; these are parameters.  Every
vector is indexed.  What a query finds among the sample's vectors in its cells bounds what its other entries must reach.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components, or have no vec_id, take no
part; an inner product needs equal lengths, so vectors of each length are searched among themselves; every row is a
candidate but the query's own, so of rows that repeat a vec_id each is a query and a candidate of the others; equal scores
tie and the smaller vec_id comes first; with fewer candidates than asked for, all are returned; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, release, table

TOP = 20
QUERY_MODULUS = 20
SAMPLE = 20_000
PROBES = 128
PER_CELL, MOST = 256, 1024
BLOCK = 4096
RECALL = 0.97


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(rid, vec_id, v array<double>) of the rows that take part; ``rid`` tells rows apart."""
    ok = (F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)
          & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
          & F.exists(column, lambda x: x != 0))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k centroids of the rows of x; deterministic."""
    g = np.random.default_rng(seed)
    c = x[g.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        live = counts > 0
        c[live] = sums[live] / counts[live, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        part = x[at:at + 4096]
        out[at:at + 4096] = ((c * c).sum(1)[None] - 2 * part @ c.T).argmin(1)
    return out


@dataclass
class Index:
    """Centroids of both halves and the number of vectors in each cell."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray | None = None
    sample: np.ndarray | None = None  # vectors, rids and cells of the sample
    rids: np.ndarray | None = None
    own: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        return nearest(x[:, :half], self.left) * len(self.right) + nearest(x[:, half:], self.right)

    def walk(self, q: np.ndarray, need: int) -> list[int]:
        """Cells in order of summed distance (negated inner product) until they hold ``need`` vectors."""
        half = self.left.shape[1]
        a, b = -(self.left @ q[:half]), -(self.right @ q[half:])
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen, held, out = [(a[i_order[0]] + b[j_order[0]], 0, 0)], {(0, 0)}, 0, []
        while heap and held < need:
            _, i, j = heapq.heappop(heap)
            cell = int(i_order[i]) * len(self.right) + int(j_order[j])
            n = int(self.counts[cell])
            if n:
                out.append(cell)
                held += n
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[i_order[x]] + b[j_order[y]], x, y))
        return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors score equally."""
    return (x * q).sum(-1)


def calibrate(index: Index, sample: np.ndarray, top: int = TOP, probes: int = PROBES, recall: float = RECALL) -> float:
    """The share of vectors to visit for the target recall, measured on the sample by brute force."""
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.left) * len(index.right))
    local = Index(index.left, index.right, counts)
    step = max(1, len(sample) // probes)
    shares = []
    for p in range(0, len(sample), step):
        s = sample @ sample[p]
        s[p] = -np.inf
        best = np.argpartition(-s, min(top, len(s) - 1))[:top]
        order = local.walk(sample[p], len(sample))
        upto = np.zeros(len(counts))
        upto[order] = np.cumsum(counts[order])
        shares += (upto[cells[best]] / len(sample)).tolist()
    return float(min(1.0, np.quantile(shares, recall) * 1.02)) if shares else 1.0


def centroids(total: int, sampled: int) -> int:
    return int(min(MOST, max(2, round((total / PER_CELL) ** 0.5)), max(2, sampled // 8)))


def build(vectors: DataFrame, sample_size: int = SAMPLE, **options) -> tuple[Index, float, DataFrame]:
    """Index, share to visit, and all vectors (of one length) with their cell (a written table)."""
    total = vectors.count()
    if not total:
        return Index(np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1, np.int64)), 1.0, vectors.withColumn("cell", F.lit(0))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(sample_size).toArrow()
    sample = _matrix(picked.column("v"))
    half = max(1, sample.shape[1] // 2)
    k = centroids(total, len(sample))
    index = Index(lloyd(sample[:, :half], k), lloyd(sample[:, half:] if sample.shape[1] > 1 else np.zeros((len(sample), 1)), k))
    if sample.shape[1] == 1:
        index.right = np.zeros((1, 0))
    share = calibrate(index, sample, **options)
    index.sample, index.rids, index.own = sample, np.asarray(picked.column("rid").combine_chunks()), index.cells(sample)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(Index(index.left, index.right))

    def assign(batch: pa.RecordBatch):
        if batch.num_rows:
            cells = shared.value.cells(_matrix(batch.column("v")))
            yield pa.table([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    celled = materialise(map_batches(vectors.select("rid", "vec_id", "v"), assign, "rid long, vec_id long, v array<double>, cell long"), "ann-cells")
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MOST * MOST cells
        counts[r.cell] = r.n
    index.counts = counts
    return index, share, celled


_HITS = "q long, query_id long, vec_id long, score double"
_HIT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]


def _packed(q: np.ndarray) -> bytes:
    """Query vectors, in single precision where that is exact."""
    small = q.astype(np.float32)
    return b"f" + small.tobytes() if (small == q).all() else b"d" + q.tobytes()


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).astype(np.float64).reshape(-1, dim)


def search(queries: DataFrame, celled: DataFrame, index: Index, share: float, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest found; a row is no candidate for itself.

    Blocks of a cell and batches of the queries that visit it are joined on the cell and a block number, so a cell
    that holds a third of all vectors is spread over tasks; each task sends at most ``top`` rows per query and block, and
    the best are kept by a ranking that is cut off before it is shuffled.
    """
    spark = queries.sparkSession
    total = int(index.counts.sum())
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    need = int(np.ceil(share * total)) + 1
    shared = spark.sparkContext.broadcast(index)
    blocks = {c: max(1, -(-int(n) // BLOCK)) for c, n in enumerate(index.counts) if n}
    n_blocks = spark.sparkContext.broadcast(blocks)
    dim = index.sample.shape[1]

    def visit(batch: pa.RecordBatch):
        own_index = shared.value
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rids, ids, qv = np.asarray(part.column("rid")), np.asarray(part.column("vec_id")), _matrix(part.column("v"))
            near = qv @ own_index.sample.T
            near[rids[:, None] == own_index.rids[None, :]] = -np.inf
            floor = np.full(len(qv), -np.inf)
            by_cell: dict[int, list[int]] = {}
            for k, q in enumerate(qv):
                seen = np.zeros(len(own_index.counts), bool)
                for c in own_index.walk(q, need):
                    by_cell.setdefault(c, []).append(k)
                    seen[c] = True
                s = near[k][seen[own_index.own]]
                if len(s) >= top:  # so many are found already
                    least = np.partition(s, len(s) - top)[len(s) - top]
                    floor[k] = least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else -np.inf
            columns: list[list] = [[] for _ in range(6)]
            for c, rows in by_cell.items():
                for lo in range(0, len(rows), 256):
                    own = rows[lo:lo + 256]
                    packed = (rids[own].tobytes(), ids[own].tobytes(), _packed(qv[own]), floor[own].tobytes())
                    for b in range(n_blocks.value[c]):
                        for column, v in zip(columns, (c, b, *packed)):
                            column.append(v)
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cell", "block", "rids", "ids", "vectors", "floor"])

    visits = map_batches(queries.select("rid", "vec_id", "v"), visit, "cell long, block int, rids binary, ids binary, vectors binary, floor binary")

    def number(batch: pa.RecordBatch):
        rids, cells = np.asarray(batch.column("rid")).astype(np.uint64), np.asarray(batch.column("cell"))
        mixed = (rids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        parts = np.array([n_blocks.value.get(int(c), 1) for c in cells], np.uint64)
        yield pa.table([*batch.columns, pa.array((mixed % np.maximum(parts, np.uint64(1))).astype(np.int32))], names=[*batch.schema.names, "block"])

    numbered = map_batches(celled, number, "rid long, vec_id long, v array<double>, cell long, block int")

    def compare(left, right):
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            x, ids, own = _matrix(right.column("v")), np.asarray(right.column("vec_id")), np.asarray(right.column("rid"))
            for raws in zip(*(left.column(c).to_pylist() for c in ("rids", "ids", "vectors", "floor"))):
                rids, qids, floor = np.frombuffer(raws[0], np.int64), np.frombuffer(raws[1], np.int64), np.frombuffer(raws[3], np.float64)
                q = _unpacked(raws[2], dim)
                rough = q @ x.T
                rough[rids[:, None] == own[None, :]] = -np.inf
                k = min(top, x.shape[0])
                bar = np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k]
                bar = np.maximum(bar - 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0))), floor)
                for r in np.flatnonzero((rough >= bar[:, None]).any(1)):
                    cand = np.flatnonzero((rough[r] >= bar[r]) & np.isfinite(rough[r]))
                    s = exact_scores(q[r], x[cand])
                    best = np.lexsort((ids[cand], -s))[:top]
                    for column, v in zip(out, (np.full(len(best), rids[r]), np.full(len(best), qids[r]), ids[cand][best], s[best])):
                        column.append(v)
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, _HIT_TYPES)], names=["q", "query_id", "vec_id", "score"])

    hits = visits.groupBy("cell", "block").cogroup(numbered.groupBy("cell", "block")).applyInArrow(compare, _HITS)
    order = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, modulus: int = QUERY_MODULUS, top: int = TOP, **options) -> DataFrame:
    """``search`` over the usable rows of each vector length, the rows whose vec_id ``modulus`` divides being the queries."""
    rows = materialise(usable(vectors).withColumn("n", F.size("v")), "ann-rows")  # written, so that rid stays what it is
    lengths = [r.n for r in rows.select("n").distinct().orderBy("n").collect()]  # a table has one, or few
    out = None
    for n in lengths or [0]:
        index, share, celled = build(rows.where(F.col("n") == n).drop("n"), **options)
        found = search(celled.where(F.col("vec_id") % modulus == 0), celled, index, share, top)
        out = found if out is None else out.unionByName(found)
    release(rows)
    return out


def op7_ann_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other rows of every row whose vec_id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings"))
