"""Approximate nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length one, so that the largest inner product is the largest cosine. A product
quantiser with 16 centroids in each subspace is fitted on at most SAMPLE vectors (those with the smallest
hash of their id). Its loss weights the part of the residual that is parallel to the vector ETA times the
part across it, as only the former moves the scores that matter for maximum inner products: codes are
assigned by coordinate descent on that loss, centroids solve its normal equations.

The index holds every vector: blocks of up to BLOCK rows with ids, four-bit codes (two in a byte) and the
original vectors. A search takes a block of codes and a block of queries: for each query a table of 256
sums for each byte, one addition a byte and vector, then the RERANK best of the block by that score are
scored exactly, in double precision on the original vectors. The k-th of these scores is a floor: every row
whose quantised score can, by its own quantisation error, belong to an exact score of the floor or more is
scored exactly too, however many there are, and the best k of the block remain. The best k over all blocks
are the answer. So groups of near or exact copies, whose codes tie, hide no neighbour.

Scale: the query set goes to the vectors, block by block, as it is the smaller: each block of vectors is shuffled
once, each block of queries once for every block of vectors (a fiftieth of the rows against all rows, 8 times less
than the other way round). A task holds one block of each at a time. Nothing is broadcast but the centroids, whose
size is fixed; no numbers or rows are listed at the driver.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and those of
another dimension than most of the sample, take no part, neither as queries nor as candidates. Fewer than
k candidates are all returned. Equal scores go to the smaller id; copies of a vector are all candidates.
Rows without an id take no part. Rows with a query's id are not its candidates; rows that repeat a query's id ask
once, with the first of their vectors in order of its components. Other input columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

SAMPLE, BLOCK, QUERIES, RERANK = 8192, 16_384, 2048, 96
CENTROIDS, WIDTH, ROUNDS, THRESHOLD = 16, 2, 4, 0.2
SLACK = 1e-5  # above the rounding of single-precision tables and sums


def usable(vector):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Quantiser:
    """centroids: subspaces x 16 x width; eta: weight of the parallel part of the residual."""

    def __init__(self, centroids: np.ndarray, eta: float, dim: int):
        self.centroids, self.eta, self.dim = centroids, eta, dim

    @staticmethod
    def _parts(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % (2 * WIDTH)  # an even number of subspaces, as two codes share a byte
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, WIDTH)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11) -> Quantiser:
        """x: vectors of length one."""
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        parts = cls._parts(x)
        start = rng.integers(len(x), size=(parts.shape[1], CENTROIDS))
        q = cls(np.stack([parts[start[m], m] for m in range(parts.shape[1])]), eta, dim)
        for _ in range(ROUNDS):
            q._update(parts, q.assign(x))
        return q

    def assign(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) by coordinate descent on |r|^2 + (eta - 1) <r, x>^2, r: residual."""
        parts = self._parts(x)
        n, subs, _ = parts.shape
        error = ((parts[:, :, None] - self.centroids[None]) ** 2).sum(axis=3)
        along = ((parts[:, :, None] - self.centroids[None]) * parts[:, :, None]).sum(axis=3)
        codes = error.argmin(axis=2)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(passes):
            for m in range(subs):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (error[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def _update(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Centroids that minimise the loss for these codes: one linear system over all of them."""
        n, subs, w = parts.shape
        size = subs * CENTROIDS * w
        place = (np.arange(subs) * CENTROIDS + codes)[:, :, None] * w + np.arange(w)
        g = np.zeros((n, size), np.float32)
        np.put_along_axis(g, place.reshape(n, -1), parts.reshape(n, -1).astype(np.float32), 1)
        counts = np.bincount(place.ravel(), minlength=size)
        right = np.bincount(place.ravel(), parts.ravel(), size) + (self.eta - 1) * g.sum(axis=0)
        left = (self.eta - 1) * (g.T @ g).astype(np.float64)
        left[np.diag_indices(size)] += counts + 1e-3
        self.centroids = np.linalg.solve(left, right + 1e-3 * self.centroids.ravel()).reshape(subs, CENTROIDS, w)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of codes the 256 sums of its two subspaces."""
        parts = self._parts(q)
        t = np.einsum("nsw,scw->nsc", parts, self.centroids)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """vectors: vec_id, embedding. A quantiser, or None if there is no usable vector."""
    rows = C.smallest(vectors.where(usable(vectors["embedding"])).select(F.xxhash64("vec_id", "embedding").alias("h"), "vec_id", "embedding"), "h", sample)
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["h"], str(r["vec_id"])))
    dims = np.bincount([len(r["embedding"]) for r in rows])
    x = np.array([r["embedding"] for r in rows if len(r["embedding"]) == dims.argmax()], np.float64)
    return Quantiser.fit(x / np.linalg.norm(x, axis=1, keepdims=True))


def _blocks(dim: int, size: int, quantiser: Quantiser | None):
    """Rows vec_id, embedding to blocks: ids, vectors and, with a quantiser, codes."""

    def emit(ids, vectors):
        x = np.concatenate(vectors)
        ids = np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        codes = b""
        if quantiser:
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = b"".join(pack(quantiser.assign(unit[i : i + 2048])).tobytes() for i in range(0, len(unit), 2048))
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()]), pa.array([codes], pa.binary())], ["ids", "vectors", "codes"])

    def run(batches):
        ids, vectors, n = [], [], 0
        for batch in batches:
            at = 0
            i = batch.column(0).to_numpy().astype(np.int64)
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            while at < len(i):
                take = min(size - n, len(i) - at)
                ids.append(i[at : at + take])
                vectors.append(x[at : at + take])
                n, at = n + take, at + take
                if n == size:
                    yield emit(ids, vectors)
                    ids, vectors, n = [], [], 0
        if n:
            yield emit(ids, vectors)

    return run


BLOCKS = "ids binary, vectors binary, codes binary"


def blocks(vectors: DataFrame, dim: int, size: int, quantiser: Quantiser | None = None) -> DataFrame:
    rows = vectors.where(usable(vectors["embedding"]) & (F.size("embedding") == dim)).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.where("vec_id IS NOT NULL").mapInArrow(_blocks(dim, size, quantiser), BLOCKS).withColumn("block", F.monotonically_increasing_id())


def best_rows(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores; of equal ones the first."""
    if len(score) <= n:
        return np.arange(len(score))
    bound = np.partition(score, len(score) - n)[len(score) - n]
    above = np.flatnonzero(score > bound)
    return np.concatenate([above, np.flatnonzero(score == bound)[: n - len(above)]])


def code_errors(x: np.ndarray, codes: np.ndarray, quantiser: Quantiser) -> tuple[np.ndarray, np.ndarray]:
    """For vectors of length one and their packed codes: the reconstruction's part along the vector, and the length of the rest.

    With these, along and across, a query of length one whose exact score is s or more has a quantised score of at least
    along * s - across * sqrt(1 - s * s), as long as the two angles together stay below half a turn.
    """
    parts = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)
    near = quantiser.centroids[np.arange(parts.shape[1]), parts].reshape(len(codes), -1)
    x = np.pad(x, ((0, 0), (0, near.shape[1] - x.shape[1])))
    along = (near * x).sum(axis=1)
    return along, np.sqrt(((near - along[:, None] * x) ** 2).sum(axis=1))


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums of rows from the first column to the last, so that they come out alike wherever they are made."""
    out = products[:, 0].copy()
    for column in products.T[1:]:
        out += column
    return out


def search_block(ids, x, codes, query_ids, q, quantiser: Quantiser, k: int, rerank: int):
    """The k best rows of a block for each query: (query, row id, exact cosine)."""
    out_q, out_i, out_s = [], [], []
    square, q_square = _summed(x * x), _summed(q * q)
    norm, q_norm = np.sqrt(square), np.sqrt(q_square)
    columns = np.ascontiguousarray(codes.T)
    along, across = code_errors(x / norm[:, None], codes, quantiser)
    for begin in range(0, len(q), 256):
        tables = quantiser.tables(q[begin : begin + 256] / q_norm[begin : begin + 256, None])
        for j, table in enumerate(tables, begin):
            score = table[0][columns[0]]
            for b in range(1, len(columns)):
                score += table[b][columns[b]]
            exactly = lambda rows: np.clip(_summed(x[rows] * q[j]) / np.sqrt(square[rows] * q_square[j]), -1, 1)  # noqa: B023, E731
            rows = best_rows(score, rerank + 1)
            rows = rows[ids[rows] != query_ids[j]]
            exact = exactly(rows)
            if len(rows) + 1 < len(ids):
                floor = np.partition(exact, len(exact) - k)[len(exact) - k] - SLACK if len(exact) >= k else -1.0
                sine = np.sqrt(max(0.0, 1 - floor * floor))
                can = (score >= along * floor - across * sine - SLACK) | (along * sine + across * floor < 0)
                rows = np.flatnonzero(can & (ids != query_ids[j]))
                if len(rows) > len(ids) // 8:  # one product finds those worth the exact sum
                    rows = rows[(x @ q[j])[rows] >= (floor - SLACK) * norm[rows] * q_norm[j]]
                exact = exactly(rows)
            rows, exact = rows[top := np.lexsort((ids[rows], -exact))[:k]], exact[top]
            out_q.append(np.full(len(rows), query_ids[j]))
            out_i.append(ids[rows])
            out_s.append(exact)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def search(index: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """index, queries: blocks. Returns query_id, rank, vec_id, score."""
    # a stated set of queries against all rows, in blocks: one row here for each pair of blocks
    asked = queries.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).crossJoin(index.select("block"))
    pairs = asked.join(index, "block").select("ids", "vectors", "codes", "q_ids", "q_vectors")
    dim = quantiser.dim

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                x, q = np.frombuffer(row["vectors"]).reshape(-1, dim), np.frombuffer(row["q_vectors"]).reshape(-1, dim)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                found = search_block(ids, x, codes, query_ids, q, quantiser, k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 5, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of every row of vectors (vec_id, embedding) for which is_query holds."""
    spark = C.prepare(vectors.sparkSession)
    quantiser = fit(vectors, sample)
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = C.materialise(blocks(vectors, quantiser.dim, BLOCK, quantiser), "index")
    asked = vectors.where(is_query).where(usable(vectors["embedding"]) & (F.size(vectors["embedding"]) == quantiser.dim))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = C.materialise(blocks(asked, quantiser.dim, QUERIES), "queries")
    return search(index, queries, quantiser, k, rerank)


def op10_ann(spark, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM usable q JOIN usable v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
