"""Nearest neighbours by a block matrix join.

Queries are dealt into stripes and candidates into columns; each meeting of a stripe and a column is one cell, a task of its
own. Rows reach their cells in one exchange (queries are repeated by column, candidates by stripe), so there is no join
whose smaller side Spark could send through the driver. A cell holds its stripe and reads its column as it comes, tile by
tile. In a tile the vectors are quantised to int8; one matrix product of the codes, with the lengths of the quantisation
errors as two more columns, bounds all inner products from above (Cauchy-Schwarz). Pairs whose bound reaches the query's
k-th best score so far are computed again in double precision, so a cell's k best are exact. Cells hand on k pairs a
query; heaps merge them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.common import materialise

#: Rows of a column at least, of a stripe at most, and of a stripe's vectors in bytes; a tile is PART queries by STEP candidates.
CANDIDATE_BLOCK, QUERY_BLOCK, STRIPE_BYTES, PART, STEP = 4096, 262144, 64 << 20, 1024, 2048
#: Columns that are enough, if these or the stripes give each core two cells.
COLUMNS = 12
#: Pairs that are computed again at once; pairs of a part that wait to be sorted in.
PAIRS, WAITING = 32768, 16384
#: Relative slack for the rounding of the bounds themselves.
SLACK = 1e-6


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, length of the quantised vector, length of the error) of each row; codes are int8 values."""
    # So small that a 127th of the largest is 0: its smallest unit instead.
    scale = np.maximum(np.abs(vectors).max(axis=1) / 127.0, np.nextafter(0.0, 1.0))
    codes = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, lengths(near), lengths(vectors - near)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """The length of each row, also of rows whose squares would vanish or overflow."""
    most = np.abs(vectors).max(axis=1)
    unit = np.where(most > 0, most, 1.0)
    return unit * np.sqrt(((vectors / unit[:, None]) ** 2).sum(axis=1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer products of int8 codes. Floats hold them exactly: sums stay under 2**24 up to 1040 dimensions."""
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def _bounds(q: tuple, q_len: np.ndarray, c: tuple, c_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, unit): ``upper * unit[:, None]`` is at least each inner product. q and c: from ``quantise``."""
    (q_codes, q_scale, q_near, q_off), (codes, scale, near, off) = q, c
    dim, most = codes.shape[1], scale.max()
    tame = dim <= 1040 and 1e-100 < q_scale.min() and q_scale.max() < 1e100 and 1e-100 < scale.min() and most < 1e100 and most < 1e25 * scale.min()
    if not tame:
        with np.errstate(over="ignore", invalid="ignore"):
            wide = q_near[:, None] * off + q_off[:, None] * c_len + SLACK * q_len[:, None] * c_len
            upper = _product(q_codes, codes) * (q_scale[:, None] * scale) + wide
        return np.where(np.isnan(upper), np.inf, upper), np.ones(len(q_scale))
    # Rounding to floats: each of dim + 2 terms is off by 2**-24 of at most (|q| + its error) * (|c| + its error).
    more = (SLACK + 8 * (dim + 8) * 2.0**-24) * (q_len + q_off)
    left = np.column_stack([q_codes, (q_near + more) / q_scale, (q_off + more) / q_scale]).astype(np.float32)
    right = np.column_stack([codes * (scale / most)[:, None], off / most, c_len / most]).astype(np.float32)
    return left @ right.T, q_scale * most


def _exact(q: np.ndarray, rows: np.ndarray, c: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The inner products of these pairs in double precision."""
    found = [np.einsum("ij,ij->i", q[rows[s : s + PAIRS]].astype("f8"), c[cols[s : s + PAIRS]]) for s in range(0, len(rows), PAIRS)]
    return np.concatenate(found) if found else np.zeros(0)


class Part:
    """Queries of one dimension and their k best so far: ``ids`` and ``scores``, best first, as many as ``found`` has."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.ids, self.scores = np.zeros((len(q_ids), k), "i8"), np.zeros((len(q_ids), k))
        self.found, self.floor = np.zeros(len(q_ids), "i4"), np.full(len(q_ids), -np.inf)
        self.codes, self.len = quantise(q.astype("f8")), lengths(q.astype("f8"))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, ids: np.ndarray, c: np.ndarray, codes: tuple, c_len: np.ndarray) -> None:
        """A tile: candidates ``c`` in double precision, what ``quantise`` gives of them, and their lengths."""
        upper, unit = _bounds(self.codes, self.len, codes, c_len)
        fresh = np.flatnonzero(self.floor == -np.inf)
        if len(fresh) and len(ids) > self.k:  # any k pairs give a floor; those of the highest bounds a good one
            high = np.where(self.q_ids[fresh, None] == ids, -np.inf, upper[fresh])
            cols = np.argpartition(high, -self.k, axis=1)[:, -self.k :]
            least = _exact(self.q, np.repeat(fresh, self.k), c, cols.ravel()).reshape(cols.shape).min(axis=1)
            own = (self.q_ids[fresh, None] == ids[cols]).any(axis=1)
            self.floor[fresh] = np.where(own | np.isnan(least), -np.inf, least)
        with np.errstate(over="ignore"):
            floor = np.nextafter((self.floor / unit).astype(upper.dtype), upper.dtype.type(-np.inf))
        rows, cols = np.divmod(np.flatnonzero(upper >= floor[:, None]), len(ids))
        other = self.q_ids[rows] != ids[cols]
        rows, cols = rows[other], cols[other]
        for s in range(0, len(rows), WAITING):
            r, at = rows[s : s + WAITING], cols[s : s + WAITING]
            scores = _exact(self.q, r, c, at)
            keep = ~(scores < self.floor[r])
            self.waiting.append((r[keep], ids[at[keep]], scores[keep]))
            if sum(len(w[0]) for w in self.waiting) >= WAITING:
                self.sort_in()

    def sort_in(self) -> None:
        """What waits is merged with the k best."""
        if not self.waiting:
            return
        held = np.arange(self.k) < self.found[:, None]
        rows = np.concatenate([np.nonzero(held)[0], *[w[0] for w in self.waiting]])
        ids = np.concatenate([self.ids[held], *[w[1] for w in self.waiting]])
        scores = np.concatenate([self.scores[held], *[w[2] for w in self.waiting]])
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        n = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, n, order = rows[n < self.k], n[n < self.k], order[n < self.k]
        self.ids[rows, n], self.scores[rows, n] = ids[order], scores[order]
        self.found = np.bincount(rows, minlength=len(self.q_ids)).astype("i4")
        full = self.found == self.k
        last = self.scores[full, -1]
        self.floor[full] = np.maximum(self.floor[full], np.where(np.isnan(last), -np.inf, last))
        self.waiting = []


def _by_dimension(b: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) of a batch's columns id and vector."""
    size = np.diff(b.column("vector").offsets.to_numpy())
    flat, ends = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(size)
    own = b.column("id").to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        take = np.flatnonzero(size == dim)
        yield int(dim), own[take], flat[(ends[take] - dim)[:, None] + np.arange(dim)]


_BEST = {"stripe": pa.int32(), "dim": pa.int32(), "part": pa.int32(), "query_ids": pa.binary(), "found": pa.binary(), "ids": pa.binary(), "scores": pa.binary()}


class Cell:
    """A stripe of queries that meets candidates as they come; all its queries come first, in the same order in each column."""

    def __init__(self, stripe: int, k: int, kind: str):
        self.stripe, self.k, self.kind, self.parts = stripe, k, kind, None
        self.queries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def ask(self, b: pa.RecordBatch) -> None:
        for dim, ids, vectors in _by_dimension(b, self.kind):
            self.queries.setdefault(dim, []).append((ids, vectors))

    def meet(self, b: pa.RecordBatch) -> None:
        if self.parts is None:
            self.parts = {}
            for dim in sorted(self.queries):
                ids, vectors = map(np.concatenate, zip(*self.queries.pop(dim)))
                self.parts[dim] = [Part(ids[s : s + PART], vectors[s : s + PART], self.k) for s in range(0, len(ids), PART)]
        for dim, ids, vectors in _by_dimension(b, "f8"):
            for s in range(0, len(ids) if dim in self.parts else 0, STEP):
                c = vectors[s : s + STEP]
                codes, c_len = quantise(c), lengths(c)
                for part in self.parts[dim]:
                    part.meet(ids[s : s + STEP], c, codes, c_len)

    def best(self) -> Iterator[pa.RecordBatch]:
        for dim, parts in (self.parts or {}).items():
            for n, part in enumerate(parts):
                part.sort_in()
                row = [self.stripe, dim, n, *[x.tobytes() for x in (part.q_ids, part.found, part.ids, part.scores)]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BEST.values())], names=list(_BEST))


def _merge(k: int):
    def merge(group: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x, kind) for x in group.column(name).to_pylist()]
        q_ids = read("query_ids", "i8")[0]
        cells = list(zip(read("found", "i4"), [x.reshape(-1, k) for x in read("ids", "i8")], [-x.reshape(-1, k) for x in read("scores", "f8")]))
        out: list[tuple[int, int, int, float]] = []
        for n, own in enumerate(q_ids.tolist()):
            found = [zip(scores[n, : many[n]].tolist(), ids[n, : many[n]].tolist()) for many, ids, scores in cells]
            out.extend((own, rank, i, -s) for rank, (s, i) in enumerate(islice(heapq.merge(*found), k), 1))
        kinds = {"query_id": pa.int64(), "rank": pa.int32(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({name: pa.array([o[n] for o in out], t) for n, (name, t) in enumerate(kinds.items())})

    return merge


def nearest(df: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``is_query`` (a column), its k nearest other rows.

    Nearest: largest inner product in double precision, ties to the smaller id; all candidates if fewer than k. Rows with
    a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part. Vectors only
    meet those of their own dimension. A row whose id equals the query's is the query's own. Rows that repeat an id
    appear as often as they are. No rows or no queries: none. Other columns are not used. A column has
    ``candidate_block`` candidates or more, a stripe about ``query_block`` queries or fewer.
    """
    kind = "f4" if "float" in dict(df.dtypes)[vector_col] else "f8"
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asked, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    stripes = max(1, ceil(asked / max(1, min(query_block, STRIPE_BYTES // (np.dtype(kind).itemsize * dim)))))
    enough = max(COLUMNS, ceil(2 * df.sparkSession.sparkContext.defaultParallelism / stripes))
    columns = max(1, min(ceil(n / candidate_block), enough))
    # Numbers are written, so that a query has the same one in every column.
    asking = materialise(rows.filter("asks").select(F.monotonically_increasing_id().alias("number"), "id", "vector"), "knn-queries")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))) if many > 1 else F.lit(0)
    asking = asking.select("*", F.pmod(F.xxhash64("number"), F.lit(stripes)).cast("int").alias("stripe")).select("*", every(columns).alias("column"))
    held = rows.select(F.lit(None).cast("long").alias("number"), "id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(columns)).cast("int").alias("column")).select("*", every(stripes).alias("stripe"))
    cells = asking.unionByName(held).select((F.col("stripe") * columns + F.col("column")).alias("cell"), "number", "id", "vector")
    cells = cells.repartitionById(stripes * columns, "cell").sortWithinPartitions("cell", F.col("number").asc_nulls_last())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for b in batches:
            own = b.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if own[start] != at:
                    if now is not None:
                        yield from now.best()
                    at = own[start]
                    now = Cell(int(at) // columns, k, kind)
                some = b.slice(start, end - start)
                asks = len(some) - some.column("number").null_count
                if asks:
                    now.ask(some.slice(0, asks))
                if asks < len(some):
                    now.meet(some.slice(asks))
        if now is not None:
            yield from now.best()

    names = {pa.int32(): "int", pa.binary(): "binary"}
    best = cells.mapInArrow(work, ", ".join(f"{name} {names[t]}" for name, t in _BEST.items()))
    return best.groupBy("stripe", "dim", "part").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op4_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` to each row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: DuckDB: all pairs in double precision.
OP4_SQL = """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from p)
    select query_id, n::int as rank, vec_id, score from r where n <= 20"""
