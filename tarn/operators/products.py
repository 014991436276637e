"""Inner products of many queries and many rows, block by block: the products are matrix products inside tasks, and a
task passes on the best rows of each query of its block alone.

What a block keeps is enough for the whole: rows that are, to nine places, worse than its k-th are never among the
first k, and of rows with equal scores only the k smallest ids can be.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import dot

#: Queries and rows that one task holds against each other.
BLOCK_QUERIES, BLOCK_ROWS = 2_048, 16_384
#: Products that are worked out at a time.
TOGETHER = 1 << 21
#: Scores are told apart to nine places.
NEAR = 2e-9
#: Words whose bucket a worker remembers.
WORDS = 1 << 18


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Holds what Spark hands to Python at a time to some megabytes, unless the session has less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among the first k."""
    order = np.lexsort((ids, -scores))
    ranked = scores[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    turn = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return order[(turn < k) & (ranked >= ranked[min(k, len(ranked)) - 1] - NEAR)]


def _in_order(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, as the columns do."""
    out = np.zeros(len(rows))
    for x, column in zip(q, rows.T, strict=True):
        out += x * column
    return out


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _nearest(k: int, names: list[str], types: list[pa.DataType]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = _vectors(left.column("q")), _vectors(right.column("v")) if right.num_rows else np.zeros((0, 1))
        out = [], [], []
        if len(q) and len(v):
            qids, ids = left.column("qid").to_numpy(), right.column("id").to_numpy()
            slack = NEAR + 1e-13 * q.shape[1] * np.sqrt((q * q).sum(1) * (v * v).sum(1).max())
            step = max(1, TOGETHER // len(v))
            for start in range(0, len(q), step):
                about = q[start : start + step] @ v.T
                for i, row in enumerate(about, start):
                    others = np.flatnonzero(ids != qids[i])
                    if not len(others):
                        continue
                    row = row[others]
                    if len(row) > k:
                        others = others[row >= np.partition(row, len(row) - k)[len(row) - k] - 2 * slack[i]]
                    exact = _in_order(q[i], v[others])
                    kept = best(exact, ids[others], k)
                    out[0].append(np.full(len(kept), qids[i]))
                    out[1].append(ids[others[kept]])
                    out[2].append(exact[kept])
        columns = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types, strict=True)]
        return pa.Table.from_arrays(columns, names)

    return run


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, *, id_: str, vector: str) -> DataFrame:
    """qid, id, score: for each query at least its k rows of largest inner product, itself left out. Ids are numbers.

    Vectors of the usual length and of finite components go by blocks; rows that are null, shorter, longer or hold
    other components are held against each other one by one (their scores are null or not finite)."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    sizes = vectors.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(finite, F.lit(False)) & F.col(id_).isNotNull()).alias("fine"))
    usual = sizes.orderBy(F.desc("fine"), "size").first()
    n, n_queries = vectors.count(), queries.count()
    plain = F.coalesce((F.size(vector) == (usual["size"] if usual else 0)) & finite & F.col(id_).isNotNull(), F.lit(False))
    dealt = lambda of: F.pmod(F.xxhash64(of), F.lit(max(1, -(-n // BLOCK_ROWS)))).cast("int")
    rows, asked = -(-n // BLOCK_ROWS) or 1, -(-n_queries // BLOCK_QUERIES) or 1
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    x = queries.where(plain).select(F.col(id_).alias("qid"), F.col(vector).alias("q"), F.pmod(F.xxhash64(id_), F.lit(asked)).cast("int").alias("a"), every(rows).alias("b"))
    y = vectors.where(plain).select(F.col(id_).alias("id"), F.col(vector).alias("v"), dealt(id_).alias("b"), every(asked).alias("a"))
    kind = vectors.schema[id_].dataType
    types = [to_arrow_type(kind), to_arrow_type(kind), pa.float64()]
    run = _nearest(k, ["qid", "id", "score"], types)
    found = x.groupBy("a", "b").cogroup(y.groupBy("a", "b")).applyInArrow(run, f"qid {kind.simpleString()}, id {kind.simpleString()}, score double")
    if n == (usual["fine"] if usual else 0):
        return found
    q = queries.select(F.col(id_).alias("qid"), F.col(vector).alias("q"), plain.alias("fine"))
    odd = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v"), plain.alias("sound")).join(q, ~F.col("fine") | ~F.col("sound"))
    return found.unionByName(odd.where("id <> qid").select("qid", "id", dot(F.col("q"), F.col("v")).alias("score")))


_buckets: dict[bytes, int] = {}


def _bucket(word: bytes) -> int:
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) >= WORDS:
            _buckets.clear()
        found = _buckets[word] = int(hashlib.md5(word).hexdigest()[:7], 16)
    return found


class Best:
    """The best documents of each query so far. Documents come in the order of their ids, so places tell smaller ones."""

    def __init__(self, queries: int, k: int):
        self.k, self.most = k, 4 * queries * k + (1 << 16)
        self.q, self.p, self.s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        self.least = np.full(queries, -np.inf)  # what a score must reach to be among the first k
        self.ids: list = []  # ids of the places

    def add(self, ids: list, scores: np.ndarray) -> None:
        """Scores by document and query; those above 0 count."""
        if not len(self.q) and len(ids) > self.k:
            self.least = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k] - NEAR
        at, q = np.nonzero((scores > 0) & (scores >= self.least))
        if not len(at):
            return
        used, at_used = np.unique(at, return_inverse=True)
        self.q, self.s, self.p = np.append(self.q, q), np.append(self.s, scores[at, q]), np.append(self.p, len(self.ids) + at_used)
        self.ids += [ids[u] for u in used.tolist()]
        if len(self.q) > self.most:
            self.prune()

    def prune(self) -> None:
        """Leaves of each query what best() would."""
        order = np.lexsort((self.p, -self.s, self.q))
        q, s, p = self.q[order], self.s[order], self.p[order]
        if not len(q):
            return
        fresh = np.append(True, q[1:] != q[:-1])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(q)))
        kth = s[starts + np.minimum(self.k, sizes) - 1]
        full = sizes >= self.k
        self.least[q[starts[full]]] = kth[full] - NEAR
        ties = np.flatnonzero(fresh | np.append(True, s[1:] != s[:-1]))
        turn = np.arange(len(q)) - np.repeat(ties, np.diff(np.append(ties, len(q))))
        kept = (turn < self.k) & (s >= np.repeat(kth, sizes) - NEAR)
        used, p = np.unique(p[kept], return_inverse=True)
        self.q, self.s, self.p, self.ids = q[kept], s[kept], p, [self.ids[u] for u in used.tolist()]

    def rows(self, qids: list, types: list[pa.DataType], names: list[str]):
        self.prune()
        if len(self.q):
            columns = [pa.array([qids[i] for i in self.q.tolist()], types[0]), pa.array([self.ids[i] for i in self.p.tolist()], types[1]), pa.array(self.s, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)


def _triples(weights: list, column: str) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray]:
    """Queries and values of the column, and per weight the places of both and w."""
    qids, values = (list(dict.fromkeys(r[c] for r in weights)) for c in ("id", column))
    of_q, of_v = ({x: i for i, x in enumerate(xs)} for xs in (qids, values))
    return qids, values, np.array([of_q[r["id"]] for r in weights], int), np.array([of_v[r[column]] for r in weights], int), np.array([r["w"] for r in weights], float)


def bm25_best(tokens: DataFrame, weights: list, avgdl: float, k: int, qid_type, k1: float, b: float) -> DataFrame:
    """qid, doc_id, score: for each query at least its k documents of largest BM25 score among those with a term of it.
    tokens: doc_id, known, dealt by doc_id; scores of rows of one id are added up, after those of one length have become
    one row. weights: rows (id, term, w) of the queries, w the idf by how often the query names the term.

    A block of documents is a matrix of documents by asked terms, its scores the product with the queries' weights."""
    qids, terms, at, of, w = _triples(weights, "term")
    id_type = tokens.schema["doc_id"].dataType
    types, names = [to_arrow_type(qid_type), to_arrow_type(id_type), pa.float64()], ["qid", "doc_id", "score"]

    def run(batches):
        asked = np.zeros((len(terms), len(qids)))
        asked[of, at] = w
        step = max(1, TOGETHER // max(len(terms), len(qids), 1))
        top = Best(len(qids), k)
        known = None

        def take(ids: list, docs: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> None:
            """Adds whole documents: ids by document; by row the document (from 0) and the size; by token the asked term or -1."""
            ends = np.append(0, np.cumsum(sizes))
            for start in range(0, len(ids), step):
                end = min(start + step, len(ids))
                lo, hi = np.searchsorted(docs, [start, end])
                doc, size = docs[lo:hi], sizes[lo:hi]
                fresh = np.append(True, (doc[1:] != doc[:-1]) | (size[1:] != size[:-1]))
                group, firsts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
                code = codes[ends[lo] : ends[hi]]
                cell = np.repeat(group * len(terms), size) + code
                tf = np.bincount(cell[code >= 0], minlength=len(firsts) * len(terms)).astype(np.float64).reshape(len(firsts), len(terms))
                part = tf + (k1 * (1 - b + b * size[firsts] / avgdl))[:, None]
                part = np.divide(tf * (k1 + 1), part, out=np.zeros_like(tf), where=tf > 0)
                if len(firsts) > end - start:
                    part = np.add.reduceat(part, np.flatnonzero(np.append(True, np.diff(doc[firsts]) > 0)), axis=0)
                top.add(ids[start:end], part @ asked)

        last, held_sizes, held = None, None, None  # the rows of the document that may go on
        for batch in batches:
            if not batch.num_rows or not qids:
                continue
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            if known is None:
                known = pa.array(terms, words.type)
            codes = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            if held is not None:
                ids, sizes, codes = [last] * len(held_sizes) + ids, np.append(held_sizes, sizes), np.append(held, codes)
            fresh = np.array([True, *(x != y for x, y in zip(ids[1:], ids[:-1], strict=True))])
            firsts, docs = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            rest = firsts[-1]
            last, held_sizes = ids[-1], sizes[rest:]
            held = codes[len(codes) - held_sizes.sum() :]
            if rest:
                take([ids[i] for i in firsts[:-1].tolist()], docs[:rest], sizes[:rest], codes)
        if held is not None:
            take([last], np.zeros(len(held_sizes), int), held_sizes, held)
        yield from top.rows(qids, types, names)

    bounded_batches(tokens.sparkSession)
    ordered = tokens.select("doc_id", "known").sortWithinPartitions("doc_id", F.size("known"))
    return ordered.mapInArrow(run, f"qid {qid_type.simpleString()}, doc_id {id_type.simpleString()}, score double")


def hashed_best(tokens: DataFrame, weights: list, k: int, dim: int, qid_type) -> DataFrame:
    """qid, doc_id, score: for each query at least its k documents of largest cosine above 0. tokens: doc_id, known,
    dealt by doc_id; rows of one id are one document. weights: rows (id, bucket, w) of the queries, of unit length."""
    qids, buckets, at, of, w = _triples(weights, "bucket")
    of = np.array(buckets, int)[of]
    id_type = tokens.schema["doc_id"].dataType
    types = [to_arrow_type(qid_type), to_arrow_type(id_type), pa.float64()]
    names = ["qid", "doc_id", "score"]

    def run(batches):
        asked = np.zeros((dim, len(qids)))
        asked[of, at] = w
        step = max(1, TOGETHER // max(dim, len(qids)))
        top = Best(len(qids), k)
        last, held = None, None  # the id and buckets of the document that may go on

        def take(ids: list, sizes: np.ndarray, codes: np.ndarray) -> None:
            """Adds whole documents."""
            ends = np.cumsum(sizes)
            for start in range(0, len(ids), step):
                n = min(step, len(ids) - start)
                first = ends[start] - sizes[start]
                row = np.repeat(np.arange(n), sizes[start : start + n])
                counts = np.bincount(row * dim + codes[first : ends[start + n - 1]], minlength=n * dim).reshape(n, dim).astype(np.float64)
                norm = np.sqrt((counts * counts).sum(1))
                counts /= np.where(norm > 0, norm, 1)[:, None]
                top.add(ids[start : start + n], counts @ asked)

        for b in batches:
            if not b.num_rows:
                continue
            ids, lists = b.column(0).to_pylist(), b.column(1)
            words = lists.flatten().cast(pa.binary()).dictionary_encode()
            of_word = np.array([_bucket(x) % dim for x in words.dictionary.to_pylist()], int)
            codes = of_word[words.indices.to_numpy()] if len(words) else np.zeros(0, int)
            sizes = np.diff(lists.offsets.to_numpy())
            if held is not None:
                ids, sizes, codes = [last, *ids], np.append(len(held), sizes), np.append(held, codes)
            starts = np.flatnonzero([True, *(x != y for x, y in zip(ids[1:], ids[:-1], strict=True))])
            sizes = np.add.reduceat(sizes, starts)
            ids = [ids[i] for i in starts.tolist()]
            last, held = ids[-1], codes[len(codes) - sizes[-1] :]
            if len(ids) > 1:
                take(ids[:-1], sizes[:-1], codes)
        if held is not None and qids:
            take([last], np.array([len(held)]), held)
        yield from top.rows(qids, types, names)

    bounded_batches(tokens.sparkSession)
    ordered = tokens.select("doc_id", "known").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, f"qid {qid_type.simpleString()}, doc_id {id_type.simpleString()}, score double")
