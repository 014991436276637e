"""Approximate nearest neighbours by learned partitions.

Rows are first brought together by vector: of equal vectors the k + 1 smallest ids can be among the k nearest of
anything, so one entry with these ids stands for all of them. Entries are then parted by a tree of routers. To
split a partition of more than LEAF entries, a sample of at most SAMPLE of them goes to one task: an exact
neighbour graph of the sample; a balanced partition of the graph that cuts few of its edges; and a small
classifier (one hidden layer) that learns from a vector which parts its neighbours are in. The number of parts
to look into is the least that reaches the recall asked for on sample rows kept out of training, measured
against brute force, with a margin. Every entry goes down to its most probable part, and so on until partitions
are small; the work at each level is shared out by blocks, whatever a partition holds.

A query goes down to its most probable parts, and to more of them while these hold too few entries, and is held
against every entry of the leaves it reaches, in double precision. Leaves are cut into blocks as well, of entries
and of queries, so a leaf that holds a third of all entries is shared out like the rest.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Documented bound of the sample that each router is fitted on.
SAMPLE = 10_000
#: Entries beyond which a partition is split, most parts of a split, and most levels of splits.
LEAF, FAN, LEVELS = 2_048, 32, 12
#: A part with more than this share of what was split is not split again: the router cannot tell its entries apart.
STUCK = 0.9
GRAPH, HIDDEN, EPOCHS, BATCH = 10, 64, 10, 256
HELD_OUT = 0.1
SLACK = 0.1
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 4_096
#: Entries that one task sends down a level at a time.
BLOCK_MOVED = 1_024
RECALL, MARGIN = 0.93, 0.02


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbours(base: np.ndarray, of: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places in base of the k largest inner products of each row; own: places that do not count."""
    out = np.empty((len(of), k), np.int64)
    for i in range(0, len(of), 512):
        s = of[i : i + 512] @ base.T
        if own is not None:
            s[np.arange(len(s)), own[i : i + 512]] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, m: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Parts of at most (1 + SLACK) n / m nodes. Starts from nearest centres with room, then nodes move to the
    part that most of their neighbours are in, largest gain first, as long as there is room."""
    n = len(x)
    room = int(np.ceil(n / m * (1 + SLACK)))
    centres = x[rng.permutation(n)[:m]].copy()
    part = np.zeros(n, np.int64)
    for _ in range(6):
        s = x @ centres.T
        held = np.zeros(m, np.int64)
        wish = np.argsort(-s, axis=1)
        for i in np.argsort(-s.max(1)).tolist():
            for p in wish[i].tolist():
                if held[p] < room:
                    part[i] = p
                    held[p] += 1
                    break
        for p in range(m):
            if held[p]:
                centres[p] = x[part == p].mean(0)
        centres = unit(centres)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    held = np.bincount(part, minlength=m)
    for _ in range(rounds):
        votes = np.zeros((n, m))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        gain, best = votes.max(1) - votes[np.arange(n), part], votes.argmax(1)
        moved = 0
        keen = np.flatnonzero((gain > 0) & (rng.random(n) < 0.5))  # not all at once, so that neighbours do not swap places
        for i in keen[np.argsort(-gain[keen], kind="stable")].tolist():
            if held[best[i]] < room:
                held[part[i]] -= 1
                held[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """The classifier: unit vector -> log-odds of each partition."""

    def __init__(self, width: int, m: int, rng: np.random.Generator):
        self.m, self.probes = m, m
        self.weights = [rng.normal(0, 4 * np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, m)), np.zeros(m)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(unit(x) @ a + b, 0) @ c + d

    def fit(self, x: np.ndarray, wanted: np.ndarray, rng: np.random.Generator, rate: float = 0.003) -> None:
        """Cross-entropy against the shares of wanted, by Adam."""
        x = unit(x)
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                a, b, c, d = self.weights
                hidden = np.maximum(x[some] @ a + b, 0)
                z = hidden @ c + d
                p = np.exp(z - z.max(1, keepdims=True))
                error = (p / p.sum(1, keepdims=True) - wanted[some]) / len(some)
                back = error @ c.T * (hidden > 0)
                step += 1
                for i, g in enumerate((x[some].T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.weights[i] -= rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)


def fit(x: np.ndarray, m: int, k: int, recall: float = RECALL + MARGIN, seed: int = 5) -> Router:
    """A router for entries like x; probes is set by brute force on the entries held out."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    held = max(1, int(len(x) * HELD_OUT))
    queries, base = x[:held], x[held:]
    router = Router(x.shape[1], m, rng)
    if m < 2 or len(base) <= max(GRAPH, k):
        router.m = router.probes = 1
        router.weights[2], router.weights[3] = router.weights[2][:, :1], router.weights[3][:1]
        return router
    graph = neighbours(base, base, GRAPH, np.arange(len(base)))
    part = balanced_partition(unit(base), graph, m, rng)
    wanted = 0.1 * np.eye(m)[part]
    np.add.at(wanted, (np.repeat(np.arange(len(base)), GRAPH), part[graph].ravel()), 0.9 / GRAPH)
    router.fit(base, wanted, rng)
    near = neighbours(base, queries, k)
    where = router.odds(base).argmax(1)[near]
    place = np.argsort(np.argsort(-router.odds(queries), axis=1), axis=1)
    found = np.sort(np.take_along_axis(place, where, 1).ravel())
    router.probes = int(min(m, found[min(len(found) - 1, int(np.ceil(recall * len(found))))] + 1))
    return router


def _matrix(column) -> np.ndarray:
    """Rows of the binary column as doubles."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<f8").reshape(len(parts), -1)


def _nearest(table: pa.Table, k: int) -> pa.Table:
    """For each query of a block one row with the best k + 1 rows of the block, ties to the smaller id; own tells
    whether a row has the query's own vector."""
    query = np.asarray(table["query"].to_numpy())
    vectors, keys, ids = _matrix(table["vector"]), table["key"].to_pylist(), table["ids"].to_pylist()
    rows = np.flatnonzero(~query)
    rows = rows[np.argsort([ids[i][0] for i in rows], kind="stable")]
    out: list[list] = [[], [], [], []]
    asked = np.flatnonzero(query)
    if len(rows):
        base = vectors[rows]
        largest = np.abs(base).sum(1).max()
        for i in range(0, len(asked), 256):
            some = asked[i : i + 256]
            s = vectors[some] @ base.T
            bound = np.partition(s, -k - 1, axis=1)[:, -k - 1] if s.shape[1] > k + 1 else np.full(len(some), -np.inf)
            # Matrix products round equal rows apart; what is near the bound is added up again in one order.
            slack = 1e-12 * (1 + np.abs(vectors[some]).max(1) * largest)
            for j, q in enumerate(some.tolist()):
                maybe = np.flatnonzero(s[j] >= bound[j] - slack[j])
                exact = np.cumsum(base[maybe] * vectors[q], axis=1)[:, -1]
                best = np.argsort(-exact, kind="stable")[: k + 1]  # equal ones by smallest id
                found = sorted((-x, v, keys[r] == keys[q]) for x, r in zip(exact[best].tolist(), rows[maybe[best]].tolist(), strict=True) for v in ids[r])[: k + 1]
                for to, y in zip(out, (keys[q], [v for _, v, _ in found], [o for *_, o in found], [-x for x, *_ in found]), strict=True):
                    to.append(y)
    kinds = pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.float64())
    return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["key", "vec_id", "own", "score"])


def _best(table: pa.Table, k: int) -> pa.Table:
    """The best k + 1 rows of all blocks that a query was held against."""
    vec_id, own, score = (np.asarray(pa.chunked_array(table[c].chunks).combine_chunks().flatten().to_numpy(zero_copy_only=False)) for c in ("vec_id", "own", "score"))
    best = np.lexsort((vec_id, -score))[: k + 1]
    return pa.table({"key": pa.array(table["key"].to_pylist()[:1] * len(best), pa.string()), "vec_id": pa.array(vec_id[best], pa.int64()), "own": pa.array(own[best], pa.bool_()), "score": pa.array(score[best], pa.float64())})


def _entries(vectors: DataFrame, k: int, queries, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Entries (key, vector, ids, query) and the rows that ask (row, query_id, key)."""
    value = F.col(vector_col)
    good = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(value, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & value.isNotNull()).where(good).select(F.col(id_col).cast("long").alias("id"), value.cast("array<double>").alias("v"))

    def encode(batches):
        for b in batches:
            v = b.column(1)
            flat, ends = np.asarray(v.flatten(), float) + 0.0, np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())]).astype(int)  # + 0.0: no negative zeros
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], pa.binary())], ["id", "vector"])

    rows = cut(rows.mapInArrow(encode, "id long, vector binary").withColumn("key", F.md5("vector")).withColumn("row", F.monotonically_increasing_id()))
    least = rows.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("id", "row"))).where(F.col("place") <= k + 1)
    asking = F.lit(True) if queries is None else queries(F.col("id"))
    asked = rows.where(asking).select("row", F.col("id").alias("query_id"), "key")
    entries = least.groupBy("key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1
    marked = asked.select(F.col("key").alias("asked")).distinct()
    return cut(entries.join(marked, F.col("key") == F.col("asked"), "left").select("key", "vector", "ids", F.col("asked").isNotNull().alias("query"))), asked


def _blocks(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the given parts (part, blocks), each with its block."""
    return rows.join(parts.select("part", "blocks"), F.col("path") == F.col("part")).drop("part").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("blocks")).cast("int")).drop("blocks")


def _tree(entries: DataFrame, k: int, sample: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Entries (key, vector, ids, path) with the leaf that each is in, and (key, vector, path) with the leaves that
    each query looks into."""
    width = (F.length("vector") / 8).cast("long").cast("string")
    index = entries.select("key", "vector", "ids", width.alias("path"))
    walk = entries.where("query").select("key", "vector", width.alias("path"))
    sizes = cut(index.groupBy("path").agg(F.count("*").alias("n")).withColumn("stuck", F.lit(False)))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(2, largest / LEAF)) / math.log(FAN)))
    goal = recall ** (1 / levels) + MARGIN / levels

    def learn(table: pa.Table) -> pa.Table:
        path, m = table["path"][0].as_py(), table["m"][0].as_py()
        order = np.argsort(table["turn"].to_numpy(), kind="stable")[:sample]
        router = fit(_matrix(table["vector"].take(pa.array(order))), m, k, goal)
        return pa.table({"of": [path], "model": pa.array([pickle.dumps(router)], pa.binary())})

    def assign(_, left: pa.Table, right: pa.Table) -> pa.Table:
        child = pickle.loads(right["model"][0].as_py()).odds(_matrix(left["vector"])).argmax(1).tolist() if left.num_rows else []
        path = [f"{p}/{c}" for p, c in zip(left["path"].to_pylist(), child, strict=True)]
        return pa.table({"key": left["key"], "vector": left["vector"], "ids": left["ids"].cast(pa.list_(pa.int64())), "path": pa.array(path, pa.string())})

    def route(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["key", "vector", "path"])
        router = pickle.loads(right["model"][0].as_py())
        held = np.zeros(router.m, np.int64)
        for x in right["held"][0].as_py():
            held[x["child"]] = x["n"]
        best = np.argsort(-router.odds(_matrix(left["vector"])), axis=1, kind="stable")
        enough = np.maximum(router.probes, (np.cumsum(held[best], axis=1) < k + 1).sum(1) + 1)
        row, child = [], []
        for i, (parts, e) in enumerate(zip(best.tolist(), enough.tolist(), strict=True)):
            some = [c for c in parts[:e] if held[c]]
            row += [i] * len(some)
            child += some
        taken = left.take(pa.array(row, pa.int64()))
        path = [f"{p}/{c}" for p, c in zip(taken["path"].to_pylist(), child, strict=True)]
        return pa.table({"key": taken["key"], "vector": taken["vector"], "path": pa.array(path, pa.string())})

    for level in range(LEVELS):
        split = sizes.where((F.col("n") > LEAF) & ~F.col("stuck"))
        split = cut(split.select(F.col("path").alias("part"), "n", F.least(F.lit(FAN), F.ceil(2 * F.col("n") / LEAF)).cast("int").alias("m"), F.ceil(F.col("n") / BLOCK_MOVED).cast("int").alias("blocks")))
        if split.isEmpty():
            break
        turn = F.xxhash64(F.lit(level), "key")
        chosen = index.join(split.select("part", "n", "m"), F.col("path") == F.col("part")).withColumn("turn", turn)
        chosen = chosen.where(F.shiftrightunsigned("turn", 33) < F.lit(2.0**31) * (1.1 * sample) / F.col("n")).select("path", "m", "turn", "vector")
        models = cut(chosen.groupBy("path").applyInArrow(learn, "of string, model binary"))
        dealt = split.join(models, F.col("part") == F.col("of")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        moved = _blocks(index, split).groupBy("path", "block").cogroup(dealt.select("part", "block", "model").groupBy("part", "block")).applyInArrow(assign, "key string, vector binary, ids array<long>, path string")
        moved = cut(moved)
        parts = cut(moved.groupBy("path").agg(F.count("*").alias("n")).withColumn("parent", F.regexp_extract("path", "^(.*)/", 1)))
        held = parts.groupBy("parent").agg(F.collect_list(F.struct(F.regexp_extract("path", "([0-9]+)$", 1).cast("int").alias("child"), "n")).alias("held"))  # at most FAN
        known = dealt.join(held, F.col("part") == F.col("parent")).select("part", "block", "model", "held")
        gone = _blocks(walk, split).groupBy("path", "block").cogroup(known.groupBy("part", "block")).applyInArrow(route, "key string, vector binary, path string")
        others = lambda df: df.join(split.select("part"), F.col("path") == F.col("part"), "left_anti")
        index = cut(others(index).select("key", "vector", "ids", "path").unionByName(moved))
        walk = cut(others(walk).select("key", "vector", "path").unionByName(gone))
        stuck = F.col("n") > STUCK * F.col("whole")
        sizes = cut(others(sizes).unionByName(parts.join(split.select("part", F.col("n").alias("whole")), F.col("parent") == F.col("part")).select("path", "n", stuck.alias("stuck"))))
    return index, walk


def nearest(vectors: DataFrame, k: int = 20, *, queries=None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, probed, leaves: for each query row the k nearest rows found, by inner
    product; probed is the number of leaves it looked into, of so many.

    queries is a condition on the id that makes a row a query (by default all rows). Rows without an id, and
    vectors that are null, empty, zero, or hold null or non-finite components, take no part. Vectors of different
    lengths have no inner product and are never neighbours. Every row counts, also those that share an id or a
    vector; only the query's own row is never its neighbour, and a query row that is there twice is answered
    twice. Ties go to the smaller id. Fewer than k rows come only if there are fewer others. An empty table gives
    an empty result; other columns are not read.
    """
    entries, asked = _entries(vectors, k, queries, id_col, vector_col)
    index, walk = _tree(entries, k, sample, recall)
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    leaves = cut(count(index, "n").join(count(walk, "q"), "path", "left").select("path", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("bn"), F.ceil(F.coalesce("q", F.lit(0)) / BLOCK_QUERIES).cast("int").alias("bq")))
    spread = lambda n: F.pmod(F.xxhash64(F.lit(5), "key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = index.join(leaves.where("bq > 0"), "path").withColumn("block", spread(F.col("bn"))).withColumn("turn", every(F.col("bq")))
    ask = walk.join(leaves, "path").withColumn("turn", spread(F.col("bq"))).withColumn("block", every(F.col("bn")))
    columns = ["path", "block", "turn", "key", "vector"]
    both = base.select(*columns, "ids", F.lit(False).alias("query")).unionByName(ask.select(*columns, F.lit(None).cast("array<long>").alias("ids"), F.lit(True).alias("query")))
    met = both.groupBy("path", "block", "turn").applyInArrow(lambda t: _nearest(t, k), "key string, vec_id array<long>, own array<boolean>, score array<double>")
    met = met.groupBy("key").applyInArrow(lambda t: _best(t, k), "key string, vec_id long, own boolean, score double")
    order = (F.col("score").desc(), F.col("vec_id"))
    probed = walk.groupBy("key").agg(F.count("*").cast("int").alias("probed")).crossJoin(F.broadcast(leaves.agg(F.count("*").cast("int").alias("leaves"))))  # one row
    out = asked.join(met.join(probed, "key"), "key")
    # Of the rows with the query's own id and vector, one is the query's own.
    mine = F.col("own") & (F.col("vec_id") == F.col("query_id"))
    turn = F.row_number().over(W.partitionBy("row", mine).orderBy(*order))
    out = out.withColumn("mine", mine).withColumn("turn", turn).where(~(F.col("mine") & (F.col("turn") == 1)))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score", "probed", "leaves")
