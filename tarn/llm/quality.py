"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words give four families of n-grams: words and word pairs (lower case), and shapes and shape pairs, where a
word's shape is its pattern of capitals, digits and marks and whether it repeats the word before it. Shapes
let the model judge texts whose words it has never seen. Each family is a frequency vector; a score is the
sparse dot product with one weight per hash bucket. Training takes one pass of per-coordinate FTRL-proximal
updates over a sample of at most SAMPLE labelled rows, in hash order, in one task; the model has 2**BITS
weights whatever the input.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, sliced, words, working

BITS = 18
#: Documented bound: at most so many labelled rows are used for training (all, if there are fewer).
SAMPLE = 10_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 0.1, 1e-4, 1e-3
SCALE = 8.0
FAMILIES = 4
CACHED = 100_000
_MARKS = re.compile(r"[^\w]+")


def shape(word: str) -> str:
    """Capitals, then letters or digits, then the marks at the end, as they are up to three."""
    body = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    marks = word[len(body) :][:3]
    if not body:
        return "_" + marks
    kind = "U" if len(body) > 1 and body.isupper() else "T" if body[:1].isupper() else "l"
    kind += "d" if any(map(str.isdigit, body)) else ""
    kind += "m" if _MARKS.search(body) else ""
    return f"{kind}{min(len(body) // 6, 3)}{marks}"


class WordTable(dict):
    """word -> hash of the word << 32 | hash of its shape; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = xxhash.xxh32_intdigest(ascii_lower(word)) << 32 | xxhash.xxh32_intdigest(shape(word))
        self[word] = found
        return found


_table = WordTable()


def features(text: str | None) -> list[np.ndarray]:
    """Buckets of each family, one for each n-gram of the text, repeats included."""
    found = words(text) if text else []
    if not found:
        return []
    both = np.fromiter(map(_table.__getitem__, found), np.uint64, len(found))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    form[1:] += (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(32)

    def bucket(x, salt):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)

    pair = lambda x: x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[1:]
    return [bucket(word, 1), bucket(pair(word), 2), bucket(form, 3), bucket(pair(form), 4)]


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values."""
    families = [f for f in features(text) if len(f)]
    if not families:
        return np.zeros(0, np.int64), np.zeros(0)
    places = np.concatenate(families)
    values = np.concatenate([np.full(len(f), SCALE / len(f)) for f in families])
    at, which = np.unique(places, return_inverse=True)
    return at, np.bincount(which, values, len(at))


class Ftrl:
    """FTRL-proximal: z and n per coordinate, weights made on demand; the last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> np.ndarray:
    """2**BITS weights and the bias. Rows without id or label teach nothing; of several labels the least counts, and of
    several texts of one id a single one."""
    bounded_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
    chosen = chosen.withColumn("turn", F.xxhash64(F.col("_id").cast("string"))).orderBy("turn", "_id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    # One text to an id, so that repeated ids cannot pass the bound.
    rows = rows.groupBy("_id", "turn", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("turn", "label", "text")

    def encode(batches):
        with working("quality", _table):
            for b in sliced(batches):
                found = [sparse(t) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array([f[0].astype("<u4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f2").tobytes() for f in found], pa.binary())], ["turn", "label", "at", "x"])

    def learn(table: pa.Table) -> pa.Table:
        with working("quality", _table):
            turns, labels, places, values = (table[c] for c in ("turn", "label", "at", "x"))
            order = np.argsort(turns.to_numpy(), kind="stable").tolist()
            model = Ftrl(1 << BITS)
            for _ in range(EPOCHS):
                for i in order:
                    at = np.append(np.frombuffer(places[i].as_py(), "<u4").astype(np.int64), 1 << BITS)
                    model.update(at, np.append(np.frombuffer(values[i].as_py(), "<f2").astype(float), 1.0), int(labels[i].as_py() > 0))
            return pa.table({"weights": pa.array([model.weights(np.arange((1 << BITS) + 1)).astype("<f4").tobytes()], pa.binary())})

    encoded = rows.mapInArrow(encode, "turn long, label int, at binary, x binary")
    got = encoded.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "weights binary").first()  # at most sample rows; the model has a fixed size
    return np.frombuffer(got[0], "<f4") if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score. A null or empty text has the bias alone for its score."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        with working("quality", _table):
            w, bias = model.value[:-1], float(model.value[-1])
            for b in sliced(batches):
                logits = np.array([bias + SCALE * sum(float(w[f].mean()) for f in features(t) if len(f)) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))), pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, score double")


def held_out(doc_id):
    """The fold never learnt from: crc32 of the id as text leaves 0 by 5. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Labels are learnt only outside the held-out fold. Rows repeat if the input's do; without any label the
    score is 0.5 throughout. An empty table gives an empty result; other columns are not read.
    """
    weights = train(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    out = score(docs, weights, id_col=id_col, text_col=text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the classifier does not reject, with all of their columns, in one pass over docs."""
    weights = train(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col)
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def run(batches):
        with working("quality", _table):
            w, bias = model.value[:-1], float(model.value[-1])
            for b in sliced(batches):
                logits = np.array([bias + SCALE * sum(float(w[f].mean()) for f in features(t) if len(f)) for t in b.column(place).to_pylist()])
                yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
