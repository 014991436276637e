"""Documents in compressed batches, and counts of hashed keys that are routed back to them.

A batch is one row of some megabytes of text. Each operator on top of it turns batches into 64-bit keys,
asks how many batches and rows share each key, and gets the answers back in the order of its own keys. So
keys travel as short fingerprints in a few large rows instead of one row per key, each batch sends a key
once however often it holds it, and nothing is gathered anywhere but the keys of one bucket.

A batch deals its keys to 2**FAN_BITS buckets at most. Where a corpus needs more, the keys of CRATE_BATCHES
batches meet first, each key once, and are dealt on to the finer buckets; so rows stay large and a key that
every batch has is added up on the way. The answers come back by the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shards, working

BATCH_BYTES = 2 << 20
BATCH_ROWS = 8_000
#: Keys to a bucket at which one task counts them.
BUCKET_KEYS = 1_000_000
#: log2 of the most buckets that one batch sends rows to.
FAN_BITS = 10
#: Batches whose keys meet before they are dealt to finer buckets.
CRATE_BATCHES = 1_024
#: Bytes of a key that travel, beside the bits that its bucket stands for.
FINGERPRINT, FINE_FINGERPRINT = 5, 7


def batched(docs: DataFrame, id_col: str, text_col: str, note=None, note_type: str = "") -> DataFrame:
    """Rows (batch, ids, lens, blob[, notes]): UTF-8 texts end to end; a null text counts as empty.

    note(bytes, starts) -> a value for each document, kept in notes. The table is written to the shared folder at
    once, so a batch and its order stay as they are whatever is recomputed later.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"batch long, ids array<{id_type}>, lens array<int>, blob binary" + (f", notes array<{note_type}>" if note else "")

    most_bytes, most_rows = BATCH_BYTES, BATCH_ROWS

    def run(batches):
        ids, texts, size, kind = [], [], 0, None
        number = TaskContext.get().partitionId() << 32

        def row():
            data, lens = b"".join(texts), [len(t) for t in texts]
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([lens], pa.list_(pa.int32())), pa.array([zstandard.compress(data, 3)])]
            names = ["batch", "ids", "lens", "blob"]
            if note:
                columns.append(pa.array([note(data, starts_of(lens))]))
                names.append("notes")
            return pa.RecordBatch.from_arrays(columns, names)

        with working("batches"):
            for b in batches:
                kind = b.column(0).type
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    t = t.encode() if t else b""
                    if texts and (size + len(t) > most_bytes or len(texts) >= most_rows):
                        yield row()
                        number += 1
                        ids, texts, size = [], [], 0
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
            if texts:
                yield row()

    return cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema))


def starts_of(lens) -> np.ndarray:
    """Where each document starts in its batch, and the end."""
    starts = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.asarray(lens, np.int64), out=starts[1:])
    return starts


def unpacked(lens, blob: bytes) -> tuple[bytes, np.ndarray]:
    """All bytes of a batch, and where each document starts (and the end)."""
    starts = starts_of(lens)
    return zstandard.decompress(blob, max_output_size=max(1, int(starts[-1]))), starts


def bucket_bits(keys: int) -> int:
    """log2 of the number of buckets for so many keys."""
    return max(0, (-(-int(keys) // BUCKET_KEYS) - 1).bit_length())


#: The least count that each byte stands for: exact up to 32, then in steps of a tenth at most, to 2 ** 32 and more.
_LEAST = np.array([*range(33), *(int(np.ceil(32 * 2.0 ** (k / 8) - 1e-6)) for k in range(1, 224))], np.int64)


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in a byte each, rounded down."""
    n = np.asarray(n, np.int64)
    out = np.minimum(n, 32).astype(np.uint8)
    many = np.flatnonzero(n > 32)
    if len(many):
        out[many] = np.searchsorted(_LEAST, n[many], "right") - 1
    return out


def counted(code: np.ndarray) -> np.ndarray:
    """The least counts that bytes stand for."""
    return _LEAST[code]


def sent(batch: int, keys: np.ndarray, counts: np.ndarray, bits: int, fan: int):
    """Arrow rows (bucket, batch, prints, counts) of sorted distinct 64-bit keys with their counts in the batch."""
    width = FINGERPRINT if bits <= fan else FINE_FINGERPRINT
    bits = min(bits, fan)
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    prints = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    ends = [0, *edges.tolist(), len(keys)]
    return _rows(((k, batch, prints[a:z], counts[a:z]) for k, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a), width)


def _rows(parts, width: int) -> pa.RecordBatch:
    out = [[], [], [], []]
    for bucket, batch, prints, counts in parts:
        for to, x in zip(out, (bucket, batch, np.ascontiguousarray(prints.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(), coded(counts).tobytes()), strict=True):
            to.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "batch", "prints", "counts"])


SENT = "bucket long, batch long, prints binary, counts binary"
TOTALS = "batch long, bucket long, totals binary"


def _merged(table: pa.Table, width: int):
    """Sorted distinct prints of the rows, their summed counts, where each row's prints are among them, and where
    each row starts."""
    parts = table["prints"].to_pylist()
    ends = np.cumsum([0, *(len(p) // width for p in parts)])
    wide = np.zeros((int(ends[-1]), 8), np.uint8)
    wide[:, :width] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    prints, which = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    del parts, wide
    counts = counted(np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8))
    return prints, np.bincount(which.ravel(), counts, len(prints)).astype(np.int64), which.ravel(), ends


def _answers(table: pa.Table, totals: np.ndarray, which: np.ndarray, ends: np.ndarray) -> pa.Table:
    out = coded(totals)[which]
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "totals": pa.array([out[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], pa.binary())})


def crates(batch, n: int):
    """The crate, of so many, that a batch's rows go to."""
    return F.pmod(F.xxhash64(batch), F.lit(n)).cast("long")


def answered(rows: DataFrame, bits: int, fan: int, batches: int) -> DataFrame:
    """(batch, bucket, totals): the summed count of each key sent, coded in one byte each. fan is FAN_BITS, as sent() had it.

    A key's answer depends on its fingerprint alone. Two keys that share one (about 1 in 2^40 for each pair
    in a bucket) both get their sum, which may let a key pass as common but never hides one.
    """

    def count(width: int):
        def run(table: pa.Table) -> pa.Table:
            with working("batches"):
                _, totals, which, ends = _merged(table, width)
                return _answers(table, totals, which, ends)

        return run

    fine = bits - fan
    if fine <= 0:
        return cut(rows.groupBy("bucket").applyInArrow(count(FINGERPRINT), TOTALS))

    def merge(table: pa.Table) -> pa.Table:
        with working("batches"):
            prints, totals, _, _ = _merged(table, FINE_FINGERPRINT)
            bucket, crate = table["bucket"][0].as_py() << fine, table["crate"][0].as_py()
            at = np.searchsorted(prints, np.arange(1 << fine, dtype=np.uint64) << np.uint64(8 * FINE_FINGERPRINT - fine))
            ends = [*at.tolist(), len(prints)]
            return pa.Table.from_batches([_rows(((bucket + k, crate, prints[a:z], totals[a:z]) for k, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a), FINE_FINGERPRINT)])

    def back(_, left: pa.Table, right: pa.Table) -> pa.Table:
        with working("batches"):
            _, _, which, ends = _merged(left, FINE_FINGERPRINT)
            return _answers(left, counted(totals_of(right)), which, ends)

    rows = cut(rows.withColumn("crate", crates("batch", shards(batches, CRATE_BATCHES))))
    found = rows.groupBy("bucket", "crate").applyInArrow(merge, SENT).groupBy("bucket").applyInArrow(count(FINE_FINGERPRINT), TOTALS)
    found = cut(found).withColumnRenamed("batch", "crate").withColumn("coarse", F.shiftright("bucket", fine))
    return cut(rows.groupBy("bucket", "crate").cogroup(found.groupBy("coarse", "crate")).applyInArrow(back, TOTALS))


def totals_of(table: pa.Table) -> np.ndarray:
    """The answers of one batch in the order of its sorted keys, as coded."""
    order = np.argsort(table["bucket"].to_numpy())
    parts = table["totals"].to_pylist()
    return np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
