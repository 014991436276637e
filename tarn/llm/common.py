"""Shared helpers: worker memory, bounded caches and word rules; checkpoints are those of the library."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..functions.lineage import cut, shared_dir

__all__ = ["WORD", "TwoGenerations", "ascii_lower", "bounded_batches", "cut", "shards", "shared_dir", "sliced", "words", "working"]

#: A word is a run of bytes other than ASCII white space; the same rule for SQL (Java regex) and Python.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r"
_TO_SPACE = str.maketrans({c: " " for c in SPACES})


def words(text: str) -> list[str]:
    """Runs of anything but ASCII white space (str.split() alone would also split at Unicode spaces)."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w] if text else []


_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ascii_lower(text: str) -> str:
    return text.translate(_UPPER) if not text.isascii() else text.lower()


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Holds what Spark hands to Python at a time to some megabytes (one longer row stands alone). A smaller
    bound that the session has set stays. The setting outlives the call, as Spark reads it when the rows of a
    lazy result are asked for."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


#: Arrays of so many bytes are mapped by themselves, so they go back to the system when they are freed.
MAPPED_BYTES = 1 << 20


class _Worker:
    """What a Python worker holds between the tasks it is used for."""

    owner: str = ""
    caches: tuple = ()
    tuned: bool = False


def _tune() -> None:
    """Large arrays are mapped and small ones taken from one heap whose free end is given back, so that a worker
    that is kept for later tasks holds no more than its caches."""
    with contextlib.suppress(OSError, AttributeError):
        lib = ctypes.CDLL(None)
        for option, value in ((-3, MAPPED_BYTES), (-1, 4 * MAPPED_BYTES), (-8, 1)):  # mmap threshold, trim threshold, arenas
            lib.mallopt(option, value)
    pa.set_memory_pool(pa.system_memory_pool())
    _Worker.tuned = True


@contextlib.contextmanager
def working(name: str, *caches):
    """Around what an operator does in a Python worker. Spark keeps workers for later tasks; the caches of one
    operator are emptied when another one starts in the worker."""
    if not _Worker.tuned:
        _tune()
    if _Worker.owner != name:
        for c in _Worker.caches:
            c.clear()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)
    _Worker.owner, _Worker.caches = name, caches
    yield


class TwoGenerations:
    """A cache of at most about 2 * size entries: when the young half is full, the old half is let go."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def sliced(batches, max_bytes: int = 4 << 20, max_rows: int = 2000):
    """Re-cut Arrow batches so that each holds about max_bytes at most (one longer row stands alone)."""
    for batch in batches:
        start, n = 0, batch.num_rows
        if n == 0:
            continue
        if batch.nbytes <= max_bytes and n <= max_rows:
            yield batch
            continue
        sizes = [0] * n
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                for i, k in enumerate(pc.binary_length(column).to_pylist()):
                    sizes[i] += k or 0
        held = 0
        for i, k in enumerate(sizes):
            if i > start and (held + k > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += k
        yield batch.slice(start)


def shards(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))
