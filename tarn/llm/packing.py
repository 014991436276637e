"""Best-fit packing by the sum-of-squares rule: each document goes where the sum over residual gaps of the
squared number of open bins becomes smallest.

Whole 2048-token pieces are sequences of their own. What is left of each document is dealt to shards of a
fixed number of rows, each packed by one task from its longest to its shortest piece; a shard leaves a few
partly filled bins at most, and no task's work grows with the corpus.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shards, sliced, working

SHARD_ROWS = 32_768
CACHED = 200_000
_loaded: dict[str, IdCache] = {}


@lru_cache(maxsize=4096)
def ends_word(letter: str) -> bool:
    """The vocabulary's own form of the character still ends in a letter (some turn into letter and mark)."""
    return unicodedata.normalize("NFC", letter).lower()[-1:].isalpha()


class IdCache:
    """Ids as little-endian bytes for the part of a text between single spaces, kept for parts seen before.

    The public word vocabulary lower-cases, drops white space and never joins across it, so a text's ids are
    those of its parts, one after the other. A part that ends in one mark after a letter is that of the
    letters and that of the mark, which spares the library most spellings of a word it has seen. New parts go
    to the library many at a time, joined by spaces; the ids that end a word tell where one part ends.
    """

    MARKS = frozenset(".,!?;:")
    TOGETHER = 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(self.model.to_str())
        self.suffix = spec["model"].get("end_of_word_suffix")
        cuts = [c["pattern"]["Regex"] for c in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if c["type"] == "Split" and "Regex" in c["pattern"]]
        self.words = regex.compile(cuts[0]) if self.suffix and len(cuts) == 1 else None
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if self.suffix and t.endswith(self.suffix)]] = True
        self.known, self.old = {}, {}
        self.marks = dict(zip(self.MARKS, self.encoded(list(self.MARKS)), strict=True))

    @staticmethod
    def plain(t: str) -> str:
        """Lower case and spaces for line ends, where that cannot change an id: not near a special string, and
        not where lower-casing depends on the neighbours or on composing characters first."""
        if "<|" in t:
            return t
        if t.isascii() or ("\u03a3" not in t and "\u0130" not in t and unicodedata.is_normalized("NFC", t)):
            t = t.lower()
        return t.replace("\n", " ")

    def n_words(self, part: str) -> int:
        """How many words the library makes of a part; 0 where only the library itself can tell."""
        if self.words is None or "<|" in part:
            return 0
        if part.isascii():
            return 1 if part.isalpha() else len(self.words.findall(part))
        return int(part.isalpha() and part == part.lower() and unicodedata.is_normalized("NFC", part))

    def encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of each part as bytes."""
        out: list[bytes | None] = [None] * len(parts)
        sizes = list(map(self.n_words, parts))
        sure = [i for i, n in enumerate(sizes) if n]
        groups = [sure[i : i + self.TOGETHER] for i in range(0, len(sure), self.TOGETHER)]
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join(parts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            last, upto = np.flatnonzero(self.ends[ids]), np.cumsum([sizes[i] for i in group])
            if len(last) == upto[-1]:
                data, stops = ids.tobytes(), (4 * (last[upto - 1] + 1)).tolist()
                for i, a, z in zip(group, [0, *stops], stops, strict=False):
                    out[i] = data[a:z]
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(left, self.model.encode_batch_fast([parts[i] for i in left], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def texts(self, texts: list[str | None]) -> list[bytes]:
        parts = [self.plain(t).split(" ") if t else [] for t in texts]
        known, old = self.known, self.old
        known.update(self.marks)
        known[""] = b""
        fresh, marked = {}, []

        def find(p: str) -> None:
            if (got := old.get(p)) is not None:
                known[p] = got
            else:
                fresh[p] = None

        for p in set().union(*parts):
            if p in known:  # a set difference would walk through the whole cache
                continue
            if len(p) > 1 and p[-1] in self.MARKS and ends_word(p[-2]):
                marked.append(p)
                if p[:-1] not in known:
                    find(p[:-1])
            else:
                find(p)
        new = list(fresh)
        for i in range(0, len(new), 8192):
            known.update(zip(new[i : i + 8192], self.encoded(new[i : i + 8192]), strict=True))
        for p in marked:
            known[p] = known[p[:-1]] + known[p[-1]]
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        if len(known) > CACHED:
            self.old, self.known = known, {}
        return out


def id_cache(path: str) -> IdCache:
    if path not in _loaded:
        _loaded[path] = IdCache(path)
    return _loaded[path]


def sum_of_squares(sizes, capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) for each size, in the order given; every size must lie in 1..capacity.

    open_[g] is the number of open bins with gap g. Filling gap g with size s turns the sum of squares by
    1 - 2 open_[g], and by 2 open_[g - s] + 1 more unless the bin is then full. A bin is opened only when
    no open one has room (the published rule weighs that as well; with falling sizes this keeps the number of
    bins at the best-fit mark). Ties go to the tightest gap.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = [], [], 0
    far = np.iinfo(np.int64).max
    for s in sizes:
        s = int(s)
        here = open_[s:capacity]
        change = 1 - 2 * here
        if s < capacity:
            change[1:] += 2 * open_[1 : capacity - s] + 1
        change[here == 0] = far
        at = int(change.argmin()) if len(change) else -1
        if at >= 0 and change[at] != far:
            gap = s + at
            b = held[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = capacity, n
            n += 1
        bins.append(b)
        offsets.append(capacity - gap)
        if gap > s:
            held[gap - s].append(b)
            open_[gap - s] += 1
    return bins, offsets


def tokenized(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity ids: id, piece, start, length, ids_crc32. A null or empty text is one end id."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        with working("packing", _loaded):
            ids = id_cache(path)
            for b in sliced(batches, 8 << 20):
                rows, out = [], [[], [], [], []]
                for i, data in enumerate(ids.texts(b.column(1).to_pylist())):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append(i)
                        for to, x in zip(out, (piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            to.append(x)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, out, kinds)], names)

    picked = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return picked.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, *, capacity: int = 2048, shard_rows: int = SHARD_ROWS, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows whose length lies in 1..capacity.

    An empty table gives an empty result; repeated rows are packed as often as they occur; other columns
    pass through (sequence_id and offset of the input, if any, are replaced).
    """
    pieces = cut(pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()))
    plain = [c for c in pieces.columns if c != "_row"]
    full = F.col(length_col) >= capacity
    rest = pieces.where(~full)
    n = shards(rest.count(), shard_rows)
    alone = pieces.where(full).select(*plain, F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row") + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        sizes = table[length_col].to_numpy()
        shard = table["_shard"][0].as_py()
        order = np.lexsort((table["_row"].to_numpy(), -sizes))
        bins, offsets = sum_of_squares(sizes[order], capacity)
        table = table.select(plain).take(pa.array(order))
        ids = -1 - (np.array(bins, np.int64) + (np.int64(shard) << 32))  # negative: apart from the sequences above
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    packed = rest.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(n))).groupBy("_shard").applyInArrow(run, schema)
    return alone.unionByName(packed)


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence and place."""
    return pack(tokenized(docs, path, capacity=capacity, id_col=id_col, text_col=text_col), capacity=capacity)
