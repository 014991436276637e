"""Token counts: byte-pair merging with a heap over a linked list; only the number of tokens is kept.

A piece starts as one symbol per byte. The adjacent pair of lowest rank is popped again and again and
merged; each merge takes one symbol away, so a piece has (bytes - merges) tokens and no identifiers are
ever made. Pieces repeat, so counts are cached per worker in a cache of fixed size.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, bounded_batches, sliced, working

#: Fixed value: the public byte-level pre-tokenisation rule.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Runs of white space that may not be cut at a single space.
RUNS = regex.compile(r"\s{3,}|\s{2,}\Z")
CACHED = 300_000
_loaded: dict[str, BytePairCounter] = {}


def byte_letters() -> dict[str, int]:
    """The public byte alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_other_kinds(spec: dict, path: str) -> None:
    """ValueError for a file whose counts would not be those of plain byte-level merging by the rule above."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if model.get("type") != "BPE" or odd or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary {odd}")


class BytePairCounter:
    """Counts for the vocabulary of a tokenizers .json file (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_other_kinds(spec, path)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.heads = {s[0] for s in special}
        self.cache = TwoGenerations(CACHED)
        self.chunks = TwoGenerations(CACHED)

    def merged(self, piece: bytes) -> int:
        """Initial symbols minus merges."""
        n = len(piece)
        symbol = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.ranks.get, []
        for i in range(n - 1):
            if (r := rank((symbol[i], symbol[i + 1]))) is not None:
                heap.append((r, i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = a + b, None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (k := before[i]) >= 0 and (r := rank((symbol[k], symbol[i]))) is not None:
                heapq.heappush(heap, (r, k, symbol[k], symbol[i]))
        return left

    def pieces(self, text: str) -> int:
        total = 0
        for piece in PIECES.findall(text):
            if (n := self.cache.get(piece)) is None:
                n = self.merged(piece.encode())
                if len(piece) <= 64:
                    self.cache.put(piece, n)
            total += n
        return total

    def plain(self, text: str) -> int:
        """Cuts at single spaces, which always start the next piece; other runs of white space stay whole."""
        if not text:
            return 0
        if RUNS.search(text):
            return self.pieces(text)
        get, put, total = self.chunks.young.get, self.chunks.put, 0
        first, *rest = text.split(" ")
        for chunk in rest:
            n = get(chunk)
            if n is None:
                n = self.chunks.old.get(chunk)
                if n is None:
                    n = self.pieces(" " + chunk)
                if len(chunk) <= 64:
                    put(chunk, n)
                    get = self.chunks.young.get
            total += n
        return total + self.pieces(first)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(h in text for h in self.heads):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def counter(path: str) -> BytePairCounter:
    if path not in _loaded:
        _loaded[path] = BytePairCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens. Rows repeat if the input's do; a null id stays null.
    Special strings inside a text count as one token each, as the library's default has it. Other columns
    are not read. One pass, no shuffle; a very long text is worked on alone.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        with working("token_count", _loaded):
            c = counter(path)
            for b in sliced(batches):
                n = pa.array([c.count(t) for t in b.column(1).to_pylist()], pa.int64())
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return picked.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
