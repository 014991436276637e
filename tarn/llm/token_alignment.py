"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the id pairs that overlap.

Ends of tokens are running sums of byte lengths. Ends that both sides share cut the text into groups, and each token
of A is linked to the run of B tokens that its byte range meets. Neither vocabulary merges across a word start, so
this is worked out once for each new word of a batch of texts, all of them in one array, and kept for later ones.

Counts by pair are added up twice: salted by batch, then over the salts. A batch holds each of its pairs once, so
what goes to the counts and comes back is a row for each pair of a batch, not for each document or link; the links
of its documents wait as compressed positions in the batch's list of pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, sliced, working
from .token_count import byte_letters, refuse_other_kinds

BATCH_BYTES = 4 << 20
#: New words that the libraries get at a time.
AT_ONCE = 4_096
#: Words that a worker keeps from earlier batches, about (twice as many at most, and those of one batch).
CACHED = 180_000
SALTS = 16
MARKS = ".,!?;:"
#: Before a single space or line end between other characters both sides start a token.
STARTS = re.compile(r"(?<=\S)(?=[ \n]\S)")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_loaded: dict[tuple[str, str], Aligner] = {}


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group labels of the tokens of A and of B, and the linked positions in A and in B; ends rise strictly and
    both sides end together."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    starts = np.concatenate([[0], ends_a[:-1]]) if len(ends_a) else ends_a
    first, last = np.searchsorted(ends_b, starts, "right"), np.searchsorted(ends_b, ends_a, "left")
    n = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.searchsorted(common, ends_a, "left"), np.searchsorted(common, ends_b, "left"), a, b


class Aligner:
    """A is a byte-level BPE .json file, B a sentencepiece BPE .model that adds a space in front."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            refuse_other_kinds(json.load(f), path_a)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter, names = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.bytes_a[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        self.blank = self.b.piece_to_id("▁")
        self.by_word = not any(re.search("[^▁]▁|\n", p) for p in pieces)
        known, self.old, self.bad = {}, {}, set()
        self.known, self.marks = known, {}
        if self.by_word and not any(x.isalpha() and y in MARKS for p in pieces for x, y in zip(p, p[1:], strict=False)):
            after = [self.b.encode("a" + m)[1:] for m in MARKS]
            self.marks = dict(zip(MARKS, self.aligned(list(MARKS), after), strict=True))

    def words(self, text: str) -> list:
        """Keys of the parts of a space and the text. A part that starts with a space goes by what follows it, one
        that starts with a line end by itself; those with other white space inside are tuples."""
        if not self.by_word:
            return [(" " + text,)]
        if " ".join(text.split()) == text.replace("\n", " "):
            return text.replace("\n", " \n").split(" ")
        parts = STARTS.split(" " + text)
        return [(p,) if len(p.split()) != 1 or len(p) - 1 != len(p.strip()) or p[0] not in " \n" else p[1:] if p[0] == " " else p for p in parts]

    @staticmethod
    def spelled(ids: list[list[int]], spelling: list[bytes], size: np.ndarray, raw: list[bytes]) -> bool:
        """The tokens of every part spell that part."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        ends = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(n)]
        return np.array_equal(ends, np.cumsum([len(r) for r in raw])) and b"".join(map(spelling.__getitem__, flat.tolist())) == b"".join(raw)

    def aligned(self, parts: list[str], ids_b: list[list[int]]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, pairs as bytes, groups as text) of each part, None where the bytes differ."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        raw = [p.encode() for p in parts]
        out: list[tuple | None] = [None] * len(parts)
        at = range(len(parts))
        if not self.spelled(ids_a, self.bytes_a, self.size_a, raw) or not self.spelled(ids_b, self.bytes_b, self.size_b, raw):
            at = [i for i in at if b"".join(map(self.bytes_a.__getitem__, ids_a[i])) == raw[i] == b"".join(map(self.bytes_b.__getitem__, ids_b[i]))]
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids[i] for i in at), np.int64) for ids in (ids_a, ids_b))
        ga, gb, la, lb = links(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        n_a, n_b = (np.array([len(ids[i]) for i in at], np.int64) for ids in (ids_a, ids_b))
        pairs = (flat_a[la] * self.width + flat_b[lb]).tobytes()
        every = np.arange(ga[-1] + 2 if len(ga) else 1)
        from_a, from_b = np.searchsorted(ga, every).tolist(), np.searchsorted(gb, every).tolist()  # where groups begin
        a, b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups = [f"{a[p]}|{b[r]}" if q - p == 1 == t - r else f"{','.join(a[p:q])}|{','.join(b[r:t])}" for p, q, r, t in zip(from_a, from_a[1:], from_b, from_b[1:], strict=False)]
        ends = np.cumsum(n_a)
        stops, lasts = (8 * np.searchsorted(la, ends, "left")).tolist(), (ga[ends - 1] + 1).tolist() if len(at) else []
        before, first = 0, 0
        for i, x, y, stop, last in zip(at, n_a.tolist(), n_b.tolist(), stops, lasts, strict=True):
            out[i] = (x, y, last - first, pairs[before:stop], ";".join(groups[first:last]))
            before, first = stop, last
        return out

    def learn(self, keys: list) -> None:
        for at in range(0, len(keys), AT_ONCE):
            some = keys[at : at + AT_ONCE]
            parts = [k[0] if isinstance(k, tuple) else k if k[0] == "\n" else " " + k for k in some]
            ids = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
            ids = [x if p[0] == " " else x[x[:1] == [self.blank] :] for p, x in zip(parts, ids, strict=True)]
            for k, e in zip(some, self.aligned(parts, ids), strict=True):
                self.known[k] = e
                if e is None:
                    self.bad.add(k)

    def texts(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text the alignments of its parts in order; none if it is null, empty or its bytes differ."""
        keys = [self.words(t) if t else [] for t in texts]
        known, old = self.known, self.old
        fresh, new, marked = set(), {}, []
        for k in keys:
            fresh.update(set(k).difference(known))
        for k in fresh:
            if (e := old.get(k, self)) is not self:
                known[k] = e
            elif k[-1] in self.marks and len(k) > 1 and k[-2].isalpha():
                marked.append(k)
                if (body := k[:-1]) not in known:
                    if (e := old.get(body, self)) is not self:
                        known[body] = e
                    else:
                        new[body] = None
            else:
                new[k] = None
        self.learn(list(new))
        for k in marked:
            x, y = known[k[:-1]], self.marks[k[-1]]
            known[k] = x and (x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], f"{x[4]};{y[4]}")
            if x is None:
                self.bad.add(k)
        found = [[] if self.bad and not self.bad.isdisjoint(k) else list(map(known.__getitem__, k)) for k in keys]
        if len(known) > CACHED:
            self.old, self.known = known, {}
            self.bad.intersection_update(known)
        return found


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes, compressed."""
    data = np.ascontiguousarray(values, "<u4")
    planes = data.view(np.uint8).reshape(-1, 4).T.tobytes()  # like bytes next to each other
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def batch_row(align: Aligner, texts: list[str | None]) -> dict:
    """What a batch sends on: counts and digests by text, its distinct pairs with their numbers of links, and the
    pairs of each text as positions among them."""
    counts, digests, data, n_links = [], [], [], []
    for parts in align.texts(texts):
        n_a, n_b, n_groups, pairs, groups = zip(*parts, strict=True) if parts else ((), (), (), (), ())
        data.append(b"".join(pairs))
        counts.append((sum(n_a), sum(n_b), sum(n_groups), len(data[-1]) // 8))
        n_links.append(len(data[-1]) // 8)
        digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if parts else "")
    distinct, place = np.unique(np.frombuffer(b"".join(data), np.int64), return_inverse=True)
    own, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * max(len(distinct), 1) + place, return_counts=True)
    text, place = np.divmod(own, max(len(distinct), 1))
    step = np.diff(place, prepend=0)
    step[np.flatnonzero(np.diff(text, prepend=-1))] = place[np.flatnonzero(np.diff(text, prepend=-1))]
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, times)
    return {"counts": counts, "sha": digests, "n_pairs": np.bincount(text, minlength=len(texts)).tolist(), "place": packed(step), "times": packed(times), "pair": distinct, "total": total}


def pair_totals(batches: DataFrame) -> DataFrame:
    """(pair, n) corpus-wide from the rows (batch, pair, total): salted sums first, then over the salts."""
    salted = batches.groupBy("pair", (F.col("batch") % SALTS).alias("salt")).agg(F.sum("total").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, or one whose tokens on either side do not spell a space and the text, has zeros and ''.
    n_best counts links whose id pair is linked as often, in the whole corpus, as any of its B id (ties included);
    count_sum adds the corpus-wide counts of the pairs of all links. Repeated rows count and are returned as often
    as they come; a null id stays null. No rows give no rows. Other columns are not read. A very long text is a
    batch of its own.
    """
    bounded_batches(docs.sparkSession)
    width = aligner(path_a, path_b).width
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        with working("token_alignment", _loaded):
            align, part, seq = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
            for b in sliced(batches, max_bytes=BATCH_BYTES, max_rows=1 << 20):
                row = batch_row(align, b.column(1).to_pylist())
                n = np.array(row.pop("counts"), np.int64).reshape(-1, 4)
                cells = {"batch": pa.array([(part << 32) + seq], pa.int64()), "id": pa.ListArray.from_arrays([0, b.num_rows], b.column(0))}
                cells |= {k: pa.array([n[:, i]], pa.list_(pa.int64())) for i, k in enumerate(COUNTS)}
                cells |= {"sha": pa.array([row["sha"]], pa.list_(pa.string())), "n_pairs": pa.array([row["n_pairs"]], pa.list_(pa.int64()))}
                cells |= {k: pa.array([row[k]], pa.binary()) for k in ("place", "times")}
                cells |= {k: pa.array([row[k]], pa.list_(pa.int64())) for k in ("pair", "total")}
                seq += 1
                yield pa.RecordBatch.from_pydict(cells)

    longs = ", ".join(f"{k} array<long>" for k in COUNTS)
    held = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"batch long, id array<{kind}>, {longs}, sha array<string>, n_pairs array<long>, place binary, times binary, pair array<long>, total array<long>")
    held = cut(held)
    asked = held.select("batch", F.posexplode(F.arrays_zip("pair", "total")).alias("at", "x")).select("batch", "at", "x.pair", "x.total")
    totals = cut(pair_totals(asked))
    b_id = (F.col("pair") % width).alias("b")
    best = totals.groupBy(b_id).agg(F.max("n").alias("most"))  # a row for each id of B at most
    scored = totals.withColumn("b", F.col("pair") % width).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    answers = asked.select("batch", "at", "pair").join(scored, "pair").select(F.col("batch").alias("of"), "at", "n", "is_best")

    def totalled(mine: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for row in mine.to_pylist():
            n_pairs = np.array(row["n_pairs"], np.int64)
            ends = np.cumsum(n_pairs)
            step, times = unpacked(row["place"], n_pairs.sum()), unpacked(row["times"], n_pairs.sum())
            run = np.cumsum(step)
            lead = (ends - n_pairs)[n_pairs > 0]  # where a text begins, places start anew
            place = run - np.repeat(run[lead] - step[lead], n_pairs[n_pairs > 0])
            count, best = np.zeros(got.num_rows, np.int64), np.zeros(got.num_rows, np.int64)
            count[got["at"].to_numpy()], best[got["at"].to_numpy()] = got["n"].to_numpy(), got["is_best"].to_numpy().astype(np.int64)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: B023, E731
            cells = {id_col: pa.array(row["id"], mine.schema.field("id").type.value_type)} | {k: pa.array(row[k], pa.int64()) for k in COUNTS}
            cells |= {"n_best": add(times * best[place]), "count_sum": add(times * count[place]), "groups_sha256": pa.array(row["sha"], pa.string())}
            out.append(pa.table(cells))
        return pa.concat_tables(out) if out else pa.table({id_col: pa.array([], mine.schema.field("id").type.value_type)} | {k: pa.array([], pa.int64()) for k in [*COUNTS, "n_best", "count_sum"]} | {"groups_sha256": pa.array([], pa.string())})

    longs = ", ".join(f"{k} long" for k in [*COUNTS, "n_best", "count_sum"])
    return held.drop("pair", "total").groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(totalled, f"`{id_col}` {kind}, {longs}, groups_sha256 string")
