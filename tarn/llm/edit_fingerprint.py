"""Document fingerprints by randomised edit embedding.

A walk reads a text character by character; after each step it moves on or stays, by a coin that all texts
share for that step and character. Two texts that differ by an edit walk apart and soon fall into step
again, so their edit distance shows as the number of steps at which they read different things (Hamming
distance). The fingerprint samples SLOTS steps the same way for every text (in each slot, the step of least
shared priority that the walk reaches) and keeps a byte of what is read there, the next GRAM characters.
Likeness is the share of slots that agree. Near copies are found by bands of sampled slots, then verified.

The coins of a character for STRIDE steps are the bits of one 64-bit hash of the character and the number of
the stride, so they never repeat. Many texts walk side by side, one step of all of them at a time; the few
longest finish one by one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, sliced, working
from .jaccard_join import components

SLOTS, GRAM, STRIDE = 128, 4, 64
#: So many texts or fewer finish their walks one by one.
FEW = 12
#: Bytes of text that walk side by side.
TOGETHER_BYTES = 2 << 20
#: Partitions whose order is worked out in one task.
BLOCK_PARTS = 1_024
#: Enough bands, and few enough slots in each, for nineteen in twenty texts with up to 1 % of their characters edited.
BANDS, BAND_SLOTS = 42, 3
LEAST_SIMILARITY = 0.99
#: Members of a band that one task holds against as many others.
BLOCK_MEMBERS = 2_048
#: Classes of characters whose counts tell that two texts are too far apart.
LETTERS = 31
_SHIFTS = np.arange(STRIDE, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x


def coins(letters: np.ndarray, stride: int, n: int = 1) -> np.ndarray:
    """For each of n strides a word of STRIDE coins per letter (code points); a last letter, which ends a text,
    has none."""
    words = np.zeros((n, len(letters) + 1), np.uint64)
    which = _mix(np.arange(stride, stride + n, dtype=np.uint64) + np.uint64(1 << 50))
    words[:, :-1] = _mix(which[:, None] + (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return words


def priorities(start: int, n: int) -> np.ndarray:
    """The shared priorities of n steps."""
    return _mix(np.arange(start, start + n, dtype=np.uint64) + np.uint64(1 << 40))


class _Records:
    """Steps that have the least priority in their slot so far (slots take turns). A walk that reaches such a
    step samples it, in place of the slot's earlier one."""

    CHUNK = 512 * SLOTS

    def __init__(self):
        self.steps: list[int] = []
        self.upto, self.least = 0, np.full(SLOTS, np.iinfo(np.uint64).max)

    def __getitem__(self, k: int) -> int:
        while k >= len(self.steps):
            u = priorities(self.upto, self.CHUNK).reshape(-1, SLOTS)
            best = np.minimum.accumulate(np.vstack([self.least, u]), axis=0)
            self.steps += (np.flatnonzero((u < best[:-1]).ravel()) + self.upto).tolist()
            self.least, self.upto = best[-1], self.upto + self.CHUNK
        return self.steps[k]


_records = _Records()


def _alone(letter: np.ndarray, letters: np.ndarray, at: int, end: int, j: int, k: int, place: np.ndarray, step: np.ndarray) -> None:
    """The rest of one walk, from step j, whose next record is the k-th."""
    record, shifts = _records[k], range(STRIDE)
    while at < end:
        words = coins(letters, j // STRIDE, 64)
        for own in words:
            if at >= end:
                return
            ahead, p = own.take(letter[at : at + STRIDE + 1]).tolist(), 0
            if record < j + STRIDE:
                for s in shifts:
                    if j + s == record:
                        if at + p < end:
                            place[record % SLOTS], step[record % SLOTS] = at + p, record
                        k += 1
                        record = _records[k]
                    p += ahead[p] >> s & 1
            else:
                for s in shifts:
                    p += ahead[p] >> s & 1
            at += p
            j += STRIDE


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text; 0 stands for a slot without a step. The empty text has none at all."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    if not order:
        return out
    points = np.frombuffer("\0".join([*(texts[i] for i in order), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(texts[i]) + 1 for i in order]) - 1
    starts = np.append(0, ends[:-1] + 1)
    number = np.zeros(int(points.max()) + 1, np.int32)
    number[points] = 1
    letters = np.flatnonzero(number)
    number[letters] = np.arange(len(letters))
    letter = number[points]
    letter[ends] = len(letters)
    place, step = np.full((len(order), SLOTS), -1), np.full((len(order), SLOTS), -1)
    rows, at, end, j, k = np.arange(len(order)), starts.copy(), ends, 0, 0
    record = _records[0]
    while len(rows) > FEW:
        bits = ((coins(letters, j // STRIDE) >> _SHIFTS[:, None]) & np.uint64(1)).astype(np.intp)
        read, moves = np.empty(len(rows), np.int32), np.empty(len(rows), np.intp)
        for s in range(STRIDE):
            if j + s == record:
                live = at < end
                place[rows[live], record % SLOTS], step[rows[live], record % SLOTS] = at[live], record
                k += 1
                record = _records[k]
            letter.take(at, out=read, mode="clip")
            bits[s].take(read, out=moves, mode="clip")
            at += moves
        j += STRIDE
        live = at < end
        if not live.all():
            rows, at, end = rows[live], at[live], end[live]
    for r, a, e in zip(rows.tolist(), at.tolist(), end.tolist(), strict=True):
        _alone(letter, letters, a, e, j, k, place[r], step[r])
    read = np.zeros(place.shape, np.uint64)
    for g in range(GRAM):
        here = place + g
        inside = here < ends[:, None]
        read = _mix(read + np.where(inside, points[np.minimum(here, ends[:, None])].astype(np.uint64) + np.uint64(1), np.uint64(0)) + np.uint64(g << 32))
    found = (_mix(read + step.astype(np.uint64)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    found[step < 0] = 0
    out[order] = found
    return out


def fingerprint(text: str | None) -> bytes:
    """SLOTS bytes; null is an empty text."""
    return fingerprints_of([text or ""])[0].tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of the slots that either text has in which both agree; 1 for two empty texts."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    either = int(((x | y) > 0).sum())
    return float(((x == y) & (x > 0)).sum() / either) if either else 1.0


def likenesses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """likeness() of each row of x to that of y."""
    either = ((x | y) > 0).sum(1)
    return np.where(either > 0, ((x == y) & (x > 0)).sum(1) / np.maximum(either, 1), 1.0)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, fingerprint (hex). A null or empty text has 0 characters and a fingerprint of
    zeros. Rows repeat if the input's do; other columns are not read. One pass, no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        with working("edit_fingerprint"):
            for b in sliced(batches, TOGETHER_BYTES):
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([f.tobytes().hex() for f in fingerprints_of(texts)], pa.string())], [id_col, "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, n_chars long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FOUND = (("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()))
_FOUND_SQL = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str], own: np.ndarray, theirs: np.ndarray, edited: np.ndarray) -> list[pa.Array]:
    digests = [hashlib.sha256(edited_text(t, f).encode()).digest() for t, f in zip(texts, following, strict=True)]
    columns = ids, list(map(len, texts)), digests, [x.tobytes() for x in own], [x.tobytes() for x in edited], likenesses(own, edited), likenesses(own, theirs)
    return [pa.array(c, t) for c, (_, t) in zip(columns, _FOUND, strict=True)]


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many (or all) of the
    next document by ascending id; after the last comes the first. Ids are integers; a null id comes first,
    rows of one id are ordered by the first characters of their texts and a digest, and a single row is its own
    next. A null text is empty. An empty table gives an empty result; other columns are not read.

    Rows are dealt by ranges of that order (equal rows too), and each task reads its sorted rows as a stream,
    holding one row back. The last row of a partition meets the first of the next one that has rows.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(text_col, F.lit(""))
    order = [F.col(id_col).cast("long").alias("key"), F.substring(text, 1, 32).alias("head"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row")]
    places = ["key", "head", "digest", "row"]
    rows = docs.select(*order, text.alias("text")).repartitionByRange(*places).sortWithinPartitions(*places).select("key", "text")

    def run(batches):
        names = [*(n for n, _ in _FOUND), "part", "first", "last"]
        none = lambda n: [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
        first = held = None  # the first text; the id, text and fingerprint of the row held back
        with working("edit_fingerprint"):
            for b in sliced(batches, TOGETHER_BYTES):
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                first = texts[0] if first is None else first
                before = [held] if held else []
                mine, names_of = [*(h[1] for h in before), *texts], [*(h[0] for h in before), *ids]
                edited = list(map(edited_text, mine[:-1], mine[1:]))
                new = fingerprints_of([*texts, *edited])
                own = np.concatenate([*(h[2] for h in before), new[: len(texts)]])
                held = (names_of[-1], mine[-1], own[-1:])
                if len(mine) > 1:
                    yield pa.RecordBatch.from_arrays([*_compared(names_of[:-1], mine[:-1], mine[1:], own[:-1], own[1:], new[len(texts) :]), *none(len(mine) - 1)], names)
            if held:
                edge = [pa.array([held[0]], pa.int64()), *(pa.nulls(1, t) for _, t in _FOUND[1:])]
                yield pa.RecordBatch.from_arrays([*edge, pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([first], pa.string()), pa.array([held[1]], pa.string())], names)

    def meet(batches):
        with working("edit_fingerprint"):
            for b in sliced(batches, TOGETHER_BYTES):
                ids, last, following = (c.to_pylist() for c in b.columns)
                n = len(ids)
                if n:
                    f = fingerprints_of([*last, *following, *map(edited_text, last, following)])
                    yield pa.RecordBatch.from_arrays(_compared(ids, last, following, f[:n], f[n : 2 * n], f[2 * n :]), [x for x, _ in _FOUND])

    found = cut(rows.mapInArrow(run, f"{_FOUND_SQL}, part long, first string, last string"))
    edges = found.where("part is not null").select("id", "part", "first", "last")
    # The next part with rows: within a block of parts, else the first of the next block, else the first of all.
    block = F.floor(F.col("part") / BLOCK_PARTS)
    blocks = edges.groupBy(block.alias("block")).agg(F.min("part").alias("begin"))
    every = W.partitionBy(F.lit(0))  # one row for each BLOCK_PARTS partitions
    blocks = blocks.select("block", F.coalesce(F.lead("begin").over(every.orderBy("block")), F.min("begin").over(every)).alias("other"))
    inside = F.lead("part").over(W.partitionBy("block").orderBy("part"))
    pairs = edges.withColumn("block", block).select("id", "last", "block", inside.alias("inside")).join(blocks, "block")
    pairs = pairs.select("id", "last", F.coalesce("inside", "other").alias("part")).join(edges.select("part", "first"), "part").select("id", "last", "first")
    out = found.where("part is null").select(*(n for n, _ in _FOUND)).unionByName(pairs.mapInArrow(meet, _FOUND_SQL))
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(F.col("id").alias(id_col), "n_chars", text_of("edited_sha256"), text_of("fingerprint"), text_of("edited_fingerprint"), "near_edited", "near_next")


def _band_members(entries: DataFrame, least: float) -> DataFrame:
    """(key, band, part, size) for entries (key, fingerprint[, size]); a band without any step (very short texts) is
    left out. Texts that can be similar are of the same part or of neighbouring ones."""
    slots = np.random.default_rng(11).permuted(np.tile(np.arange(SLOTS), (BANDS, 1)), axis=1)[:, :BAND_SLOTS]
    bands = F.array(*(F.concat(F.lit(f"{b}:"), *(F.substring("fingerprint", 2 * int(s) + 1, 2) for s in row)) for b, row in enumerate(slots)))
    empty = "00" * BAND_SLOTS
    size = F.col("size") if "size" in entries.columns else F.lit(1)
    width = 1.0001 * max(-math.log(least), 1e-9) if least > 0 else math.inf
    rows = entries.select("key", F.floor(F.ln(size) / F.lit(width)).alias("part"), size.cast("long").alias("size"), F.explode(bands).alias("band"))
    return cut(rows.where(~F.col("band").endswith(empty)))


def _pairs(members: DataFrame, across: bool, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of keys that share a band and whose sizes let them be similar; across: of two labels
    only. Bands of many members are cut into parts by size, and those into blocks, each of which meets each."""
    met = members.withColumn("at", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    blocks = met.groupBy("band", "at").agg(F.count("*").alias("members"), F.count_if(F.col("at") == F.col("part")).alias("own")).where("members > 1 and own > 0")
    blocks = blocks.select("band", "at", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    dealt = met.join(blocks, ["band", "at"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda rows, own, other, x: rows.select("band", "at", F.col("own").alias(own), F.col("met").alias(other), *(F.col(c).alias(f"{x}_{c}") for c in ("key", "part", "size", *(["label"] if across else []))))
    found = side(dealt, "x", "y", "a").join(side(dealt.where("at = part"), "y", "x", "b"), ["band", "at", "x", "y"])
    found = found.where("a_part < b_part or a_key < b_key").where(F.abs(F.col("a_size") - F.col("b_size")) <= (1 - least) * F.greatest("a_size", "b_size") + 1e-9)
    found = found.where("a_label <> b_label") if across else found
    return found.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()


def _near(entries: DataFrame, every: bool, verified, least: float = LEAST_SIMILARITY) -> DataFrame:
    """verified(pairs) of pairs (a, b) of entries (key, fingerprint[, size]) that share a band: of all of them, or of as
    many as connect exactly the keys that all connect."""
    members = _band_members(entries, least)
    if every:
        return verified(_pairs(members, False, least))
    hubs = members.groupBy("band").agg(F.min("key").alias("a"))
    tried = cut(members.join(hubs, "band").where("a <> key").select("a", F.col("key").alias("b")).distinct())
    links = cut(verified(tried))
    labels = components(links)
    labelled = members.join(labels, members.key == labels.node, "left").select("key", "band", "part", "size", F.coalesce("label", "key").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("band")
    more = verified(_pairs(cut(labelled.join(mixed, "band")), True, least).join(tried, ["a", "b"], "left_anti"))
    return links.unionByName(more)


def _alike(a: str, b: str, i: int, j: int) -> int:
    """How many characters from a[i] and b[j] on are equal."""
    at, step, size, growing = 0, 8, min(len(a) - i, len(b) - j), True
    while at < size:
        w = min(step, size - at)
        if a[i + at : i + at + w] == b[j + at : j + at + w]:
            at += w
            step = 2 * step if growing else max(1, step // 2)
        elif w == 1:
            break
        else:
            step, growing = w // 2, False
    return at


def edits_within(a: str, b: str, most: int) -> int | None:
    """Edit distance (insert, delete, replace) if it is at most most, else None.

    Per number of edits, the furthest place that each diagonal of the band reaches; equal stretches are
    skipped whole, so the work grows with the square of the edits and hardly with the length."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return None
    far: dict[int, int] = {}
    for e in range(most + 1):
        now = {}
        for d in range(max(-e, (goal - most) // 2), min(e, (goal + most + 1) // 2) + 1):
            i = 0 if e == 0 else max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            if i < n and i + d < m and a[i] == b[i + d]:
                i += _alike(a, b, i, i + d)
            if d == goal and i >= n:
                return e
            now[d] = i
        far = now
    return None


def near_texts(docs: DataFrame, least: float = LEAST_SIMILARITY, *, every: bool = True, text_col: str = "text") -> DataFrame:
    """(sha256, other, edits, similarity): pairs of distinct texts whose edit distance is at most 1 - least of the
    longer one's characters; similarity is 1 - edits / characters of the longer.

    Candidates share a band of their fingerprints, or the fingerprint; each is verified on the texts. Equal
    texts are one entry; null and empty texts have no pair. With every=False, pairs within one group are left out
    once the group is joined: each member is held against the smallest of its bands, then all pairs left between
    two groups against each other, so the links given join exactly the texts that all links join, and a large
    group is not expanded into all of its pairs.
    """
    texts = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("text")).withColumn("sha", F.sha2("text", 256)).dropDuplicates(["sha"])
    texts = cut(texts.withColumn("key", F.monotonically_increasing_id()))
    entries = cut(fingerprints(texts, id_col="key").select("key", F.col("n_chars").alias("size"), "fingerprint"))

    def count(batches):
        with working("edit_fingerprint"):
            for b in sliced(batches, TOGETHER_BYTES):
                counts = [np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, minlength=LETTERS).astype(np.uint32).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.binary())], ["key", "size", "counts"])

    counted = texts.select("key", "text", F.length("text").cast("long").alias("size")).mapInArrow(count, "key long, size long, counts binary")

    def possible(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, LETTERS).astype(np.int64) for i in (3, 5))
                size = np.maximum(b.column(2).to_numpy(), b.column(4).to_numpy())
                fits = np.abs(x - y).sum(1) <= 2 * np.floor((1 - least) * size + 1e-9)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(fits))

    def verify(batches):
        for b in batches:
            edits, similar = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                size = max(len(x), len(y))
                found = edits_within(x, y, int((1 - least) * size + 1e-9))
                edits.append(found)
                similar.append(None if found is None else 1 - found / size)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(edits, pa.int64()), pa.array(similar, pa.float64())], ["a", "b", "edits", "similarity"])
            yield out.filter(pa.array([e is not None for e in edits], pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        # An edit changes the count of two letters by one at most, so most pairs are ruled out without their texts.
        of = lambda x: counted.withColumnsRenamed({"key": x, "size": f"{x}_size", "counts": f"{x}_counts"})
        sized = pairs.join(of("a"), "a").join(of("b"), "b").where(F.abs(F.col("a_size") - F.col("b_size")) <= (1 - least) * F.greatest("a_size", "b_size") + 1e-9)
        sized = cut(sized.select("a", "b", "a_size", "a_counts", "b_size", "b_counts").mapInArrow(possible, "a long, b long"))
        side = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"{x}_text"))
        held = sized.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
        return held.mapInArrow(verify, "a long, b long, edits long, similarity double")

    bounded_batches(docs.sparkSession)
    name = lambda x: texts.select(F.col("key").alias(x), F.col("sha").alias(f"{x}_sha"))
    found = cut(_near(entries, every, verified, least)).join(name("a"), "a").join(name("b"), "b")
    return found.select(F.greatest("a_sha", "b_sha").alias("sha256"), F.least("a_sha", "b_sha").alias("other"), "edits", "similarity")
