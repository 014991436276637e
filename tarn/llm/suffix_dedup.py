"""Suffix-array dedup: repeats of at least LENGTH bytes, from the common-prefix interval tree of an enhanced
suffix array.

An array over a whole corpus can be neither built nor sorted in one place, so the corpus is first cut by
content. Every window of LENGTH bytes is dealt to its anchor: the K-byte string in it of least hash (the
leftmost of equals). Windows that are equal have equal anchors at equal places, wherever they occur; so the
windows around an anchor, with their bytes, form a segment, and all segments with one anchor string meet in
one bucket. Anchor strings found in a single document are dropped first, by counts over the whole corpus. An
anchor that more than HOT rows have would fill a bucket by itself: its segments are parted by where the anchor
stands in the window, which makes the string that all windows of a part share longer; these strings are
counted and dropped or parted anew in the same way, down to single windows, whose string is the window.

In a bucket, the suffixes of all distinct segments are sorted into a suffix array with their common-prefix
lengths. A stack scan over those lengths yields the intervals of the tree; an interval whose suffixes are
preceded by different bytes (or by none) cannot be extended to the left, so it is a maximal repeat, and it
is put out with all of its occurrences. A repeat longer than a segment comes out as a chain of overlapping
ones. A byte goes if such a repeat covers it and also occurs in a document of smaller id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .batches import SENT, answered, batched, bucket_bits, counted, crates, sent, totals_of, unpacked
from .common import cut, shards, working

LENGTH, K = 50, 24
SPREAD = LENGTH - K + 1  # anchors to choose from in a window, and windows to a segment at most
WIDTH = 80  # bytes of a segment (LENGTH - 1 + SPREAD at most), its number of windows, its anchor's place
WINDOWS_AT, ANCHOR_AT = 78, 79
NO_ID = np.iinfo(np.int64).max
#: Rows of an anchor string beyond which its segments are parted.
HOT = 100_000
#: Suffixes that are sorted at a time.
SUFFIXES = 400_000
#: Per level, where the parts begin and end, in bytes before the anchor; each part lies within one of the level above.
PARTS = ((0, SPREAD), (0, 13, SPREAD), (0, 7, 13, 20, SPREAD), tuple(range(SPREAD + 1)))
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _C[3]
    h ^= h >> np.uint64(29)
    return h


def _raw(words: list[np.ndarray]) -> np.ndarray:
    """Hash of K bytes given as words of 8; its leading half gives the order that anchors are chosen by."""
    h = words[0] * _C[0]
    for w, c in zip(words[1:], _C[1:], strict=False):
        h += (w ^ (w >> np.uint64(23))) * c
    return h


def _key(raw: np.ndarray) -> np.ndarray:
    """What buckets go by: mixed anew, as the raw hashes of anchors are small ones."""
    return _mixed(_mixed(raw) * _C[1])


class Anchors:
    """The segments of a batch: where each starts (first), its windows, its anchor, its document and key."""

    BLOCK = 1 << 15  # windows worked on at a time, so that they stay in the processor's cache

    def __init__(self, data: bytes, starts: np.ndarray):
        self.data = np.frombuffer(data + bytes(WIDTH), np.uint8)
        n = len(data)
        chosen = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
        loads = np.ndarray((n,), "<u8", self.data, 0, (1,)) if n else np.zeros(0, np.uint64)
        half, low = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
        places = np.arange(self.BLOCK + SPREAD, dtype=np.uint64)
        for a in range(0, n - LENGTH + 1, self.BLOCK):
            m = min(self.BLOCK, n - LENGTH + 1 - a) + SPREAD - 1
            raw = _raw([loads[a + 8 * i : a + 8 * i + m] for i in range(K // 8)])
            key = (raw & half) | places[:m]
            reach = 1
            while 2 * reach <= SPREAD:
                key = np.minimum(key[:-reach], key[reach:])
                reach *= 2
            if SPREAD > reach:
                key = np.minimum(key[: reach - SPREAD], key[SPREAD - reach :])
            chosen[a : a + len(key)] = (key & low).astype(chosen.dtype) + a
        sizes = np.diff(starts)
        long_ = np.flatnonzero(sizes >= LENGTH)
        valid = np.zeros(n + 1, np.int8)
        np.add.at(valid, starts[long_], 1)
        np.add.at(valid, starts[long_ + 1] - LENGTH + 1, -1)
        valid = np.cumsum(valid, dtype=np.int8).view(bool)
        new = np.ones(n + 1, bool)
        new[1:] = chosen[1:] != chosen[:-1]
        new[starts[long_]] = True
        self.first = np.flatnonzero(new & valid)
        self.doc = np.searchsorted(starts, self.first, "right") - 1
        last = starts[self.doc + 1] - LENGTH + 1
        self.windows = np.minimum(np.append(self.first[1:], n), last) - self.first
        self.anchor = chosen[self.first].astype(np.int64)
        self.key = _key(_raw([loads[self.anchor + 8 * i] for i in range(K // 8)])) if len(self.first) else np.zeros(0, np.uint64)
        self._sort()

    def _sort(self) -> None:
        """Occurrences by key, for counts and answers by sorted distinct key."""
        self.order = np.argsort(self.key, kind="stable")
        key = self.key[self.order]
        self.heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)

    def rows_per_key(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and of each the number of distinct segments: 1 for a key of one document, 2 at least
        for one of several."""
        doc = self.doc[self.order]
        pair = np.ones(len(doc), np.int64)
        pair[1:] = doc[1:] != doc[:-1]
        pair[self.heads] = 1
        keys = self.key[self.order][self.heads]
        n = np.minimum(np.add.reduceat(pair, self.heads), 2) if len(doc) else pair
        mine = self.order[np.repeat((n > 1) & (np.diff(np.append(self.heads, len(doc))) > 2), np.diff(np.append(self.heads, len(doc))))]
        if len(mine):
            name = np.unique((self.key[mine] & np.uint64(0xFFFFFFFF00000000)) | (_digest(self.rows(mine)) >> np.uint64(32)))
            half, first = np.unique(name >> np.uint64(32), return_index=True)
            of = np.searchsorted(half, keys >> np.uint64(32))
            found = half[np.minimum(of, len(half) - 1)] == keys >> np.uint64(32)
            n[found & (n > 1)] = np.maximum(2, np.diff(np.append(first, len(name)))[of[found & (n > 1)]])
        return keys, n

    def by_occurrence(self, of_key: np.ndarray) -> np.ndarray:
        """A value of each sorted distinct key, for each occurrence."""
        out = np.empty(len(self.order), of_key.dtype)
        out[self.order] = np.repeat(of_key, np.diff(np.append(self.heads, len(self.order))))
        return out

    def rows(self, mine: np.ndarray) -> np.ndarray:
        """The segments of the given occurrences, WIDTH bytes each."""
        first, windows = self.first[mine], self.windows[mine]
        rows = np.zeros((len(mine), WIDTH), np.uint8)
        span = LENGTH - 1 + SPREAD
        rows[:, :span] = np.lib.stride_tricks.sliding_window_view(self.data, span)[first]
        rows[:, :span] *= np.arange(span) < (windows + LENGTH - 1)[:, None]
        rows[:, WINDOWS_AT], rows[:, ANCHOR_AT] = windows, self.anchor[mine] - first
        return rows

    def parted(self, hot: np.ndarray, level: int) -> Anchors:
        """The segments of the given occurrences by the parts of this level: windows whose anchor has so many bytes
        before it. The key of a part is that of the string that all of its windows share."""
        out = object.__new__(Anchors)
        out.data = self.data
        of = np.repeat(hot, len(PARTS[level]) - 1)
        least, most = (np.tile(np.array(x, np.int64), len(hot)) for x in (PARTS[level][:-1], PARTS[level][1:]))
        first = np.maximum(self.first[of], self.anchor[of] - most + 1)
        windows = np.minimum(self.first[of] + self.windows[of], self.anchor[of] - least + 1) - first
        some = windows > 0
        out.first, out.windows, out.anchor, out.doc = first[some], windows[some], self.anchor[of][some], self.doc[of][some]
        least, most = least[some], most[some]
        shared = LENGTH - (most - 1 - least)
        text = np.zeros((len(least), 56), np.uint8)
        if len(least):
            text[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[out.anchor - least]
        text *= np.arange(56) < shared[:, None]
        text[:, 55] = least
        out.key = _key(_digest(text))
        out._sort()
        return out

    def segments(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct segments of the given occurrences by key: rows of WIDTH bytes, keys; and for each occurrence
        its place in here and its distinct segment."""
        mine = np.flatnonzero(shared)
        rows = self.rows(mine)
        name = row_names(rows, self.key[mine])
        _, at, which = np.unique(name, return_index=True, return_inverse=True)
        return rows[at], self.key[mine][at], mine, which.ravel()


def final(data: bytes, starts: np.ndarray, totals: list[np.ndarray], most: int) -> tuple[Anchors, np.ndarray]:
    """The segments of a batch and which of them are to be held against others, from the answers of each level:
    of a hot key the parts take the place of the whole."""
    anchors = Anchors(data, starts)
    whole, kept = [], []
    for level, found in enumerate(totals, 1):
        n = anchors.by_occurrence(counted(found))
        hot = n > most if level < len(totals) else np.zeros(len(n), bool)
        whole.append(anchors)
        kept.append(~hot & (n >= 2))
        if level < len(totals):
            anchors = anchors.parted(np.flatnonzero(hot), level)
    if len(whole) == 1:
        return whole[0], kept[0]
    out = object.__new__(Anchors)
    out.data = whole[0].data
    for name in ("first", "windows", "anchor", "doc", "key"):
        setattr(out, name, np.concatenate([getattr(a, name) for a in whole]))
    return out, np.concatenate(kept)


def asked(data: bytes, starts: np.ndarray, totals: list[np.ndarray], most: int) -> Anchors:
    """The segments whose keys are to be counted next, from the answers so far."""
    anchors = Anchors(data, starts)
    for level, found in enumerate(totals, 1):
        anchors = anchors.parted(np.flatnonzero(anchors.by_occurrence(counted(found)) > most), level)
    return anchors


def _digest(rows: np.ndarray) -> np.ndarray:
    """A hash of each row, whose length is a multiple of 8."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * _C[i % 4] + words[:, i]
    return _mixed(h)


def row_names(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers that order rows by key (its leading half) and tell different rows apart."""
    words = np.ascontiguousarray(rows).view("<u8")
    name = (key & np.uint64(0xFFFFFFFF00000000)) | (_digest(rows) >> np.uint64(32))
    _, at, which = np.unique(name, return_index=True, return_inverse=True)
    if np.array_equal(words[at][which.ravel()], words):
        return name
    # Two rows of one name: number all rows by their bytes instead.
    keyed = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), rows], 1)
    return np.unique(np.ascontiguousarray(keyed).view(f"V{rows.shape[1] + 8}").ravel(), return_inverse=True)[1].ravel().astype(np.uint64)


def keys_of_segments(rows: np.ndarray) -> np.ndarray:
    at = rows[:, ANCHOR_AT].astype(np.int64)[:, None] + np.arange(K)
    words = np.take_along_axis(rows, at, 1).view("<u8")
    return _key(_raw([words[:, i] for i in range(K // 8)]))


def lcp_intervals(lcp, least: int, floor):
    """(length, from, to, smallest) of each interval of the common-prefix tree of at least that length.

    lcp[i] is the common prefix of suffixes i - 1 and i (lcp[0] is 0); floor[i] is a value of suffix i, of
    which an interval gives the smallest. One pass with a stack.
    """
    out, stack = [], []  # of [length, from, smallest]
    for i, x in enumerate([*lcp[1:], 0]):
        low = floor[i]
        left = i
        while stack and stack[-1][0] > x:
            length, left, smallest = stack.pop()
            low = min(low, smallest)
            out.append((length, left, i, low))
        if stack and stack[-1][0] == x:
            stack[-1][2] = min(stack[-1][2], low)
        elif x >= least:
            stack.append([x, left, low])
    return out


def suffix_array(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes text[start:end] (up to width bytes), and common-prefix lengths in that order."""
    span = np.arange(width)
    rows = np.zeros((len(starts), width + 1), np.uint8)
    padded = np.append(text, np.zeros(width, np.uint8))
    rows[:, :width] = padded[starts[:, None] + span]
    size = np.minimum(ends - starts, width)
    rows[:, :width][span >= size[:, None]] = 0
    rows[:, width] = size
    order = np.argsort(rows.view(f"V{width + 1}").ravel(), kind="stable")
    rows, size = rows[order, :width], size[order]
    lcp = np.zeros(len(order), np.int64)
    differ = rows[1:] != rows[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
    return order, lcp


def maximal_repeats(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray, owner: np.ndarray, least: int, width: int):
    """Maximal repeats among the suffixes text[start:end]: arrays (length, from, to, smallest owner) over the
    sorted suffixes, and the order itself. opens marks suffixes with nothing before them; an interval is
    left-diverse if it holds one of those or two different preceding bytes."""
    order, lcp = suffix_array(text, starts, ends, width)
    before = np.where(opens, -1, text[np.maximum(starts - 1, 0)].astype(np.int64))[order]
    # A suffix that differs on the left from the one above it, in sorted order; nothing before it always does.
    change = np.ones(len(order), np.int64)
    change[1:] = (before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0)
    changes = np.cumsum(change)
    # Runs of suffixes with a common prefix of at least `least`; those with no change cannot hold a maximal one.
    heads = np.flatnonzero(lcp < least)
    tails = np.append(heads[1:], len(order)) - 1
    useful = (tails > heads) & (changes[tails] > changes[heads])
    owner = owner[order]
    out = []
    for a, z in zip(heads[useful].tolist(), tails[useful].tolist(), strict=True):
        for length, left, right, low in lcp_intervals([0, *lcp[a + 1 : z + 1].tolist()], least, owner[a : z + 1].tolist()):
            if changes[a + right] > changes[a + left]:
                out.append((length, a + left, a + right, low))
    return order, np.array(out, np.int64).reshape(-1, 4)


def _portions(met: np.ndarray, which: np.ndarray, windows: np.ndarray):
    """The segments, sorted by key, in portions of whole keys with SUFFIXES windows or so; a key with more of them
    comes several times, with the windows whose anchor has from least to most bytes before it."""
    if not len(met):
        return
    heads = np.flatnonzero(np.append(True, which[met][1:] != which[met][:-1]))
    sizes = np.add.reduceat(windows[met], heads)
    start, held = 0, 0
    for a, z, n in zip(heads.tolist(), [*heads[1:].tolist(), len(met)], sizes.tolist(), strict=True):
        if held and held + n > SUFFIXES:
            yield met[start:a], 0, SPREAD
            start, held = a, 0
        held += n
        if n > SUFFIXES:
            step = max(1, SUFFIXES // (z - a))
            for least in range(0, SPREAD, step):
                yield met[a:z], least, min(SPREAD, least + step)
            start, held = z, 0
    if start < len(met):
        yield met[start:], 0, SPREAD


def smallest_per_window(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments with the smallest id that has each: per window, the smallest id that has it;
    and where each segment's windows start."""
    windows = rows[:, WINDOWS_AT].astype(np.int64)
    base = np.append(0, np.cumsum(windows))
    smallest = np.repeat(owner, windows)
    key = keys_of_segments(rows)
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    which = which.ravel()
    met = np.flatnonzero(n[which] > 1)  # a key with one distinct segment repeats as a whole
    for some, least, most in _portions(met[np.argsort(which[met], kind="stable")], which, windows):
        segment = np.repeat(some, windows[some])
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows[some]) - windows[some], windows[some])
        if least > 0 or most < SPREAD:  # equal windows have their anchors at the same place
            before = rows[segment, ANCHOR_AT].astype(np.int64) - offset
            segment, offset = segment[(before >= least) & (before < most)], offset[(before >= least) & (before < most)]
        if not len(segment):
            continue
        starts = segment * WIDTH + offset
        ends = np.minimum(segment * WIDTH + windows[segment] + LENGTH - 1, starts + LENGTH + most - least - 1)
        opens = (offset == 0) | (rows[segment, ANCHOR_AT] - offset == most - 1)
        order, found = maximal_repeats(rows.ravel(), starts, ends, opens, owner[segment], LENGTH, LENGTH - 1 + SPREAD)
        at = (base[segment] + offset)[order]
        for i in range(0, len(found), 50_000):  # occurrences of some repeats at a time
            length, left, right, low = found[i : i + 50_000].T
            size = right - left + 1
            member = np.repeat(left - np.cumsum(size) + size, size) + np.arange(size.sum())
            reach = np.repeat(length - LENGTH + 1, size)
            windows_of = np.repeat(at[member] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
            np.minimum.at(smallest, windows_of, np.repeat(np.repeat(low, size), reach))
    return smallest, base


def _runs(smallest: np.ndarray, base: np.ndarray):
    """Run-length coding per segment: runs per segment, run lengths, values."""
    new = np.ones(len(smallest), bool)
    new[1:] = smallest[1:] != smallest[:-1]
    new[base[:-1]] = True
    at = np.flatnonzero(new)
    return np.diff(np.searchsorted(at, base)), np.diff(np.append(at, len(smallest))), smallest[at]


def _ids(ids: list) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


SEGMENTS = "bucket long, batch long, rows binary, ids binary"
RUNS = "batch long, bucket long, per binary, lengths binary, smallest binary"


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, spans (array of start, length of the removed runs, in bytes), kept (binary).

    A byte is removed if it is covered by a string of LENGTH bytes that also starts in a document of smaller
    id, judged on the input. Ids are integers; rows of one id never remove from each other, so of repeated
    rows with one id all stay. A null id counts as larger than any other. A null text is empty; a text of
    fewer than LENGTH bytes stays whole. An empty table gives an empty result; other columns are not read.
    """
    return _removed(docs, id_col, text_col, "binary").drop("digest")


def _removed(docs: DataFrame, id_col: str, text_col: str, kept_type: str) -> DataFrame:
    """remove_repeats with what is kept as binary, or as string without the characters that were cut."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = batched(docs, "id", "text")
    size = table.agg(F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    bits = bucket_bits(2 * size // (SPREAD + 1))
    segment_bits = bucket_bits(8 * size // (SPREAD + 1))

    n, fan, hot = table.count(), B.FAN_BITS, HOT

    def levels(answers: pa.Table) -> list[np.ndarray]:
        """The answers of a batch by level."""
        ours = answers.filter(pc.is_valid(answers["totals"]))
        return [totals_of(ours.filter(pc.equal(ours["level"], k))) for k in range(depth)]

    def send(_, left: pa.Table, right: pa.Table) -> pa.Table:
        with working("batches"):
            out = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())]).empty_table()
            if left.num_rows:
                keys, counts = asked(*unpacked(left["lens"][0].as_py(), left["blob"][0].as_py()), levels(right), hot).rows_per_key()
                if len(keys):
                    out = pa.Table.from_batches([sent(left["batch"][0].as_py(), keys, counts, bits, fan)])
            return out

    def first(batches):
        with working("batches"):
            for b in batches:
                for i in range(b.num_rows):
                    keys, counts = Anchors(*unpacked(b["lens"][i].as_py(), b["blob"][i].as_py())).rows_per_key()
                    if len(keys):
                        yield sent(b["batch"][i].as_py(), keys, counts, bits, fan)

    def tally(batches):
        """Rows with a hot answer."""
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((int(counted(np.frombuffer(t, np.uint8)).max()) for t in b.column(0).to_pylist() if t), default=0)], pa.int64())], ["most"])

    depth = 0
    narrow = table.select("batch", "lens", "blob")
    counts = answered(narrow.mapInArrow(first, SENT), bits, fan, n).withColumn("level", F.lit(0))
    while True:
        depth += 1
        most = counts.where(F.col("level") == depth - 1).select("totals").mapInArrow(tally, "most long").agg(F.max("most")).first()[0] or 0
        if most <= hot or depth == len(PARTS):
            break
        more = answered(narrow.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(send, SENT), bits, fan, n)
        counts = counts.unionByName(more.withColumn("level", F.lit(depth)))

    def send_segments(_, left: pa.Table, right: pa.Table) -> pa.Table:
        with working("batches"):
            out = [[], [], [], []]
            if left.num_rows and right.num_rows:
                anchors, shared = final(*unpacked(left["lens"][0].as_py(), left["blob"][0].as_py()), levels(right), hot)
                rows, keys, mine, which = anchors.segments(shared)
                ids = np.full(len(rows), NO_ID)
                np.minimum.at(ids, which, _ids(left["ids"][0].as_py())[anchors.doc[mine]])
                edges = np.searchsorted(keys, np.arange(1, 1 << segment_bits, dtype=np.uint64) << np.uint64(64 - segment_bits)) if segment_bits else []
                ends = [0, *map(int, edges), len(rows)]
                for k, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
                    if z > a:
                        for to, x in zip(out, (k, left["batch"][0].as_py(), rows[a:z].tobytes(), ids[a:z].tobytes()), strict=True):
                            to.append(x)
            return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "batch", "rows", "ids"])

    def met(t: pa.Table):
        """Distinct segments of the rows, the smallest id of each, which each row's are, and where each row starts."""
        rows = np.frombuffer(b"".join(t["rows"].to_pylist()), np.uint8).reshape(-1, WIDTH)
        ids = np.frombuffer(b"".join(t["ids"].to_pylist()), np.int64)
        _, at, which = np.unique(row_names(rows, keys_of_segments(rows)), return_index=True, return_inverse=True)
        owner = np.full(len(at), NO_ID)
        np.minimum.at(owner, which.ravel(), ids)
        return rows[at], owner, which.ravel(), np.cumsum([0, *(len(x) // 8 for x in t["ids"].to_pylist())])

    def told(t: pa.Table, per, lengths, smallest, which, ends) -> pa.Table:
        """The runs of each row's segments, from those of the distinct ones."""
        first = np.append(0, np.cumsum(per))
        out = [[], [], []]
        for a, z in zip(ends, ends[1:], strict=False):
            mine = which[a:z]
            size = per[mine]
            take = np.repeat(first[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
            for to, x in zip(out, (size.astype(np.uint8), lengths[take].astype(np.uint8), smallest[take]), strict=True):
                to.append(x.tobytes())
        return pa.table([t["batch"], t["bucket"], *(pa.array(x, pa.binary()) for x in out)], ["batch", "bucket", "per", "lengths", "smallest"])

    def scan(t: pa.Table) -> pa.Table:
        with working("batches"):
            rows, owner, which, ends = met(t)
            return told(t, *_runs(*smallest_per_window(rows, owner)), which, ends)

    def merge(t: pa.Table) -> pa.Table:
        with working("batches"):
            rows, owner, _, _ = met(t)
            return pa.table({"bucket": t["bucket"][:1], "batch": t["crate"][:1], "rows": pa.array([rows.tobytes()], pa.binary()), "ids": pa.array([owner.tobytes()], pa.binary())})

    def back(_, left: pa.Table, right: pa.Table) -> pa.Table:
        with working("batches"):
            _, _, which, ends = met(left)
            per, lengths, smallest = (np.frombuffer(right[c][0].as_py(), kind) for c, kind in (("per", np.uint8), ("lengths", np.uint8), ("smallest", np.int64)))
            return told(left, per.astype(np.int64), lengths, smallest, which, ends)

    segments = table.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(send_segments, SEGMENTS)
    if n <= B.CRATE_BATCHES:
        runs = cut(segments.groupBy("bucket").applyInArrow(scan, RUNS))
    else:  # equal segments of many batches meet first, so that one that all batches have is no load on its bucket
        segments = cut(segments.withColumn("crate", crates("batch", shards(n, B.CRATE_BATCHES))))
        found = cut(segments.groupBy("bucket", "crate").applyInArrow(merge, SEGMENTS).groupBy("bucket").applyInArrow(scan, RUNS))
        runs = cut(segments.groupBy("bucket", "crate").cogroup(found.withColumnRenamed("batch", "crate").groupBy("bucket", "crate")).applyInArrow(back, RUNS))

    def remove(_, left: pa.Table, right: pa.Table) -> pa.Table:
        with working("batches"):
            ids, lens = left["ids"][0].as_py(), left["lens"][0].as_py()
            data, starts = unpacked(lens, left["blob"][0].as_py())
            covered = np.zeros(len(data) + 1, np.int32)
            if right.num_rows:
                anchors, shared = final(data, starts, levels(right), hot)
                rows, _, mine, which = anchors.segments(shared)
                if len(rows):
                    theirs = right.filter(pc.is_valid(right["per"]))
                    order = np.argsort(theirs["bucket"].to_numpy())
                    joined = lambda c, kind: np.frombuffer(b"".join(theirs[c][int(i)].as_py() for i in order), kind)
                    per, lengths, smallest = joined("per", np.uint8).astype(np.int64), joined("lengths", np.uint8).astype(np.int64), joined("smallest", np.int64)
                    first = np.append(0, np.cumsum(per))
                    size = per[which]
                    take = np.repeat(first[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    occurrence = np.repeat(np.arange(len(mine)), size)
                    from_ = np.append(0, np.cumsum(lengths))[take] - np.append(0, np.cumsum(lengths))[first[which[occurrence]]] + anchors.first[mine[occurrence]]
                    gone = smallest[take] < _ids(ids)[anchors.doc[mine[occurrence]]]
                    np.add.at(covered, from_[gone], 1)
                    np.add.at(covered, (from_ + lengths[take] + LENGTH - 1)[gone], -1)
            mask = np.cumsum(covered[:-1]) > 0
            text = np.frombuffer(data, np.uint8)
            spans, kept, digests = [], [], []
            for a, z in zip(starts, starts[1:], strict=False):
                m = mask[a:z]
                if m.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], m.view(np.int8), [0]))))
                    spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(text[a:z][~m].tobytes())
                    digests.append(hashlib.sha256(data[a:z]).hexdigest())
                else:
                    spans.append([])
                    kept.append(data[a:z])
                    digests.append(None)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            left_over = pa.array(kept, pa.binary()) if kept_type == "binary" else pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            return pa.table([pa.array(ids, pa.int64()), pa.array(lens, pa.int64()), pa.array(spans, kind), left_over, pa.array(digests, pa.string())], ["id", "n_bytes", "spans", "kept", "digest"])

    answers = counts.select("batch", "bucket", "totals", "level", *(F.lit(None).cast("binary").alias(c) for c in ("per", "lengths", "smallest"))).unionByName(runs.withColumns({"totals": F.lit(None).cast("binary"), "level": F.lit(None).cast("int")}))
    out = table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(remove, f"id long, n_bytes long, spans array<struct<start:long,length:long>>, kept {kept_type}, digest string")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeats removed from the text; n_chars, if there is one, is that of the new text.

    Cutting bytes may split a character; what is left of it is dropped. A null text stays null. Ids may be null
    (larger than any) and may repeat: what is removed from a row depends on its id and text alone, so rows take
    the text that was found for their id and the digest of their text.
    """
    # One Python step, not two in a row: each would keep a worker of its own.
    changed = _removed(docs, id_col, text_col, "string").where(F.size("spans") > 0)
    changed = changed.select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_digest"])
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.sha2(docs[text_col].cast("binary"), 256) == F.col("_digest"))
    out = docs.join(changed, same, "left").withColumn(text_col, F.coalesce("_kept", text_col))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_kept").isNotNull(), F.length("_kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
