"""N-gram Jaccard join by prefix filters under several global token orders.

A token is the 64-bit hash of a shingle. For similarity t, two linked sets of n and m tokens share a token
among the first n - ceil(t n) + 1 of one and m - ceil(t m) + 1 of the other, whatever order all tokens are
put in. Candidates must do so under three orders, which are intersected before any pair is verified:
A: rarest token first, by document frequency over the whole corpus (ties by hash); B: by hash, ascending;
C: by hash, descending. Under A, a set whose prefix holds only tokens of its own has no partner at all,
which takes most documents out before any pair is made.

Equal sets are one class from the start. Links are asked for classes, not for pairs of copies, and not for
pairs that are already in one component: first each class is held against one hub of each of its prefix
tokens, which joins a large group of near copies through a star; then every pair left that shares a prefix
token across two components is held against each other. So no link between components is lost and no group
is expanded into all of its pairs. Shingle sets are never cut, and no number of partners is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .batches import SENT, answered, batched, bucket_bits, sent, totals_of, unpacked
from .common import cut, working

GROUP_BYTES = 256 << 10
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_BYTES = np.random.default_rng(2).integers(1, 1 << 63, 256, np.uint64)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    return h


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts, and its hash: a polynomial over its bytes, from running sums."""
    n = len(data)
    powers = _powers
    if len(powers[0]) <= n:
        powers = []
        for b in (_BASE, _INVERSE):
            steps = np.full(max(n, GROUP_BYTES) + 1, b, np.uint64)
            steps[0] = 1
            powers.append(np.cumprod(steps))
        if n <= GROUP_BYTES:  # those of a longer document are not kept
            _powers[:] = powers
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[0][:n], out=sums[1:])
    return start, _mixed((sums[end] - sums[start]) * powers[1][start] + (end - start).astype(np.uint64))


def token_sets(data: bytes, starts: np.ndarray, width: int = 5, keep=None) -> list[np.ndarray]:
    """For each document of a batch (or those at the places keep) its sorted distinct shingle hashes.

    Documents are worked on in groups of some hundred kilobytes (a longer one stands alone), which keeps the
    arrays small; within a group they are told apart by a space put between them.
    """
    keep = range(len(starts) - 1) if keep is None else keep
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for i in keep:
        part = data[starts[i] : starts[i + 1]]
        if group and held + len(part) > GROUP_BYTES:
            out += _group_sets(group, width)
            group, held = [], 0
        group.append(part)
        held += len(part)
    return out + _group_sets(group, width) if group else out


def _group_sets(parts: list[bytes], width: int) -> list[np.ndarray]:
    joined = np.frombuffer(b" ".join(parts).translate(_LOWER), np.uint8)
    begin, one = _word_hashes(joined)
    if len(one) >= width:
        n = len(one) - width + 1
        every = np.full(n, width, np.uint64)
        for k in range(width):
            every = (every ^ (every >> np.uint64(29))) * _FACTORS[k % len(_FACTORS)] + one[k : k + n]
        every = _mixed(every)
    bounds = np.searchsorted(begin, np.cumsum([0, *(len(p) + 1 for p in parts)]))
    out = []
    for a, z in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if z - a >= width:
            found = np.sort(every[a : z - width + 1])
            found = found[np.flatnonzero(np.diff(found, prepend=~found[:1]))]
        elif z > a:
            h = np.full(1, z - a, np.uint64)
            for k in range(a, z):
                h = (h ^ (h >> np.uint64(29))) * _FACTORS[(k - a) % len(_FACTORS)] + one[k : k + 1]
            found = _mixed(h)
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
    return out


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of width words; one for the whole text if it has fewer."""
    data = text.encode()
    return token_sets(data, np.array([0, len(data)]), width)[0]


def _note(width: int):
    def note(data: bytes, starts: np.ndarray) -> list[dict]:
        return [{"n": len(t), "set": hashlib.blake2b(t.tobytes(), digest_size=16).digest() if len(t) else b""} for t in token_sets(data, starts, width)]

    return note


def _tokens(lens, blob, keep, width):
    """Tokens of the documents of a batch at the given places."""
    return token_sets(*unpacked(lens, blob), width, keep)


def live_sets(table: DataFrame, batches: int, chosen: DataFrame, percent: int, width: int, keys: int) -> DataFrame:
    """Classes that may have a partner: set, n, tokens (those in two classes or more, by hash), low and high
    (how many of them lie in the prefix under B and C), prefix (tokens of the prefix under A, in order).

    table: batches, so many of them; chosen: (batch, places), the documents that stand for their class.
    """
    bits, fan = bucket_bits(keys), B.FAN_BITS

    def send(_, left: pa.Table, right: pa.Table) -> pa.Table:
        with working("batches"):
            keep = right["places"][0].as_py() if right.num_rows else []
            if not keep or not left.num_rows:
                return pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())]).empty_table()
            tokens, counts = np.unique(np.concatenate(_tokens(left["lens"][0].as_py(), left["blob"][0].as_py(), keep, width)), return_counts=True)
            return pa.Table.from_batches([sent(left["batch"][0].as_py(), tokens, counts, bits, fan)])

    sides = table.select("batch", "lens", "blob"), chosen
    counts = answered(sides[0].groupBy("batch").cogroup(sides[1].groupBy("batch")).applyInArrow(send, SENT), bits, fan, batches)
    out_schema = "`set` binary, n int, tokens array<long>, low int, high int, prefix array<long>"

    def pick(_, left: pa.Table, right: pa.Table) -> pa.Table:
        with working("batches"):
            out = {k: [] for k in ("set", "n", "tokens", "low", "high", "prefix")}
            if right.num_rows and left.num_rows and left["places"][0].as_py():
                keep, notes = left["places"][0].as_py(), left["notes"][0].as_py()
                sets = _tokens(left["lens"][0].as_py(), left["blob"][0].as_py(), keep, width)
                every, places = np.unique(np.concatenate(sets), return_inverse=True)
                total = totals_of(right)[places]
                at = 0
                for i, tokens in zip(keep, sets, strict=True):
                    n, df = len(tokens), total[at : at + len(tokens)]
                    at += n
                    need = -(-percent * n // 100)
                    shared = df >= 2
                    both = int(shared.sum())
                    if n == 0 or both < need:
                        continue
                    size = n - need + 1
                    common, order = tokens[shared], np.lexsort((tokens[shared], df[shared]))
                    out["set"].append(notes[i]["set"])
                    out["n"].append(n)
                    out["tokens"].append(common.view(np.int64))
                    out["low"].append(int(shared[:size].sum()))
                    out["high"].append(int(shared[-size:].sum()))
                    out["prefix"].append(common[order[: size - (n - both)]].view(np.int64))
            longs = pa.list_(pa.int64())
            return pa.table([pa.array(out["set"], pa.binary()), pa.array(out["n"], pa.int32()), pa.array(out["tokens"], longs), pa.array(out["low"], pa.int32()), pa.array(out["high"], pa.int32()), pa.array(out["prefix"], longs)], list(out))

    whole = table.join(chosen, "batch").select("batch", "lens", "blob", "notes", "places")
    return cut(whole.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(pick, out_schema))


def verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that pass the prefix filters under B and C and have the similarity asked for."""
    side = lambda x: live.select(F.col("set").alias(x), F.col("n").alias(f"{x}_n"), F.col("tokens").alias(f"{x}_t"), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    low = lambda x: F.slice(f"{x}_t", F.lit(1), F.col(f"{x}_low"))
    high = lambda x: F.when(F.col(f"{x}_high") > 0, F.slice(f"{x}_t", F.size(f"{x}_t") - F.col(f"{x}_high") + 1, F.col(f"{x}_high"))).otherwise(F.array().cast("array<bigint>"))
    held = held.where(F.arrays_overlap(low("a"), low("b"))).where(F.arrays_overlap(high("a"), high("b")))
    both = F.size(F.array_intersect("a_t", "b_t"))
    return held.where(100 * both >= percent * (F.col("a_n") + F.col("b_n") - both)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each connected component as its label, for links (a, b).

    Each round takes the smallest label among neighbours and then jumps to the label's own label, so the
    number of rounds grows with the logarithm of the longest chain. Nothing is gathered on the driver.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = cut(step.join(up, "label").select("node", "was", "top"))
        labels = step.select("node", F.col("top").alias("label"))
        if step.where("was <> top").isEmpty():
            return labels


def near_links(live: DataFrame, percent: int, *, every: bool = False) -> DataFrame:
    """Links (a, b) that connect exactly the classes that all links connect; with every, all links."""
    ratio = F.size("tokens") / F.col("n")
    postings = live.select("set", "n", ratio.alias("ratio"), (F.col("n") - F.size("tokens")).alias("own"), F.posexplode("prefix").alias("at", "token"))
    postings = cut(postings.select("token", "set", "n", "ratio", (F.col("own") + F.col("at")).alias("at")))
    # What two sets can share from their first common token on must reach the overlap that links need.
    possible = lambda a, b: (F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at")) * (100 + percent) >= percent * (F.col(f"{a}n") + F.col(f"{b}n")))
    renamed = lambda df, p: df.select("token", *(F.col(c).alias(p + c) for c in df.columns if c != "token"))
    pair = (F.least("x_set", "y_set").alias("a"), F.greatest("x_set", "y_set").alias("b"))

    if every:
        met = renamed(postings, "x_").join(renamed(postings, "y_"), "token").where((F.col("x_set") < F.col("y_set")) & possible("x_", "y_"))
        return cut(verified(cut(met.select(*pair).distinct()), live, percent))
    hubs = postings.groupBy("token").agg(F.max(F.struct("ratio", "set", "n", "at")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = hubs.select("token", *(F.col(f"hub.{c}").alias(f"y_{c}") for c in ("set", "n", "at")))
    tried = cut(renamed(postings, "x_").join(hubs, "token").where((F.col("x_set") != F.col("y_set")) & possible("x_", "y_")).select(*pair).distinct())
    links = cut(verified(tried, live, percent))
    labels = components(links)

    labelled = postings.join(labels, postings.set == labels.node, "left").select("token", "set", "n", "at", F.coalesce("label", "set").alias("label"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("token")
    labelled = cut(labelled.join(mixed, "token"))
    cross = renamed(labelled, "x_").join(renamed(labelled, "y_"), "token").where((F.col("x_label") < F.col("y_label")) & possible("x_", "y_")).select(*pair).distinct()
    more = verified(cut(cross.join(tried, ["a", "b"], "left_anti")), live, percent)
    return cut(links.union(more))


def _classes(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (batch, place, id, n, set), classes (set, at, least, n, rows) of equal sets, and live_sets of them."""
    table = batched(docs, id_col, text_col, _note(width), "struct<n:bigint,`set`:binary>")
    rows = table.select("batch", F.posexplode(F.arrays_zip("ids", "notes")).alias("place", "x")).select("batch", "place", F.col("x.ids").alias("id"), F.col("x.notes.n").alias("n"), F.col("x.notes.set").alias("set"))
    rows = cut(rows)
    classes = cut(rows.where("n > 0").groupBy("set").agg(F.min(F.struct("batch", "place")).alias("at"), F.min("id").alias("least"), F.max("n").alias("n"), F.count("*").alias("rows")))
    keys = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chosen = classes.groupBy(F.col("at.batch").alias("batch")).agg(F.sort_array(F.collect_list("at.place")).alias("places"))  # at most one batch's rows
    return rows, classes, live_sets(table, table.count(), cut(chosen), percent, width, keys)


def link_counts(docs: DataFrame, percent: int = 80, *, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_links, the number of other rows that it is linked to, copies of its set included.

    Every pair of classes that can be linked is held against each other, inside components as well, so the work
    grows with the number of links. Empty sets have none. Texts and ids as in jaccard_classes.
    """
    rows, classes, live = _classes(docs, percent, width, id_col, text_col)
    links = near_links(live, percent, every=True)
    both = links.union(links.select("b", "a"))
    linked = both.join(classes.select(F.col("set").alias("b"), F.col("rows").alias("others")), "b").groupBy("a").agg(F.sum("others").alias("others"))
    counts = classes.join(linked, classes.set == linked.a, "left").select(F.col("set").alias("_set"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(counts, rows.set == F.col("_set"), "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_classes(docs: DataFrame, percent: int = 80, *, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that links reach, the own one included), n_holding.

    n_holding counts the links of the row's class among those that were needed to hold its component together,
    which depends on the stars; the number of links is that of link_counts. Texts are lower-cased in A-Z only; words are runs of anything but
    ASCII white space. Null, empty and blank texts have an empty set, no links and themselves as component.
    A null id takes part; its component is the smallest other id, or null if there is none. Repeated rows
    are copies. An empty table gives an empty result; other columns are not read.
    """
    rows, classes, live = _classes(docs, percent, width, id_col, text_col)
    links = near_links(live, percent)
    labels = components(links)
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_holding"))
    labels = labels.join(degree, labels.node == degree.a, "left").select("node", "label", "n_holding")
    linked = cut(classes.join(labels, classes.set == labels.node, "left").select("set", "least", F.coalesce("label", "set").alias("label"), "n_holding"))
    least = cut(linked.groupBy("label").agg(F.min("least").alias("component")))  # a table of its own, so that the join can split a large label
    linked = cut(linked.join(least, "label").select(F.col("set").alias("_set"), "component", "n_holding"))
    out = rows.join(linked, rows.set == F.col("_set"), "left")
    alone = F.col("n") == 0
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("n_holding", F.lit(0)).alias("n_holding"))


def first_of_each(docs: DataFrame, percent: int = 80, *, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that of the smallest id, rows without an id last. Rows without words
    all stay. If ids are null or repeat, docs are numbered and written to the shared folder first."""
    n, distinct = docs.agg(F.count("*"), F.count_distinct(id_col)).first()
    if n == distinct:
        found = jaccard_classes(docs, percent, width=width, id_col=id_col, text_col=text_col)
        return docs.join(found.where(F.col(id_col) == F.col("component_id")).select(id_col), id_col, "left_semi").select(*docs.columns)
    own = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    found = jaccard_classes(own.select(key.alias("key"), F.col(text_col).alias("text")), percent, width=width, id_col="key", text_col="text")
    keep = found.where(F.col("key.row") == F.col("component_id.row")).select(F.col("key.row").alias("_row"))
    return own.join(keep, "_row", "left_semi").select(*docs.columns)
