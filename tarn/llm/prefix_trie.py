"""Conversation prefix trie: every distinct sequence of first turns is a node, owned by its smallest member.

A prefix is known by its depth and a 128-bit digest, the exclusive or of digests of (depth, turn), so prefixes of
conversations of any length are running totals that are worked out in blocks. An aggregation over prefixes gives
the smallest member of each (the prefix-digest minima). Members shrink with depth, so what a conversation owns is
a tail of its path, its chain: the first owned depth is found by binary search, one batched join with the minima
for each halving, over blocks of bounded size side by side. A chain hangs below the owner of the prefix just
above it. Sums over subtrees go up the tree of chains by pointer doubling, in as many rounds as the logarithm of
its height, and are then spread over the nodes of each chain as running totals.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, working

#: Turns of a conversation that meet in one row or window at most.
BLOCK = 1024
#: Bytes of joined ids in one row at most, about.
CHUNK_BYTES = 1 << 20
EMPTY_SHA256 = hashlib.sha256().hexdigest()
KEY = ["d", "x1", "x2"]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; the length of the role keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def in_order(turns: DataFrame) -> DataFrame:
    """(c, n_turns, start, items): the turns of each conversation in order, in rows of at most BLOCK of them.

    turns has c, turn, t (digest), cp. The order is turn (null first), then digest; equal rows keep their number.
    Rows are dealt by ranges of the whole order, so a conversation of any length is spread over tasks.
    """
    rows = cut(turns.withColumn("salt", F.monotonically_increasing_id()))  # fixed before rows are dealt: a task that is run again deals alike
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("t"), F.col("salt")]
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    local = dealt.withColumn("i", F.row_number().over(W.partitionBy("c", "part").orderBy(*order[1:])) - 1).withColumn("b", F.floor(F.col("i") / BLOCK))
    held = local.groupBy("c", "part", "b").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "t", "cp"))).alias("items"))
    so_far = W.partitionBy("c").orderBy("part", "b")  # a row for each block
    found = cut(held.select("c", "part", "b", "n", F.transform("items", lambda x: F.struct(x["t"].alias("t"), x["cp"].alias("cp"))).alias("items")))
    found = found.withColumn("start", F.sum("n").over(so_far) - F.col("n")).withColumn("n_turns", F.sum("n").over(W.partitionBy("c")))
    return cut(found.select("c", "n_turns", "start", "items"))


def rebuilt(held: DataFrame, group: int, most: int) -> DataFrame:
    """(c, d, t, cp) of the rebuilt conversations, and the table (c, length) of all of them, turnless ones too."""
    mine = held.select("c", F.col("n_turns").alias("n")).where(F.col("start") == 0)
    convs = mine.withColumn("base", F.col("c") - F.col("c") % group).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1))
    first = held.where((F.col("start") < most) & (F.col("c") % group == 0)).select(F.col("c").alias("base"), F.posexplode(F.slice("items", 1, most)).alias("i", "item"), "start")
    first = first.withColumn("i", F.col("start") + F.col("i")).where(F.col("i") < most)
    heads = first.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType)))
    convs = convs.withColumn("given", F.size("head").cast("long"))
    convs = cut(convs.select("c", "h", "given", "head", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    taken = convs.select("c", F.explode("head").alias("x")).select("c", (F.col("x.i") + 1).alias("d"), "x.item.t", "x.item.cp")
    own = held.join(convs.select("c", "h", "given"), "c").select("c", "start", "h", "given", F.posexplode("items").alias("i", "x"))
    own = own.withColumn("p", F.col("start") + F.col("i")).where(F.col("p") >= F.col("h"))
    own = own.select("c", (F.col("p") - F.col("h") + F.col("given") + 1).alias("d"), "x.t", "x.cp")
    return taken.unionByName(own), convs.select("c", "length")


def running(rows: DataFrame, keys: list[str], names: list[str], total, *, falling: bool = False) -> DataFrame:
    """Running totals of the columns along d in each group of keys, by blocks of BLOCK depths and then across the
    blocks of the few groups that have more than one. From the far end if falling."""
    rows = rows.withColumn("blk", F.floor(F.col("d") / BLOCK))
    inside = W.partitionBy(*keys, "blk").orderBy(F.desc("d") if falling else F.asc("d")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({n: total(n).over(inside) for n in names})
    far = F.min_by if falling else F.max_by
    blocks = rows.groupBy(*keys, "blk").agg(*(far(n, "d").alias(f"_{n}") for n in names))
    across = W.partitionBy(*keys).orderBy(F.desc("blk") if falling else F.asc("blk")).rowsBetween(W.unboundedPreceding, -1)
    before = blocks.withColumn("several", F.count("*").over(W.partitionBy(*keys)) > 1).withColumns({f"_{n}": total(f"_{n}").over(across) for n in names}).where("several").drop("several")
    rows = rows.join(before, [*keys, "blk"], "left")
    zero = F.lit(0).cast("long")
    both = (lambda n: F.col(n).bitwiseXOR(F.coalesce(f"_{n}", zero))) if total is F.bit_xor else (lambda n: F.col(n) + F.coalesce(F.col(f"_{n}"), zero))
    return rows.withColumns({n: both(n) for n in names}).drop("blk", *(f"_{n}" for n in names))


def first_owned(paths: DataFrame, chains: DataFrame, minima: DataFrame) -> DataFrame:
    """(c, f, p): each chain's first owned depth and the owner of the prefix above it, null at depth 1.

    Blocks of a path are searched side by side. In each round every block still in search looks up the digest in
    the middle of what is left of it; owned: the left part stays, else the right part.
    """
    mine = paths.join(chains.select("c"), "c", "left_semi").withColumn("blk", F.floor(F.col("d") / BLOCK))
    state = mine.groupBy("c", "blk").agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("left"))
    state = cut(state.select("c", "left", F.lit(None).cast("long").alias("found"), F.lit(None).cast("struct<d:long,p:long>").alias("under")))
    least = minima.select(*KEY, "owner")
    done = []
    for _ in range((state.agg(F.max(F.size("left"))).first()[0] or 0).bit_length()):
        mid = F.floor(F.size("left") / 2).cast("int")
        asked = state.where(F.size("left") > 0).withColumn("m", mid).withColumn("at", F.element_at("left", F.col("m") + 1))
        asked = asked.withColumns({k: F.col(f"at.{k}") for k in KEY}).join(least, KEY)
        own = F.col("owner") == F.col("c")
        left = F.when(own, F.slice("left", F.lit(1), F.col("m"))).otherwise(F.slice("left", F.col("m") + 2, F.size("left")))
        under = F.when(own, F.col("under")).otherwise(F.struct(F.col("d"), F.col("owner").alias("p")))
        state = cut(asked.select("c", left.alias("left"), F.when(own, F.col("d")).otherwise(F.col("found")).alias("found"), under.alias("under")))
        done.append(state.where(F.size("left") == 0).select("c", "found", "under"))
    found = state.select("c", "found", "under").limit(0)
    for part in done:
        found = found.unionByName(part)
    return found.groupBy("c").agg(F.min("found").alias("f"), F.max("under")["p"].alias("p"))


def summed_up(chains: DataFrame) -> DataFrame:
    """(c, v, l): v and l summed over a chain and all chains below it; chains has c, p (null at the top), v, l.

    After k rounds a chain holds the sums of those less than 2**k steps below it, and points 2**k steps up.
    """
    state = cut(chains.select("c", F.col("p").alias("up"), "v", "l"))
    while not state.where(F.col("up").isNotNull()).isEmpty():
        sent = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("c")).agg(F.sum("v").alias("dv"), F.sum("l").alias("dl"))
        ups = state.where(F.col("up").isNotNull()).select(F.col("c").alias("up"), F.col("up").alias("further"))
        state = state.join(sent, "c", "left").join(ups, "up", "left")
        more = lambda n: F.col(n) + F.coalesce(F.col(f"d{n}"), F.lit(0))
        state = cut(state.select("c", F.col("further").alias("up"), more("v").alias("v"), more("l").alias("l")))
    return state.select("c", "v", "l")


def joined_ids(ends: DataFrame) -> DataFrame:
    """(d, x1, x2, sha): SHA-256 of the decimal ids of each group in rising order, joined by commas.

    Ids are joined to strings of bounded size where ranges of the whole order lie; the strings of a group then
    pass its hash one after the other, so no group is held as a whole.
    """
    bounded_batches(ends.sparkSession)

    def chunks(batches):
        with working("prefix_trie"):
            for b in batches:
                if not b.num_rows:
                    continue
                keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                ids = b.column(3)
                texts = pc.cast(ids, pa.string()).to_pylist()
                cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
                out = []
                for a, z in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                    step = CHUNK_BYTES // 20
                    out += [(*keys[a], ids[k].as_py(), ",".join(texts[k : min(z, k + step)])) for k in range(a, z, step)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], [*KEY, "least", "ids"])

    def hashed(batches):
        with working("prefix_trie"):
            key, sha, out = None, None, []

            def emitted():
                got = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], [*KEY, "sha"])
                out.clear()
                return got

            for b in batches:
                for *k, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                    if k != key:
                        if key is not None:
                            out.append((*key, sha.hexdigest()))
                        key, sha = k, hashlib.sha256(ids.encode())
                    else:
                        sha.update(b"," + ids.encode())
                if out:
                    yield emitted()
            if key is not None:
                out.append((*key, sha.hexdigest()))
                yield emitted()

    order = [*KEY, "c"]
    parts = cut(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "d long, x1 long, x2 long, least long, ids string"))
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(hashed, "d long, x1 long, x2 long, sha string")


def trie(conversations: DataFrame, *, group: int = 100, most: int = 5, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Each conversation c is rebuilt from the first crc32(c) % (most + 1) turns of conversation c - c % group and its
    own turns after as many. Null role or text is empty. Turns are ordered by turn, null first; equal turn numbers
    by the digest of role and text; repeated rows count as turns of their own. Rows without an id take no part; ids
    are integers. A conversation may have no turns left; it is a member of the root. No rows: no nodes, no root
    either. Other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where(F.col(id_col).isNotNull())
    turns = turns.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), turn_digest(text(role_col), text(text_col)).alias("t"), F.length(text(text_col)).cast("long").alias("cp"))
    steps, convs = rebuilt(in_order(turns), group, most)
    code = lambda k: F.xxhash64(F.lit(k), F.col("t"), F.col("d"))
    steps = steps.select("c", "d", "cp", code(1).alias("x1"), code(2).alias("x2"))
    paths = cut(running(steps, ["c"], ["x1", "x2"], F.bit_xor))
    root = convs.agg(F.min("c").alias("owner"), F.count("*").alias("n")).where("n > 0").select(*(F.lit(0).cast("long").alias(k) for k in KEY), "owner", "n", F.lit(0).cast("long").alias("cp"))
    minima = cut(paths.groupBy(*KEY).agg(F.min("c").alias("owner"), F.count("*").alias("n"), F.max("cp").alias("cp")).unionByName(root))

    last = paths.join(convs, (paths["c"] == convs["c"]) & (paths["d"] == convs["length"])).select(paths["c"], *(paths[k] for k in KEY))
    ends = cut(last.unionByName(convs.where("length = 0").select("c", *(F.lit(0).cast("long").alias(k) for k in KEY))))
    nodes = cut(minima.join(joined_ids(ends), KEY, "left").withColumn("sha", F.coalesce("sha", F.lit(EMPTY_SHA256))))

    # A chain ends at a node that its owner ends at: of equal conversations only the smallest can own one.
    top = F.broadcast(nodes.where("d = 0").select(F.col("owner").alias("top")))  # one row
    closing = ends.groupBy(*KEY).agg(F.min("c").alias("c"))
    chains = cut(closing.join(minima, KEY).where(F.col("owner") == F.col("c")).select("c", F.col("d").alias("length")))
    found = first_owned(paths, chains, minima)
    chains = chains.join(found, "c", "left").crossJoin(top)
    chains = chains.select("c", "length", F.when(F.col("c") == F.col("top"), 0).otherwise(F.col("f")).cast("long").alias("f"), F.when(F.col("c") != F.col("top"), F.coalesce("p", "top")).alias("p"))
    chains = cut(chains)

    hung = chains.where(F.col("p").isNotNull()).groupBy(F.col("p").alias("c"), (F.col("f") - 1).alias("d")).agg(F.count("*").alias("hung"))
    nodes = nodes.withColumnRenamed("owner", "c").join(chains, "c").join(hung, ["c", "d"], "left")
    children = (F.col("d") < F.col("length")).cast("long") + F.coalesce(F.col("hung"), F.lit(0))
    nodes = nodes.select("c", "d", "n", "sha", F.when(F.col("d") > F.col("f"), F.col("c")).otherwise(F.col("p")).alias("parent"), children.alias("n_children"), ((F.col("n") - 1) * F.col("cp")).alias("v"))
    nodes = cut(nodes.withColumn("l", (F.col("n_children") == 0).cast("long")))
    sums = summed_up(chains.join(nodes.groupBy("c").agg(F.sum("v").alias("v"), F.sum("l").alias("l")), "c"))
    below = chains.where(F.col("p").isNotNull()).join(sums, "c").groupBy(F.col("p").alias("c"), (F.col("f") - 1).alias("d")).agg(F.sum("v").alias("bv"), F.sum("l").alias("bl"))
    nodes = nodes.join(below, ["c", "d"], "left").withColumns({n: F.col(n) + F.coalesce(F.col(f"b{n}"), F.lit(0)) for n in ("v", "l")}).drop("bv", "bl")
    nodes = running(nodes, ["c"], ["v", "l"], F.sum, falling=True)
    return nodes.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("l").alias("n_leaves"), F.col("v").alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )
