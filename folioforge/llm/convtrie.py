"""Prefix trie of conversations, level by level: shared turns are found once for all who share them.

Downwards, the live conversations of a depth are grouped by (parent node, next turn); the smallest
conversation id of a group names its node. A conversation that is alone at its node, or ends there,
is live no more: what follows is its own chain and needs no grouping. A node is known by a 128-bit
digest chained over its turns, so a member finds its node without a join on a key that many share.
Levels go in blocks that double, so that a long trunk costs the logarithm of its depth in rounds.
Upwards, each level's leaves and savings are added up by parent and joined to the level above.

Positions inside a conversation come from a range sort, so one conversation may hold any share of
the turns. All tables between steps are written; texts move once, later steps carry digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reachable
from .common import column, drop_written, tidy, written

#: A conversation takes its first turns from the one at the multiple of ``GROUP`` below it, at most ``TURNS`` - 1.
GROUP, TURNS = 5, 9
#: Levels in the largest block, and ids gathered in one piece of a node's list.
LEVELS = 256
PIECE = 1 << 16


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes over."""
    return (F.crc32(conv.cast("string").cast("binary")) % TURNS).cast("int")


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)), 1, 16)


def placed(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, turn digest th, bytes of the text), written; sorted over all tasks, not by conversation."""
    role, text = (F.coalesce(column(c), F.lit("")) for c in (role_col, text_col))
    th = _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    base = turns.select(column(conv_col).cast("long").alias("conv"), column(turn_col).alias("turn"), th.alias("th"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv", F.col("turn").asc_nulls_first(), "th"]
    ranged = base.where("conv is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.select("conv", "th", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    runs = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    out = rows.join(runs, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "th", "bytes")
    out = written(out, "placed")
    drop_written(rows, runs)
    return out


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each has taken over its first turns, from what ``placed`` gives.

    conversations: (conv, n_turns); turns: (conv, depth from 1, th, bytes). Both are written.
    """
    sizes = own.groupBy("conv").agg(F.count("*").alias("n"))
    sizes = written(sizes.withColumn("h", shared_turns(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % GROUP), "sizes")
    bases = sizes.where("conv = base").select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(F.col("h").cast("long"), F.coalesce("base_n", F.lit(0)))
    convs = sizes.join(bases, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = written(convs, "convs")
    heads = own.where((F.col("conv") % GROUP == 0) & (F.col("pos") < TURNS)).withColumnRenamed("conv", "base")
    first = convs.select("conv", "base", "taken").join(heads, "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "th", "bytes")
    # own turns fall behind by as many as the base conversation lacks
    short = convs.where("taken < h").select("conv", (F.col("h") - F.col("taken")).alias("less"))
    rest = own.where(F.col("pos") > shared_turns(F.col("conv"))).join(short, "conv", "left")
    rest = rest.select("conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("depth"), "th", "bytes")
    turns = written(first.union(rest), "rebuilt")
    drop_written(sizes)
    return convs, turns


def _grown(turns: DataFrame, convs: DataFrame) -> tuple[list, list, list]:
    """(nodes, ends, tails) as lists of written tables, one of each for a block of levels.

    nodes: (depth, key, up, conv, n, bytes); ends: (depth, key, conv) of conversations whose last
    turn it is; tails: (conv, depth) of those that leave alone, with turns below that depth.
    """
    live = convs.where("n_turns > 0").select("conv", "n_turns", F.unhex(F.lit("")).alias("key"))
    nodes, ends, tails, low, step, spent = [], [], [], 0, 1, None
    while True:
        high = low + step
        near = turns.where((F.col("depth") > low) & (F.col("depth") <= high))
        block = near.join(live, "conv").groupBy("conv").agg(F.first("n_turns").alias("n_turns"), F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("depth", "th", "bytes"))).alias("ts"))
        chain = F.aggregate("ts", F.array(F.struct(F.lit(low).cast("long").alias("depth"), F.col("key").alias("key"), F.lit(0).cast("long").alias("bytes"))), lambda acc, t: F.concat(acc, F.array(F.struct(t["depth"].alias("depth"), _digest(F.element_at(acc, -1)["key"], t["th"]).alias("key"), t["bytes"].alias("bytes")))))
        steps = block.select("conv", "n_turns", chain.alias("ks"))
        each = steps.select("conv", "n_turns", F.posexplode(F.slice("ks", F.lit(2), F.size("ks") - 1)).alias("i", "x"), "ks")
        each = written(each.select("conv", "n_turns", F.col("x.depth").alias("depth"), F.col("x.key").alias("key"), F.col("ks")[F.col("i")]["key"].alias("up"), F.col("x.bytes").alias("bytes")), "members")
        level = written(each.groupBy("depth", "key").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("up").alias("up"), F.first("bytes").alias("bytes")), "nodes")
        nodes.append(level)
        ends.append(written(each.where("depth = n_turns").select("depth", "key", "conv"), "ends"))
        last = each.where((F.col("depth") == high) & (F.col("n_turns") > high)).select("conv", "n_turns", "key")
        alone = level.where((F.col("depth") == high) & (F.col("n") == 1)).select("conv")
        tails.append(written(last.join(alone, "conv", "left_semi").select("conv", F.lit(high).cast("long").alias("depth"), "n_turns"), "tails"))
        nxt = written(last.join(alone, "conv", "left_anti"), "live")
        drop_written(each, *([spent] if spent is not None else []))
        live = spent = nxt
        low, step = high, min(2 * step, LEVELS)
        if nxt.isEmpty():
            drop_written(nxt)
            return nodes, ends, tails


def _lists(ends: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of nodes where conversations end.

    The digest runs over ids in order, so a node's ids pass one task; they come there as pieces of
    text, each of at most ``PIECE`` neighbouring ids, and are not held.
    """
    piece = F.floor(F.col("conv") / PIECE)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "key", piece.alias("piece")).agg(ids.alias("ids"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        def row(now, sha):
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.binary()), pa.array([sha.hexdigest()])], names=["depth", "key", "ends_sha256"])

        now, sha = None, None
        for batch in batches:
            done = []
            for depth, key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == (depth, key):
                    sha.update(b",")
                else:
                    done += [row(now, sha)] if now else []
                    now, sha = (depth, key), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now:
            yield row(now, sha)

    reachable(ends.sparkSession)
    dealt = pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "piece").select("depth", "key", "ids")
    return dealt.mapInArrow(tidy(run), "depth long, key binary, ends_sha256 string")


def _rolled(shared: DataFrame, tops: DataFrame, deepest: int) -> list:
    """[(depth, key, n_children, n_leaves, saved_tokens)] of nodes of several members, a table a level.

    shared: (depth, key, up, n, bytes); tops: (depth, up) of nodes of one member below such a node.
    """
    done, below = [], None
    for depth in range(deepest, -1, -1):
        kids = tops.where(F.col("depth") == depth + 1).select("up", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if below is not None:
            kids = kids.union(below.select("up", F.col("n_leaves"), F.col("saved_tokens")))
        sums = kids.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        level = shared.where(F.col("depth") == depth).join(sums.withColumnRenamed("up", "key"), "key", "left")
        own = (F.col("n") - 1) * F.col("bytes")
        level = level.select("depth", "key", "up", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
        below = written(level, "level")
        done.append(below)
    return done


def _union(tables: list) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    Turns go by ``turn``, null first, ties by a digest of role and text; null role or text counts as
    empty. Each conversation c takes its first h turns from conversation c - c % 5 (as many as that
    has) and keeps its own after its first h, h being the CRC-32 of its id modulo 9. A node is a
    distinct sequence of first turns, the root the empty one; members start with it. saved_tokens
    adds up, over the subtree, (members - 1) times the bytes of the last text. ends_sha256 digests
    the ascending ids of the members that end there, joined by commas. Rows without a conversation
    id belong to none and are passed over; repeated rows are turns of their own. An empty table has
    no node. Other columns are ignored.
    """
    own = placed(turns, conv_col, turn_col, role_col, text_col)
    convs, path = rebuilt(own)
    drop_written(own)
    nodes, ends, tails = _grown(path, convs)
    key0 = F.unhex(F.lit(""))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).where("n > 0").select(zero.alias("depth"), key0.alias("key"), "conv", "n", F.lit(None).cast("binary").alias("up"), zero.alias("bytes"))
    known = written(_union(nodes).union(root), "trie")
    listed = written(_lists(_union([*ends, convs.where("n_turns = 0").select(zero.alias("depth"), key0.alias("key"), "conv")])), "lists")
    drop_written(*nodes, *ends)
    several = (F.col("n") > 1) | (F.col("depth") == 0)
    shared = known.where(several)
    deepest = shared.agg(F.max("depth")).first()[0]
    parents = known.select(F.col("key").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"), several.alias("under"))
    single = written(known.where(~several).join(parents, ["depth", "up"]).select("depth", "key", "up", "conv", "parent_conv_id", "under"), "single")
    levels = _rolled(shared, single.where("under"), -1 if deepest is None else deepest)
    none = F.sha2(F.lit("").cast("binary"), 256)
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    one, length = F.lit(1).cast("long"), convs.select("conv", "n_turns")
    ended = F.col("depth") == F.col("n_turns")
    chain = single.join(length, "conv").select("conv", "depth", "parent_conv_id", "n_turns")
    left = written(_union(tails).select("conv", F.col("depth").alias("since"), "n_turns"), "left")
    tail = path.select("conv", "depth").join(left, "conv").where("depth > since").select("conv", "depth", F.col("conv").alias("parent_conv_id"), "n_turns")
    lone = chain.union(tail).select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", one, F.when(ended, zero).otherwise(one), one, zero, F.when(ended, alone).otherwise(none))
    if not levels:
        return lone.toDF(*out)
    full = shared.join(_union(levels).select("depth", "key", "n_children", "n_leaves", "saved_tokens"), ["depth", "key"]).join(listed, ["depth", "key"], "left")
    full = full.join(parents.drop("under"), ["depth", "up"], "left")
    full = full.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return full.union(lone.toDF(*out))
