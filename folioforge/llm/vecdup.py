"""Near-duplicate vectors: tiles along the leading principal axes, compared leading axes first.

Vectors are scaled to length one and turned into the axes of their principal components, which
changes no cosine. Linked vectors differ by at most w = sqrt(2 - 2 t) in all, so cells of that width
only meet cells next to them on every axis. A cell on the first axis that holds more than ``TILE``
vectors is cut along the second, and so on up to ``AXES``; what is still larger is dealt to tiles of
about ``TILE`` by a hash. Every pair of tiles that may hold links is one group, and a vector goes to
a pair only if it is within w of the other tile's cell. In a group the products of leading axes are
summed first; what the other axes can add is bounded by the product of suffix norms, and pairs that
cannot reach the threshold go no further. Pairs left are decided on the original components in
double precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .components import components

TILE = 8000
#: Leading axes along which cells are cut.
AXES = 4
#: Shares of the axes after which pairs are dropped.
STEPS = (0.125, 0.25, 0.5, 1.0)


def _unit(x):
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column):
    import numpy as np

    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)])


def principal_axes(vectors: DataFrame) -> dict:
    """dimension -> matrix of principal axes of the unit vectors (dimension squared numbers each)."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total = {}
        for batch in batches:
            by = {}
            for v in batch.column(0).to_numpy(zero_copy_only=False):
                by.setdefault(len(v), []).append(np.asarray(v, np.float64))
            for d, vs in by.items():
                u = _unit(np.stack(vs))
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            n = d * d
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(m.ravel())], names=["d", "k", "s"])

    import numpy as np

    out: dict = {}
    for r in vectors.select("emb").mapInArrow(sums, "d int, k int, s double").groupBy("d", "k").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r["d"], np.zeros(r["d"] ** 2))[r["k"]] = r["s"]
    return {d: np.ascontiguousarray(np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]) for d, m in out.items()}


def _leaves(placed: DataFrame) -> DataFrame:
    """(label, d, cell, leaf, tiles): of every cell, its leading coordinates that bring it down to a tile.

    As many coordinates as are needed for at most ``TILE`` vectors that share them, else all; tiles
    is the number of tiles of the vectors that share them.
    """
    count = placed.groupBy("label", "d", "cell").agg(F.count("*").alias("n"))
    first = [F.slice("cell", 1, j).alias(f"c{j}") for j in range(1, AXES)]
    count = count.select("*", *first)
    for j in range(1, AXES):
        count = count.withColumn(f"n{j}", F.sum("n").over(Window.partitionBy("label", "d", f"c{j}")))
    leaf, most = F.col("cell"), F.col("n")
    for j in range(AXES - 1, 0, -1):
        few = F.col(f"n{j}") <= TILE
        leaf, most = F.when(few, F.col(f"c{j}")).otherwise(leaf), F.when(few, F.col(f"n{j}")).otherwise(most)
    return count.select("label", "d", "cell", leaf.alias("leaf"), F.ceil(most / TILE).cast("int").alias("tiles"))


def _tile_pairs(leaves: DataFrame) -> DataFrame:
    """(label, d, leaf, tile, pair, side, other) of the tiles of each pair of tiles that may hold links.

    side is 0 for a tile paired with itself, else 1 and 2; other is the other tile's leaf.
    """
    tiles = leaves.select("label", "d", "leaf", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    a = tiles.select("label", "d", F.col("leaf").alias("leaf1"), F.col("tile").alias("tile1"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.get("leaf", F.lit(0)) + x)).alias("at"))
    b = tiles.select("label", "d", F.get("leaf", F.lit(0)).alias("at"), F.col("leaf").alias("leaf2"), F.col("tile").alias("tile2"))
    pairs = a.join(b, ["label", "d", "at"]).where(F.struct("leaf1", "tile1") <= F.struct(F.col("leaf2").alias("leaf1"), F.col("tile2").alias("tile1")))
    pairs = pairs.where(F.forall(F.sequence(F.lit(0), F.least(F.size("leaf1"), F.size("leaf2")) - 1), lambda j: F.abs(F.get("leaf1", j) - F.get("leaf2", j)) <= 1))
    pairs = pairs.select("*", F.struct("label", "d", "leaf1", "tile1", "leaf2", "tile2").alias("pair"))
    same = (F.col("leaf1") == F.col("leaf2")) & (F.col("tile1") == F.col("tile2"))
    one = pairs.select("label", "d", F.col("leaf1").alias("leaf"), F.col("tile1").alias("tile"), "pair", F.when(same, 0).otherwise(1).alias("side"), F.col("leaf2").alias("other"))
    two = pairs.where(~same).select("label", "d", F.col("leaf2").alias("leaf"), F.col("tile2").alias("tile"), "pair", F.lit(2).alias("side"), F.col("leaf1").alias("other"))
    return one.union(two)


def similar_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Vectors with equal, non-null labels and equal length are linked when their cosine is at least
    ``threshold``. Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows with a null id or label link with nothing. n_links counts the other vectors linked
    directly; component_id is the smallest id reachable by links, the own id included. Equal
    vectors are compared once and counted by their number. Rows that share an id share a component.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("emb"))
    fine = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("emb", lambda x: x != 0)
    sound = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    classes = written(sound.groupBy("label", "emb").agg(F.min("id").alias("cls"), F.count("*").alias("m")), "vectors")
    axes = spark.sparkContext.broadcast(principal_axes(classes))
    width = (2 - 2 * threshold) ** 0.5 + 1e-9

    def cells(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vs = batch.column(2).to_numpy(zero_copy_only=False)
            size = np.array([len(v) for v in vs], np.int32)
            lead = np.zeros((len(vs), AXES))
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                lead[own, : min(k, AXES)] = _unit(np.stack([np.asarray(vs[i], np.float64) for i in own])) @ axes.value[k][:, :AXES]
            cell = np.floor(lead / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(list(cell), pa.list_(pa.int32())), pa.array(list(lead), pa.list_(pa.float64()))], names=["cls", "m", "emb", "label", "d", "cell", "lead"])

    kind = classes.schema["emb"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("cls", "m", "emb", "label").mapInArrow(cells, f"cls long, m long, emb {kind}, label {label}, d int, cell array<int>, lead array<double>")
    placed = written(placed, "placed")
    leaves = written(_leaves(placed), "tiles")
    placed = placed.join(leaves, ["label", "d", "cell"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    sides = _tile_pairs(leaves.drop("cell").distinct())
    near = F.aggregate(
        F.sequence(F.lit(1), F.size("other")),
        F.lit(0.0),
        lambda acc, j: acc + F.pow(F.greatest(F.get("other", j - 1) * width - F.get("lead", j - 1), F.get("lead", j - 1) - (F.get("other", j - 1) + 1) * width, F.lit(0.0)), 2),
    )
    grouped = placed.join(sides, ["label", "d", "leaf", "tile"]).where(near <= width * width + 1e-9).select("pair", "side", "cls", "m", "emb").groupBy("pair")

    def compared(table):
        import numpy as np
        import pyarrow as pa

        ids, m, s = (table.column(c).to_numpy() for c in ("cls", "m", "side"))
        x = _matrix(table.column("emb").combine_chunks())
        turned = _unit(x) @ axes.value[x.shape[1]]
        own = not s.any()
        ia = np.flatnonzero(s <= 1)
        ib = ia if own else np.flatnonzero(s == 2)
        d = x.shape[1]
        left = np.sqrt(np.maximum(0, np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]))
        left = np.concatenate([left, np.zeros((len(x), 1))], axis=1)
        stops = sorted({max(1, round(d * f)) for f in STEPS})
        links, edges_a, edges_b = np.zeros(len(x), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(ia), 256):
            ra = ia[at : at + 256]
            done = stops[0]
            part = turned[ra, :done] @ turned[ib, :done].T
            live = part + left[ra, done][:, None] * left[ib, done][None, :] >= threshold - 1e-9
            if own:
                live &= ib[None, :] > ra[:, None]
            p, q = np.nonzero(live)
            got = part[p, q]
            p, q = ra[p], ib[q]
            for stop in stops[1:]:
                for lo in range(0, len(p), 200_000):
                    hi = lo + 200_000
                    got[lo:hi] += np.einsum("ij,ij->i", turned[p[lo:hi], done:stop], turned[q[lo:hi], done:stop])
                done = stop
                keep = got + left[p, done] * left[q, done] >= threshold - 1e-9
                p, q, got = p[keep], q[keep], got[keep]
            close = np.flatnonzero(np.abs(got - threshold) < 1e-9)
            for k in close:
                u, v = x[p[k]], x[q[k]]
                got[k] = (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v))
            keep = got >= threshold
            p, q = p[keep], q[keep]
            np.add.at(links, p, m[q])
            np.add.at(links, q, m[p])
            edges_a.append(p)
            edges_b.append(q)
        p, q = np.concatenate(edges_a), np.concatenate(edges_b)
        low = np.arange(len(x))  # a forest over the group's links, so that edges stay as many as rows
        while len(p):
            least = np.minimum(low[p], low[q])
            before = low.copy()
            np.minimum.at(low, low[p], least)
            np.minimum.at(low, low[q], least)
            low = low[low]
            if (before == low).all() and (low[p] == low[q]).all():
                break
        rep = ids[low]
        hit = links > 0
        return pa.table({"id": ids[hit], "links": links[hit], "rep": rep[hit]})

    found = written(grouped.applyInArrow(compared, "id long, links long, rep long"), "vectorlinks")
    comp = components(found.select("id", "rep"), "id", "rep")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = classes.join(links, F.col("cls") == F.col("id"), "left").drop("id").join(comp, F.col("cls") == F.col("node"), "left")
    per = per.select("label", "emb", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = sound.join(per, ["label", "emb"]).select("id", "n_links", "component_id")
    rest = base.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))))
    out = out.union(rest.select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
