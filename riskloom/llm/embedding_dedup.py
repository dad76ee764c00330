"""Near copies of vectors: int8 tile products with error bounds, and double precision where the bound leaves a doubt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .components import components
from .shared import materialise

#: Distinct vectors of a tile's side, on average.
SIDE = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, norm of the coded vector, norm of what the code leaves out) of unit vectors."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1)


def possible_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where unit vectors may have a product of at least `least`; none that has it is left out.

    x.y = (p + e).(q + f) for coded p, q and rests e, f, so |x.y - p.q| <= |p||f| + |e||q| + |e||f|. Products of int8
    codes are whole numbers below 2**24 for up to 1040 dimensions and so exact in float32; longer vectors use float64.
    """
    (ca, sa, pa_, ea), (cb, sb, pb, eb) = quantise(a), quantise(b)
    wide = np.float32 if a.shape[1] <= 1040 else np.float64
    product = (ca.astype(wide) @ cb.astype(wide).T).astype(np.float64)
    product *= sa[:, None]
    product *= sb[None, :]
    product += pa_[:, None] * eb[None, :]
    product += ea[:, None] * (pb + eb)[None, :]
    return np.nonzero(product >= least - 1e-9)


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of pairs that connect all that the pairs connect: at most one fewer than the nodes."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            above[x] = y
            out.append(k)
    return out


def _tile(least: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("node", kind="stable")
        width = len(tile["embedding"].iloc[0])
        x = np.stack(tile["embedding"].to_numpy()).astype(np.float64).reshape(len(tile), width)
        size = np.abs(x).max(axis=1)
        x /= size[:, None]
        norm = np.linalg.norm(x, axis=1)
        unit = x / norm[:, None]
        node, copies, side = (tile[c].to_numpy() for c in ("node", "copies", "side"))
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if tile["low"].iloc[0] == tile["high"].iloc[0]:
            other = one
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(one), 256):
            rows = one[at : at + 256]
            i, j = possible_pairs(unit[rows], unit[other], least) if len(other) else (np.zeros(0, int), np.zeros(0, int))
            i, j = rows[i], other[j]
            if other is one:
                i, j = i[i < j], j[i < j]
            cosine = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) / (norm[i] * norm[j])
            found_i.append(i[cosine >= least])
            found_j.append(j[cosine >= least])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        links = np.zeros(len(tile), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        tree = _forest(i, j)
        linked = np.flatnonzero(links)
        return pd.DataFrame({
            "node": np.concatenate([node[linked], node[i[tree]]]),
            "other": np.concatenate([node[linked], node[j[tree]]]),
            "links": np.concatenate([links[linked], np.zeros(len(tree), np.int64)]),
        })

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, side: int = SIDE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least `least`. Vectors that are null, empty, zero or hold a null or non-finite component, and
    rows with a null vec_id, are linked with nothing; rows of a label whose vectors differ in length are compared
    within each length. n_links counts the other rows linked directly, component_id is the smallest vec_id reachable,
    kept says that it is the row's own. Equal vectors of a label are one node with a number of copies; repeated rows
    count as copies of each other. Further columns are ignored; an empty table gives an empty result.

    The nodes of a label are dealt into blocks of about `side`, whose number follows the label's size; every two
    blocks meet in a tile of bounded size. A tile returns link counts by node and a forest of its links, never all pairs.
    """
    ship(vectors.sparkSession)
    own = vectors.select("vec_id", "embedding", "label")
    number = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(number, lambda v: v != 0)
    good = own.where(fine & F.coalesce(finite, F.lit(False)))
    good = good.select("vec_id", "label", F.transform("embedding", lambda v: F.when(v == 0, F.lit(0)).otherwise(v).cast("double")).alias("embedding"))
    good = good.withColumn("key", F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    nodes = good.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = materialise(nodes.withColumn("width", F.size("embedding")), "vectors")
    blocks = materialise(nodes.groupBy("label", "width").agg(F.ceil(F.count("*") / side).cast("int").alias("blocks")), "blocks")
    placed = nodes.join(blocks, ["label", "width"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    met = placed.select("label", "width", "block", "node", "copies", "embedding", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    met = met.select("label", "width", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), F.when(F.col("block") <= F.col("with"), 0).otherwise(1).alias("side"), "node", "copies", "embedding")
    kind = nodes.schema["node"].dataType.simpleString()
    tiles = materialise(met.groupBy("label", "width", "low", "high").applyInPandas(_tile(least), f"node {kind}, other {kind}, links bigint"), "tiles")
    counts = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(tiles.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_node = nodes.select("key", "node", "copies").join(counts, "node", "left").join(groups, "node", "left")
    of_node = materialise(of_node.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "nodes")
    linked = good.select("vec_id", "key").join(of_node, "key").select("vec_id", "n_links", "component_id")
    alone = own.where(~(fine & F.coalesce(finite, F.lit(False)))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
