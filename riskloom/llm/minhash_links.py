"""Links between sets with a high Jaccard similarity, by MinHash bands, signatures and full sets.

Sets are rows keyed by a 16-byte digest of their content, so equal sets are one row. A band that many sets share is
not expanded into all pairs: in each round every band compares its members with one pivot, and only members that no
link connects with the pivot yet. Bands that still hold several components after the pivot rounds are settled exactly, in
tiles of what each set has beside, and lacks of, the band's pivot.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_table, ragged, runs_of
from .shared import materialise_few as materialise
from .textkernel import mix


@dataclass(frozen=True)
class NearRule:
    """words: of a shingle. percent: least 100 * intersection / union. Bands of rows minima; pivots: rounds before the exact rest."""

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 5
    pivots: int = 1
    seed: int = 7

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        k = self.bands * self.rows
        return (r.integers(0, 1 << 31, k) * 2 + 1).astype(np.uint32), r.integers(0, 1 << 32, k).astype(np.uint32)


def signature(found: np.ndarray, rule_arrays: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each universal hash over a set of 64-bit shingles."""
    a, b = rule_arrays
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        h = a[:, None] * x[None, at : at + 4096]
        h += b[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def band_keys(signatures: np.ndarray, rule: NearRule) -> np.ndarray:
    """One 64-bit key of each band of each signature; the band's number is part of it."""
    parts = signatures.reshape(-1, rule.bands, rule.rows).astype(np.uint64)
    h = np.broadcast_to(mix(np.arange(rule.bands, dtype=np.uint64) + np.uint64(rule.seed)), parts.shape[:2]).copy()
    for i in range(rule.rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h.view(np.int64)


def low_bytes(signatures: np.ndarray) -> np.ndarray:
    """The lowest byte of each minimum: equal minima stay equal, one in 256 unlike ones becomes equal."""
    return signatures.astype(np.uint8)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def set_columns(sets: list[np.ndarray], rule: NearRule, with_bands: bool) -> dict[str, pa.Array]:
    """n, key, and signature and bands (or the sets themselves) of each set; key and signature are null for empty sets."""
    n = np.array([len(s) for s in sets], np.int32)
    out: dict[str, pa.Array] = {"n": pa.array(n), "key": pa.array([digest(s) if len(s) else None for s in sets], pa.binary())}
    arrays = rule.multipliers()
    if with_bands:
        sig = np.array([signature(s, arrays) for s in sets], np.uint32).reshape(len(sets), -1)
        keys = band_keys(sig, rule)
        keep = np.where(n > 0, rule.bands, 0)
        out["bands"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(keys[n > 0].ravel()))
    else:
        out["sig"] = pa.array([low_bytes(signature(s, arrays)).tobytes() for s in sets], pa.binary())
        out["shingles"] = pa.array([s.tobytes() for s in sets], pa.binary())
    return out


def _least_alike(rule: NearRule) -> float:
    """Share of equal minima below which a pair isn't similar enough, but for a chance of five standard deviations."""
    share = rule.percent / 100
    return share - 5 * (share * (1 - share) / (rule.bands * rule.rows)) ** 0.5


def _signature_check(rule: NearRule):
    least = _least_alike(rule)

    def run(batches):
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
                batch = batch.filter(pa.array((a == b).mean(axis=1) >= least))
            yield batch.select(["a", "b"])

    return run


#: Values of pairs of sets that are compared at once, and those of a pair from which on it is compared for itself.
COMPARED, LONG_PAIR = 1 << 18, 512


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> np.ndarray:
    """How many values the sets i of x and of y have in common, for each i from lo to hi; fewer than 2^20. No set holds a value twice."""
    values = np.concatenate([v[at[lo] : at[hi]] for v, at in (x, y)])
    if not len(values):
        return np.zeros(hi - lo, np.int64)
    own = np.concatenate([np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(at[lo : hi + 1])) for _, at in (x, y)])
    if values.max() >= np.uint64(1 << 44):
        values = np.unique(values, return_inverse=True)[1].astype(np.uint64)
    both = np.sort((own << np.uint64(44)) | values)
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(44)).astype(np.int64), minlength=hi - lo)


def _set_check(rule: NearRule):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = (_values(batch.column(c)) for c in ("set_a", "set_b"))
            size = np.diff(x[1]) + np.diff(y[1])
            common, ends, at = np.zeros(len(batch), np.int64), np.cumsum(size), 0
            while at < len(batch):
                if size[at] >= LONG_PAIR:
                    merged = np.sort(np.concatenate([v[own[at] : own[at + 1]] for v, own in (x, y)]), kind="stable")
                    common[at] = (merged[1:] == merged[:-1]).sum()
                    at += 1
                    continue
                long = np.flatnonzero(size[at : at + COMPARED] >= LONG_PAIR)
                stop = min(int(np.searchsorted(ends, ends[at] - size[at] + COMPARED, side="right")), at + int(long[0]) if len(long) else at + COMPARED, len(batch))
                common[at:stop] = _common(x, y, at, stop)
                at = stop
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= rule.percent * (size - common)))

    return run


def _sized(rule: NearRule, one, other):
    """Whether sets of these sizes can be similar enough."""
    return F.least(one, other) * 100 >= F.greatest(one, other) * rule.percent


def near_groups(sets: DataFrame, fetch: Callable[[DataFrame], DataFrame], rule: NearRule, fetched: Callable[[], None] | None = None) -> DataFrame:
    """(key, component) of the keys of sets(key, n, bands) that have a similar enough partner; component is one key of the group.

    fetch(keys) gives (key, sig, shingles) of the asked keys; fetched is called when they are written. A link counts only after the comparison of full sets.
    Every two sets that share a band and are similar enough are linked directly or through other links.
    """
    spark = sets.sparkSession
    members = sets.select("key", "n", F.explode("bands").alias("band"))
    shared = materialise(members.groupBy("band").count().where("count > 1").select("band"), "bands")
    members = materialise(members.join(shared, "band"), "members")
    drop_table(shared)
    full = materialise(fetch(members.select("key").distinct()).dropDuplicates(["key"]), "sets", "zstd")
    if fetched:
        fetched()
    schema = "a binary, b binary"
    tested, links = [], spark.createDataFrame([], schema)

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tested.append(pairs)
        likely = pairs
        if _least_alike(rule) * rule.bands > 1:  # else every pair that shares a band passes
            sig = pairs.join(full.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a").join(full.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b")
            likely = sig.select("a", "b", "sig_a", "sig_b").mapInArrow(_signature_check(rule), schema)
        whole = likely.join(full.select(F.col("key").alias("a"), F.col("shingles").alias("set_a")), "a").join(full.select(F.col("key").alias("b"), F.col("shingles").alias("set_b")), "b")
        return materialise(whole.select("a", "b", "set_a", "set_b").mapInArrow(_set_check(rule), schema), "links")

    def open_bands(now: DataFrame, turn: int) -> DataFrame:
        """Bands that hold several components, each with its pivot: the member with the most links, or at first any."""
        order = F.struct((-F.col("degree")).alias("d"), F.xxhash64("key", F.lit(turn) if turn else "band").alias("h"), "key", "n", "c")
        rows = now.groupBy("band").agg(F.min(order).alias("p"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        rows = rows.where("size > 2") if turn else rows
        return materialise(rows.select("band", "p.key", "p.n", "p.c").toDF("band", "pivot", "pivot_n", "pivot_c"), "open")

    def labelled(of: DataFrame) -> DataFrame:
        rows = members.join(of, "key", "left").select("band", "key", "n", F.coalesce("label", "key").alias("c"), F.coalesce("degree", F.lit(0)).alias("degree"))
        return materialise(rows, "state")

    for turn in range(rule.pivots):
        now = labelled(_labels(links)) if turn else members.select("band", "key", "n", F.col("key").alias("c"), F.lit(0).cast("bigint").alias("degree"))
        met = now.join(open_bands(now, turn), "band").where(F.col("c") != F.col("pivot_c")).where(_sized(rule, F.col("n"), F.col("pivot_n")))
        links = links.unionByName(confirm(met.select(F.col("key").alias("x"), F.col("pivot").alias("y"))))
    groups = _groups(links)
    now = labelled(groups)
    rest = open_bands(now, rule.pivots)
    if not rest.isEmpty():
        star = now.join(rest, "band").select("key", "c", "pivot", "pivot_c").distinct()
        more = _left_links(star, full, rule)
        name = groups.select("key", "label")
        ends = more.join(name.toDF("a", "x"), "a", "left").join(name.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        joined = components(ends.where("a <> b"))
        every = groups.select("key", "label").unionByName(more.select(F.col("a").alias("key"), F.col("a").alias("label"))).unionByName(more.select(F.col("b").alias("key"), F.col("b").alias("label")))
        every = every.join(groups.select("key", F.col("label").alias("known")), "key", "left").select("key", F.coalesce("known", "label").alias("label")).distinct()
        out = every.join(joined.toDF("label", "joined"), "label", "left").select("key", F.coalesce("joined", "label").alias("component"))
    else:
        out = groups.select("key", F.col("label").alias("component"))
    out = materialise(out, "groups")
    for t in (members, full, *tested):
        drop_table(t)
    return out


def _labels(links: DataFrame) -> DataFrame:
    """(key, label, degree): the set of the highest degree among a set and those it is linked with. Sets with one label are connected."""
    ends = links.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("other")))
    degree = materialise(ends.groupBy("key").count().withColumnRenamed("count", "degree"), "degree")
    around = ends.join(degree.select(F.col("key").alias("other"), "degree"), "other").select("key", "other", "degree")
    around = around.unionByName(degree.select("key", F.col("key").alias("other"), "degree"))
    best = around.groupBy("key").agg(F.min_by("other", F.struct(-F.col("degree"), "other")).alias("label"), F.max(F.when(F.col("key") == F.col("other"), F.col("degree"))).alias("degree"))
    return materialise(best, "labels")


def _groups(links: DataFrame) -> DataFrame:
    """(key, label, degree) with one label for each connected component: components of the labels that links join."""
    of = _labels(links)
    name = of.select("key", "label")
    across = links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    joined = components(across)
    return materialise(of.join(joined.toDF("label", "component"), "label", "left").select("key", F.coalesce("component", "label").alias("label"), "degree"), "named")


def _differences(x: pa.Buffer, p: pa.Buffer) -> tuple[bytes, bytes]:
    """The values of x that p lacks, and those of p that x lacks."""
    if x.size + p.size < 4096:
        a, b = set(memoryview(x).cast("B").cast("Q")), set(memoryview(p).cast("B").cast("Q"))
        return array("Q", a - b).tobytes(), array("Q", b - a).tobytes()
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64)
    return np.setdiff1d(a, b, assume_unique=True).tobytes(), np.setdiff1d(b, a, assume_unique=True).tobytes()


def _beside_pivot(batches):
    """Of each set and its pivot: the pivot's size, the set's shingles that it lacks, and its shingles that the set lacks."""
    for batch in batches:
        rows: dict[str, list] = {"size": [], "new": [], "gone": []}
        for x, p in zip(batch.column("set_x"), batch.column("set_p"), strict=True):
            new, gone = _differences(x.as_buffer(), p.as_buffer())
            rows["size"].append(p.as_buffer().size // 8)
            rows["new"].append(new)
            rows["gone"].append(gone)
        out = {k: batch.column(k) for k in ("key", "c", "pivot", "pivot_c")}
        yield pa.RecordBatch.from_pydict(out | {"size": pa.array(rows["size"], pa.int32()), "new": pa.array(rows["new"], pa.binary()), "gone": pa.array(rows["gone"], pa.binary())})


#: Sets of a tile's side, on average.
TILE = 256


#: Equal values of pairs that are counted at once, so that memory is bounded whatever sets have in common.
AT_ONCE = 1 << 20


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each array of x has in common with each of y; no array holds a value twice."""
    owner = [np.repeat(np.arange(len(v)), [len(w) for w in v]) for v in (x, y)]
    flat = [np.concatenate(v) for v in (x, y)]
    order = np.argsort(flat[1], kind="stable")
    lo, hi = (np.searchsorted(flat[1][order], flat[0], side=s) for s in ("left", "right"))
    met = np.flatnonzero(hi > lo)
    lo, n, left, right = lo[met], (hi - lo)[met], owner[0][met] * len(y), owner[1][order]
    out, ends, at = np.zeros(len(x) * len(y), np.int64), np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        out += np.bincount(np.repeat(left[at:stop], n[at:stop]) + right[ragged(lo[at:stop], n[at:stop])], minlength=len(out))
        at = stop
    return out.reshape(len(x), len(y))


def _forest(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the edges (one, other) suffice to connect all that they connect: fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([one, other]), return_inverse=True)
    u, v = at.reshape(2, -1)
    root, taken = np.arange(len(nodes)), [np.zeros(0, np.int64)]
    while len(across := np.flatnonzero(root[u] != root[v])):
        low, high = np.minimum(root[u[across]], root[v[across]]), np.maximum(root[u[across]], root[v[across]])
        hooked, first = np.unique(high, return_index=True)
        taken.append(across[first])
        root[hooked] = low[first]
        while (root[root] != root).any():
            root = root[root]
    return np.concatenate(taken)


def _values(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, at): the 64-bit values of all rows of a binary column, row i's at values[at[i]:at[i+1]]."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(at[-1] - at[0])
    return np.frombuffer(column.buffers()[2], np.uint64, size // 8, int(at[0])) if size else np.zeros(0, np.uint64), (at - at[0]) // 8


def _tile_links(rule: NearRule):
    """Links (a, b) of each tile between sets x outside the pivot's component and sets y: a forest of the components that meet."""

    def tile_links(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        side = tile.column("side").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return none, none
        new, gone, (c, c_at) = (_values(tile.column(k)) for k in ("new", "gone", "c"))
        c, size = c[c_at[:-1]], tile.column("size")[0].as_py()
        more, lost = np.diff(new[1]), np.diff(gone[1])
        sizes = (size - lost[x] + more[x])[:, None] + (size - lost[y] + more[y])[None, :]
        similar = lambda common: (100 + rule.percent) * common >= rule.percent * sizes
        apart = c[x][:, None] != c[y][None, :]
        most = size - np.maximum(lost[x][:, None], lost[y][None, :]) + np.minimum(more[x][:, None], more[y][None, :])
        if not (apart & similar(most)).any():
            return none, none
        pick = lambda part, rows: [part[0][part[1][k] : part[1][k + 1]] for k in rows]
        common = size - lost[x][:, None] - lost[y][None, :] + _shared(pick(gone, x), pick(gone, y)) + _shared(pick(new, x), pick(new, y))
        i, j = np.nonzero(apart & similar(common))
        taken = _forest(c[x[i]], c[y[j]])
        return x[i[taken]], y[j[taken]]

    def run(batches):
        for tile in runs_of(batches, ["pivot", "i", "j"]):
            i, j = tile_links(tile)
            if len(i):
                key = tile.column("key").combine_chunks()
                yield pa.RecordBatch.from_pydict({"a": key.take(pa.array(i)), "b": key.take(pa.array(j))})

    return run


def _left_links(star: DataFrame, full: DataFrame, rule: NearRule) -> DataFrame:
    """Links (a, b) between similar sets of different components that share a pivot, from star(key, c, pivot, pivot_c).

    Beside a pivot p a set is what it has new and what of p is gone from it, both short, and
    |x & y| = |p| - |p-x| - |p-y| + |(p-x) & (p-y)| + |(x-p) & (y-p)|, so the comparison is one of full sets. Each pair
    has a set outside the pivot's component; all others that share p are in one component already. The sets outside
    meet the sets of the pivot in tiles of bounded size, and a tile returns fewer links than it has sets.
    """
    beside = star.join(full.select("key", F.col("shingles").alias("set_x")), "key").join(full.select(F.col("key").alias("pivot"), F.col("shingles").alias("set_p")), "pivot")
    beside = materialise(beside.mapInArrow(_beside_pivot, "key binary, c binary, pivot binary, pivot_c binary, size int, new binary, gone binary"), "beside")
    numbers = beside.groupBy("pivot").agg(F.count("*").alias("all"), F.count_if(F.col("c") != F.col("pivot_c")).alias("outside"))
    numbers = materialise(numbers.where("outside > 0").select("pivot", F.ceil(F.col("all") / TILE).alias("all_blocks"), F.ceil(F.col("outside") / TILE).alias("blocks")), "blocks")
    rows = beside.join(numbers, "pivot")
    own = F.xxhash64("key", F.lit(5))
    x = rows.where("c <> pivot_c").withColumns({"i": F.pmod(own, "blocks"), "j": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all_blocks") - 1)), "side": F.lit(0)})
    y = rows.withColumns({"i": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)), "j": F.pmod(own, "all_blocks"), "side": F.lit(1)})
    columns = ["pivot", "i", "j", "side", "key", "c", "size", "new", "gone"]
    tiles = x.select(*columns).unionByName(y.select(*columns)).repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    tiles = tiles.mapInArrow(_tile_links(rule), "a binary, b binary")
    links = materialise(tiles.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    for t in (beside, numbers):
        drop_table(t)
    return links
