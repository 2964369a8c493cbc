"""Motion regions: active cells, direction signatures, ring merging, connected components, top-k, region dials."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.functions.scalar import half_even, suggest_name
from trackframe.operators import flow as fl
from trackframe.operators.series import group_stats, salted_join, top_k
from trackframe.session import checkpoint

# Fixed thresholds.
ABS_FLOOR, PEAK_FRACTION, ABS_MIN = 0.30, 0.30, 0.05
DRIFT_DOMINANCE, DRIFT_MIN = 0.8, 0.02
MIN_CELLS, MAX_REGIONS, KEEP_FRACTION = 4, 8, 0.25
# Fixed palette, in order.
REGION_COLORS = ["#ff8a4c", "#4cc9ff", "#3ddc84", "#ffd93d", "#c86bff", "#ff5c9a", "#7c6cff", "#f28b3a"]


def active_cells(features: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Cells with enough energy; none for a clip whose peak is under 0.05 or with under four such cells."""
    d = group_stats(features, by, [F.max("energy").alias("peak")], ["gy", "gx"])
    floor = F.greatest(F.least(F.lit(ABS_FLOOR), F.col("peak") * PEAK_FRACTION), F.lit(ABS_MIN))
    act = d.filter((F.col("peak") >= ABS_MIN) & (F.col("energy") >= floor))
    act = group_stats(act, by, [F.count(F.lit(1)).alias("_cells")], ["gy", "gx"])
    return act.filter(F.col("_cells") >= MIN_CELLS).drop("_cells")


def signature(features: DataFrame) -> DataFrame:
    """Adds kind (drift or osc) and bin (octant of travel, or one of four axes)."""
    drift = F.hypot("drift_x", "drift_y")
    drifting = (drift >= F.col("osc") * DRIFT_DOMINANCE) & (drift > DRIFT_MIN)
    octant = F.pmod(half_even(F.degrees(F.atan2(F.col("drift_y"), F.col("drift_x"))) / 45.0), F.lit(8))
    axis4 = F.pmod(half_even(F.pmod(F.degrees("osc_axis"), F.lit(180.0)) / 45.0), F.lit(4))
    return (features.withColumn("kind", F.when(drifting, "drift").otherwise("osc"))
            .withColumn("bin", F.when(drifting, octant).otherwise(axis4)))


def _ring_span(bits: int, size: int) -> int:
    """Steps of the smallest arc covering every set bit of a ring."""
    on = [i for i in range(size) if bits >> i & 1]
    if len(on) == 1:
        return 0
    return min((max((b - start) % size for b in on)) for start in on)


@lru_cache(maxsize=None)
def merged_bins(size: int, present: int) -> tuple[int, ...]:
    """Merge adjacent present bins of a ring, lowest bin first and its upper neighbour before its lower one.

    A union is allowed while it spans at most one step of four bins, or two steps of eight. The
    result gives, for each bin, the bit set of its group (0 where absent); it depends only on which
    bins are present, so a lookup table over all presence masks replaces the per-clip loop.
    """
    limit = 1 if size == 4 else 2
    group = [1 << i if present >> i & 1 else 0 for i in range(size)]
    for b in range(size):
        for other in ((b + 1) % size, (b - 1) % size):
            if not group[b] or not group[other] or group[b] == group[other]:
                continue
            union = group[b] | group[other]
            if _ring_span(union, size) <= limit:
                group = [union if g and union & g else g for g in group]
    return tuple(group)


def merge_lookup() -> list[tuple[int, int, int, int]]:
    """(ring size, presence mask, bin, group) for both rings: a table of fixed size."""
    rows = []
    for size in (4, 8):
        for present in range(1, 1 << size):
            group = merged_bins(size, present)
            rows += [(size, present, b, group[b]) for b in range(size) if group[b]]
    return rows


def merge_circular_bins(sig: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Adds grp, the merged group of each cell's bin."""
    spark = sig.sparkSession
    lookup = spark.createDataFrame(merge_lookup(), "_ring int, _mask long, bin long, grp long")
    ring = F.when(F.col("kind") == "drift", 8).otherwise(4)
    bit = F.pow(F.lit(2.0), F.col("bin")).cast("long")
    present = sig.groupBy(*by, "kind").agg(F.bit_or(bit).alias("_mask"))
    d = salted_join(sig, present, [*by, "kind"], ["gy", "gx"]).withColumn("_ring", ring)
    # the lookup has about a thousand rows whatever the data size, so it is always safe to broadcast
    return d.join(F.broadcast(lookup), ["_ring", "_mask", "bin"]).drop("_ring", "_mask")


#: Side of the tiles that are labelled in one go.
TILE = 256


def _row_runs(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cells sorted by row and column, each once: the run of every cell, and the pairs of runs that touch.

    A run is a stretch of neighbouring cells of one row. Two rows of m and n runs touch in m + n - 1 places
    at most, so there are fewer than two pairs a run.
    """
    fresh = np.concatenate([[True], (np.diff(y) != 0) | (np.diff(x) != 1)])
    head = np.flatnonzero(fresh)
    last = np.concatenate([head[1:], [len(y)]]) - 1
    wide = int(x.max() - x.min()) + 4
    key = lambda row, col: (row - y[0]) * wide + (col - x.min() + 1)
    row, low, high = y[head], x[head], x[last]
    start = np.searchsorted(key(row, high), key(row + 1, low - 1))
    stop = np.searchsorted(key(row, low), key(row + 1, high + 1), side="right")
    n = np.maximum(stop - start, 0)
    above = np.repeat(np.arange(len(head)), n)
    below = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.cumsum(fresh) - 1, above, below


def _label_tile(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each cell of a tile the number of the first cell of its component, in the order of rows and columns given."""
    run, above, below = _row_runs(y, x)
    parent = list(range(int(run[-1]) + 1))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in zip(above.tolist(), below.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    head = np.flatnonzero(np.diff(run, prepend=-1))
    return head[np.array([top(k) for k in range(len(parent))])[run]]


def components8(cells: DataFrame, by: Sequence[str], y: str = "gy", x: str = "gx", tile: int = TILE) -> DataFrame:
    """Label 8-connected components; `comp` is a struct (y, x), the first cell of the component by row and column.

    Tiles are labelled each on its own, over row runs that touch. What is left is the graph of tile labels
    that meet across a border, with a few nodes a tile: its rounds take the smallest label among neighbours,
    then that label's own, so long shapes settle in a logarithmic number of rounds. Lineage is cut every
    round; images that fit a tile have no border and no round.
    """
    by = list(by)
    kept = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in by)
    cy, cx = F.col(y).cast("long"), F.col(x).cast("long")
    at = lambda c: F.floor(c / tile).cast("long")
    places = cells.select(*by, cy.alias("_y"), cx.alias("_x"), at(cy).alias("_ty"), at(cx).alias("_tx"))

    def label(t: pa.Table) -> pa.Table:
        r, c = t["_y"].to_numpy(), t["_x"].to_numpy()
        cell = np.unique(np.stack([r, c], 1), axis=0)
        first = cell[_label_tile(cell[:, 0], cell[:, 1])]
        same = {k: pa.repeat(t[k][0], len(cell)) for k in by}
        return pa.table({**same, "_y": cell[:, 0], "_x": cell[:, 1], "_ly": first[:, 0], "_lx": first[:, 1]})

    own = F.struct(F.col("_ly").alias("y"), F.col("_lx").alias("x"))
    local = checkpoint(places.groupBy(*by, "_ty", "_tx").applyInArrow(label, f"{kept}_y long, _x long, _ly long, _lx long").select(*by, "_y", "_x", own.alias("v")))
    edge = F.pmod("_y", F.lit(tile)).isin(0, tile - 1) | F.pmod("_x", F.lit(tile)).isin(0, tile - 1)
    rim = local.filter(edge)
    step = [F.struct((F.col("_y") + dy).alias("_y"), (F.col("_x") + dx).alias("_x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    sent = rim.withColumn("_ty", at(F.col("_y"))).withColumn("_tx", at(F.col("_x"))).withColumn("_s", F.explode(F.array(*step)))
    sent = sent.filter((at(F.col("_s._y")) != F.col("_ty")) | (at(F.col("_s._x")) != F.col("_tx"))).select(*by, "_s.*", "v")
    edges = checkpoint(sent.join(rim.withColumnRenamed("v", "w"), [*by, "_y", "_x"]).select(*by, "v", "w").distinct())
    if edges.isEmpty():
        ids = local.select(*by, "_y", "_x", F.col("v").alias("comp"))
    else:
        names = _settled(edges, by)
        ids = local.join(names, [*by, "v"], "left").select(*by, "_y", "_x", F.coalesce("l", "v").alias("comp"))
    ids = ids.select(*by, F.col("_y").alias(y), F.col("_x").alias(x), "comp")
    return cells.join(ids, by + [y, x])


def _settled(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, v, l): the smallest node reachable from every node of the links (by, v, w), which go both ways."""
    label = edges.select(*by, "v", F.col("v").alias("l")).distinct()
    while True:
        near = edges.join(label.select(*by, F.col("v").alias("w"), F.col("l").alias("lw")), [*by, "w"])
        near = near.groupBy(*by, "v").agg(F.min("lw").alias("m"))
        low = checkpoint(label.join(near, [*by, "v"], "left").select(*by, "v", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l")))
        jump = low.select(*by, F.col("v").alias("l"), F.col("l").alias("l2"))
        nxt = checkpoint(low.join(jump, [*by, "l"], "left").select(*by, "v", F.least("l", F.coalesce("l2", "l")).alias("l"), "old"))
        label = nxt.select(*by, "v", "l")
        if nxt.filter(F.col("l") != F.col("old")).isEmpty():
            return label


def largest_component(mask: DataFrame, by: Sequence[str] = ("clip",), y: str = "y", x: str = "x") -> DataFrame:
    """Keep each group's biggest 8-connected blob; the one found first (top-left) on ties."""
    by = list(by)
    c = components8(mask, by, y, x)
    size = c.groupBy(*by, "comp").agg(F.count(F.lit(1)).alias("_n"))
    best = size.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("neg"), "comp")).alias("_b"))
    keep = best.select(*by, F.col("_b.comp").alias("comp"))
    return c.join(keep, by + ["comp"], "left_semi").drop("comp")


def region_bbox(cells: DataFrame, by: Sequence[str], grid: Column) -> DataFrame:
    """Normalized box of a cell set."""
    return cells.groupBy(*by).agg(
        (F.min("gx") / F.max(grid)).alias("x0"), (F.min("gy") / F.max(grid)).alias("y0"),
        ((F.max("gx") + 1) / F.max(grid)).alias("x1"), ((F.max("gy") + 1) / F.max(grid)).alias("y1"))


def top_regions(regions: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Regions of at least four cells, the strongest plus those with a quarter of its energy, at most eight.

    Needs cells, energy and, for ties, kind and comp. Adds region (0 is the strongest). Ranked in salted
    parts first, so no clip's regions meet in one task beyond a few of each part.
    """
    by = list(by)
    big = regions.filter(F.col("cells") >= MIN_CELLS)
    order = [F.desc("energy"), F.when(F.col("kind") == "drift", 0).otherwise(1), F.col("comp")]
    top = top_k(big, by, order, MAX_REGIONS, "region").withColumn("region", F.col("region") - 1)
    d = top.withColumn("_top", F.max("energy").over(W.partitionBy(*by)))
    return d.filter((F.col("region") == 0) | (F.col("energy") >= F.col("_top") * KEEP_FRACTION)).drop("_top")


def candidate_regions(cells: DataFrame, by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(ranked regions, their member cells) from a cell table, before the static gate."""
    by = list(by)
    sig = checkpoint(merge_circular_bins(signature(active_cells(fl.cell_features(cells, by), by)), by))
    comp = checkpoint(components8(sig, by + ["kind", "grp"]))
    reg = comp.groupBy(*by, "kind", "grp", "comp").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("energy").alias("energy"), F.max("energy").alias("peak_cell"),
        F.avg("drift_x").alias("mean_dx"), F.avg("drift_y").alias("mean_dy"),
        F.min("gx").alias("gx0"), F.min("gy").alias("gy0"), (F.max("gx") + 1).alias("gx1"), (F.max("gy") + 1).alias("gy1"))
    top = checkpoint(top_regions(reg, by))
    members = comp.join(top.select(*by, "kind", "grp", "comp", "region"), by + ["kind", "grp", "comp"]).select(*by, "region", "gy", "gx")
    return top, members


def build_regions(flow: DataFrame, regions: DataFrame, members: DataFrame, clips: DataFrame,
                  by: Sequence[str] = ("clip",), px: Sequence[str] = ("gy", "gx")) -> DataFrame:
    """Dials, box, name and colour of each region. The width that scales them is the region's own crop width."""
    by = list(by)
    key = by + ["region"]
    cell_w = F.floor(F.col("width") / F.col("grid"))
    meta = (regions.join(clips.select(*by, "fps", F.col("width").alias("width"), "grid"), by)
            .withColumn("crop_w", ((F.col("gx1") - F.col("gx0")) * cell_w).cast("double"))
            .withColumn("floor", F.least(F.lit(fl.NOISE_FLOOR), F.greatest(F.lit(0.12), F.col("peak_cell") * 0.6))))
    own = flow.join(members, by + ["gy", "gx"])
    dials = fl.distill(own, meta.select(*key, "fps", F.col("crop_w").alias("width"), "floor"), key, px)
    colors = F.array(*[F.lit(c) for c in REGION_COLORS])
    d = dials.join(meta, key)
    name = suggest_name(F.col("kind"), {c: F.col(c) for c in fl.DIALS}, F.col("mean_dx"), F.col("mean_dy"))
    g = F.col("grid")
    return d.select(*key, "kind", "cells", *fl.DIALS, (F.col("gx0") / g).alias("x0"), (F.col("gy0") / g).alias("y0"),
                    (F.col("gx1") / g).alias("x1"), (F.col("gy1") / g).alias("y1"),
                    (F.coalesce(F.col("name"), name) if "name" in regions.columns else name).alias("suggested_name"),
                    F.get(colors, F.pmod(F.col("region"), F.lit(len(REGION_COLORS)))).alias("color"))


def segment_regions(flow: DataFrame, cells: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",),
                    px: Sequence[str] = ("gy", "gx"), files: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """The distinct motions of each clip. Static clips give no rows.

    `flow` carries gy, gx next to its pixel columns. With `files` (by, filename) and `profiles`
    (key, idx, name, kind, gy0, gx0, gy1, gx1; null box = every active cell) a clip whose name
    matches a profile uses its layout, and falls through to the automatic path if that gives nothing.
    """
    by = list(by)
    still = fl.persistence(flow, by, px).filter(F.col("persistence") >= fl.STATIC_PERSISTENCE)
    auto_cells = cells.join(still, by, "left_anti")
    curated = None
    if files is not None and profiles is not None:
        top, members = profile_regions(cells, clips, profile_match(files, profiles), profiles, by)
        curated = build_regions(flow, top, members, clips, by, px)
        curated = checkpoint(curated)
        auto_cells = auto_cells.join(curated.select(*by).distinct(), by, "left_anti")
    top, members = candidate_regions(auto_cells, by)
    auto = build_regions(flow, top, members, clips, by, px)
    return auto if curated is None else curated.unionByName(auto)


def profile_match(files: DataFrame, profiles: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """The longest profile key contained in each lower-cased file name.

    Every substring whose length is some key's length is looked up by equality, so the contains
    test needs no pairwise comparison. Key lengths are few (at most a file name's length). The keys, one a
    curated layout, go to every task: the planner can't see how many substrings a name makes and would
    send those instead.
    """
    keys = profiles.select("key").distinct().withColumn("len", F.length("key"))
    lengths = [r.len for r in keys.select("len").distinct().collect()]
    low = files.select(*by, F.lower("filename").alias("_fn"))
    starts = lambda n: F.when(F.length("_fn") >= n, F.transform(F.sequence(F.lit(1), F.length("_fn") - n + 1), lambda i: F.substring(F.col("_fn"), i, F.lit(n))))
    subs = F.array_compact(F.array_distinct(F.flatten(F.array_compact(F.array(*[starts(n) for n in lengths])))))
    hit = low.withColumn("key", F.explode(subs)).join(F.broadcast(keys), "key")
    best = hit.groupBy(*by).agg(F.max(F.struct("len", "key")).alias("_b"))
    return best.select(*by, F.col("_b.key").alias("key"))


def profile_regions(cells: DataFrame, clips: DataFrame, matched: DataFrame, profiles: DataFrame,
                    by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(regions, members) of clips with a matched profile. A null box means every active cell."""
    by = list(by)
    feat = fl.cell_features(cells.join(matched, by, "left_semi"), by)
    feat = group_stats(feat, by, [F.max("energy").alias("peak")], ["gy", "gx"]).filter(F.col("peak") >= ABS_MIN)
    floor = F.greatest(F.least(F.lit(ABS_FLOOR), F.col("peak") * PEAK_FRACTION), F.lit(ABS_MIN))
    feat = feat.withColumn("_act", F.col("energy") >= floor)
    feat = group_stats(feat, by, [F.bool_or("_act").alias("_any")], ["gy", "gx"])
    full = F.when(F.col("_any"), F.col("_act")).otherwise(F.col("energy") >= F.col("peak") * 0.5)
    spec = salted_join(feat, matched, by, ["gy", "gx"]).join(profiles, "key")
    inside = F.col("gy").between(F.col("gy0"), F.col("gy1")) & F.col("gx").between(F.col("gx0"), F.col("gx1"))
    m = spec.filter(F.when(F.col("gy0").isNull(), full).otherwise(inside)).withColumn("region", F.col("idx").cast("long"))
    reg = m.groupBy(*by, "region").agg(
        F.max("kind").alias("kind"), F.max("name").alias("name"), F.count(F.lit(1)).alias("cells"), F.max("energy").alias("peak_cell"),
        F.avg("drift_x").alias("mean_dx"), F.avg("drift_y").alias("mean_dy"),
        F.min("gx").alias("gx0"), F.min("gy").alias("gy0"), (F.max("gx") + 1).alias("gx1"), (F.max("gy") + 1).alias("gy1"))
    return reg, m.select(*by, "region", "gy", "gx")
