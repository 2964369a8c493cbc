"""Pixel masks, camera motion and depth: gates, morphology, run-length codes, transforms, summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.functions.scalar import fixed
from trackframe.operators.regions import largest_component
from trackframe.operators.series import BLOCK, blocks, neighbours, prefix_sums, quantiles, salted_join
from trackframe.session import checkpoint

# Fixed thresholds.
MOTION_FLOOR, MOTION_QUANTILE, SEG_FLOOR, STATIC_PX, DRIFT_CAP = 0.6, 0.70, 0.01, 3.0, 0.25
# Fixed 5 x 5 elliptic kernel: (dy, dx) of its 17 set pixels. Row half-widths are 0, 2, 2, 2, 0.
ELLIPSE = [(dy, dx) for dy, reach in ((-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) for dx in range(-reach, reach + 1)]


def motion_energy(residual: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Strongest residual speed of each pixel over all frames."""
    return residual.groupBy(*by, "y", "x").agg(F.max(F.hypot("vx", "vy")).alias("energy"))


def motion_gate(energy: DataFrame, boxes: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Pixels inside the box (x0, y0, x1, y1, stops exclusive) above max(0.6, 70th percentile of the box)."""
    by = list(by)
    d = salted_join(energy, boxes.select(*by, "x0", "y0", "x1", "y1"), by, ["y", "x"])
    d = checkpoint(d.filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))).select(*by, "y", "x", "energy"))
    q = quantiles(d, by, {"q": "energy"}, MOTION_QUANTILE)
    return salted_join(d, q, by, ["y", "x"]).filter(F.col("energy") > F.greatest(F.lit(MOTION_FLOOR), F.col("q"))).select(*by, "y", "x")


def intersect(a: DataFrame, b: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Pixels in both masks."""
    return a.select(*by, "y", "x").distinct().join(b.select(*by, "y", "x").distinct(), [*by, "y", "x"], "left_semi")


def _spread(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ELLIPSE]))
    return mask.select(*by, "y", "x", "h", "w", moves.alias("m")).select(*by, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "h", "w")


def _inside(d: DataFrame) -> DataFrame:
    return d.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w")))


def dilate(mask: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """A pixel is set when any pixel under the kernel is; `mask` carries the image size h, w."""
    return _inside(_spread(mask, by)).distinct()


def erode(mask: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """A pixel stays when every kernel pixel inside the image is set; the border never erodes."""
    hits = _inside(_spread(mask, by)).groupBy(*by, "y", "x", "h", "w").agg(F.count(F.lit(1)).alias("_n"))
    inside = sum(((F.col("y") + dy >= 0) & (F.col("y") + dy < F.col("h")) & (F.col("x") + dx >= 0) & (F.col("x") + dx < F.col("w"))).cast("int") for dy, dx in ELLIPSE)
    return hits.filter(F.col("_n") == inside).drop("_n")


def open_close(mask: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Opening, then closing."""
    return erode(dilate(dilate(erode(mask, by), by), by), by)


def finish_mask(segment: DataFrame, gate: DataFrame, sizes: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Segment and motion gate together, cleaned, largest blob only. `sizes` has h, w."""
    both = intersect(segment, gate, by)
    sized = salted_join(both, sizes.select(*by, "h", "w"), by, ["y", "x"])
    clean = checkpoint(open_close(sized, by))
    return largest_component(clean.select(*by, "y", "x"), by)


def pick_mask(candidates: DataFrame, boxes: DataFrame, by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(mask, choice). Candidates (by, rank, method, y, x): the first one with max(16, 1 % of the box) pixels, else the
    largest; with no pixel at all the whole box. `boxes` has x0, y0, x1, y1."""
    by = list(by)
    px = candidates.groupBy(*by, "rank", "method").agg(F.count(F.lit(1)).alias("px"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    d = px.join(boxes.select(*by, F.greatest(F.lit(16), F.floor(area * SEG_FLOOR)).alias("least")), by)
    first = F.when((F.col("rank") == 0) & (F.col("px") >= F.col("least")), 1).otherwise(0)
    best = d.groupBy(*by).agg(F.max(F.struct(first.alias("first"), "px", (-F.col("rank")).alias("neg"), "method")).alias("_b"))
    choice = boxes.join(best, by, "left").select(*by, (-F.col("_b.neg")).alias("rank"), F.coalesce("_b.method", F.lit("bbox_empty_fallback")).alias("method"), F.coalesce("_b.px", area).alias("px"))
    kept = candidates.join(choice.select(*by, "rank"), by + ["rank"], "left_semi").select(*by, "y", "x")
    none = boxes.join(best.select(*by), by, "left_anti")
    box = none.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).select(*by, "y", "x")
    return kept.unionByName(box), choice


def mask_stats(mask: DataFrame, sizes: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Normalized box and coverage of each clip's mask; an empty mask reports the whole frame and coverage 0."""
    by = list(by)
    m = mask.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("px"))
    d = sizes.select(*by, "h", "w").join(m, by, "left")
    or_ = lambda c, e: F.coalesce(F.round(c, 4), F.lit(e))
    return d.select(*by, or_(F.col("x0") / F.col("w"), 0.0).alias("bx"), or_(F.col("y0") / F.col("h"), 0.0).alias("by_"), or_((F.col("x1") - F.col("x0") + 1) / F.col("w"), 1.0).alias("bw"),
                    or_((F.col("y1") - F.col("y0") + 1) / F.col("h"), 1.0).alias("bh"), or_(F.col("px") / (F.col("w") * F.col("h")), 0.0).alias("coverage"))


def rle_encode(mask: DataFrame, sizes: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Row-major run lengths as rows (by, k, length); run 0 counts zeros. An image without set pixels is one run of zeros.

    Runs are kept as rows: set pixels decide them, zeros are never materialized.
    """
    by = list(by)
    p = salted_join(mask.select(*by, "y", "x").distinct(), sizes.select(*by, "h", "w"), by, ["y", "x"]).withColumn("p", F.col("y").cast("long") * F.col("w") + F.col("x"))
    near = neighbours(p.select(*by, "p"), by, "p", ["p"])
    edge = near.withColumn("start", F.coalesce(F.col("prev_p") != F.col("p") - 1, F.lit(True))).withColumn("stop", F.coalesce(F.col("next_p") != F.col("p") + 1, F.lit(True)))
    ends = edge.filter("start OR stop").select(*by, "p", F.col("start").cast("double").alias("start"), "stop")
    run = prefix_sums(ends, by, "p", {"_run": "start"}).groupBy(*by, "_run").agg(F.min("p").alias("a"), (F.max("p") + 1).alias("b"))
    run = checkpoint(run.withColumn("j", F.col("_run").cast("long") - 1).drop("_run"))
    total = sizes.select(*by, (F.col("h").cast("long") * F.col("w")).alias("size"))
    before = neighbours(run, by, "j", ["b"]).select(*by, "j", "a", "b", F.coalesce("prev_b", F.lit(0).cast("long")).alias("pb"))
    body = before.select(*by, F.explode(F.array(F.struct((F.col("j") * 2).alias("k"), (F.col("a") - F.col("pb")).alias("length")), F.struct((F.col("j") * 2 + 1).alias("k"), (F.col("b") - F.col("a")).alias("length")))).alias("r")).select(*by, "r.*")
    last = run.groupBy(*by).agg(F.max("b").alias("b"), F.max("j").alias("j"))
    tail = total.join(last, by, "left").select(*by, F.coalesce(F.col("j") * 2 + 2, F.lit(0).cast("long")).alias("k"), (F.col("size") - F.coalesce("b", F.lit(0).cast("long"))).alias("length")).filter("length > 0")
    return body.unionByName(tail)


def rle_decode(runs: DataFrame, sizes: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Set pixels of run-length rows; what lies past the image is cut."""
    by = list(by)
    d = prefix_sums(runs.withColumn("_l", F.col("length").cast("double")), by, "k", {"_end": "_l"})
    d = d.filter((F.col("k") % 2 == 1) & (F.col("length") > 0)).select(*by, "k", (F.col("_end").cast("long") - F.col("length")).alias("a"), F.col("_end").cast("long").alias("b"))
    d = salted_join(d, sizes.select(*by, "h", "w"), by, ["k"])
    stop = F.least(F.col("b"), F.col("h").cast("long") * F.col("w"))
    px = d.filter(F.col("a") < stop).withColumn("p", F.explode(F.sequence(F.col("a"), stop - 1)))
    return px.select(*by, F.floor(F.col("p") / F.col("w")).alias("y"), F.pmod("p", F.col("w")).cast("long").alias("x"))


def corner_drift(m: Column, h: Column, w: Column) -> Column:
    """Mean distance that a 3 x 3 transform (array of 9) moves the four image corners."""
    e = [F.get(m, F.lit(i)) for i in range(9)]
    zero = F.lit(0.0)

    def moved(x: Column, y: Column) -> Column:
        den = e[6] * x + e[7] * y + e[8]
        return F.hypot((e[0] * x + e[1] * y + e[2]) / den - x, (e[3] * x + e[4] * y + e[5]) / den - y)

    return (moved(zero, zero) + moved(w, zero) + moved(w, h) + moved(zero, h)) / 4


def camera_residual(flow: DataFrame, pairs: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Flow minus the flow that the pair's camera transform alone would cause; static clips keep their flow.

    `pairs` has t, m, is_static; the join key is (by, t), so frames spread.
    """
    by = list(by)
    d = flow.join(pairs.select(*by, "t", "m", "is_static"), by + ["t"])
    e = [F.get("m", F.lit(i)) for i in range(9)]
    den = e[6] * F.col("x") + e[7] * F.col("y") + e[8]
    cx, cy = (e[0] * F.col("x") + e[1] * F.col("y") + e[2]) / den - F.col("x"), (e[3] * F.col("x") + e[4] * F.col("y") + e[5]) / den - F.col("y")
    return d.withColumn("vx", F.when(F.col("is_static"), F.col("vx")).otherwise(F.col("vx") - cx)).withColumn("vy", F.when(F.col("is_static"), F.col("vy")).otherwise(F.col("vy") - cy)).drop("m", "is_static")


def accept_pairs(pairs: DataFrame, sizes: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Adds model and drift: a fit needs 20 inliers, half of its matches, and a corner drift under a quarter of the width."""
    by = list(by)
    d = salted_join(pairs, sizes.select(*by, "h", "w"), by, ["t"])
    drift = corner_drift(F.col("m"), F.col("h").cast("double"), F.col("w").cast("double"))
    d = d.withColumn("drift", drift)
    ok = (F.col("inliers") >= 20) & (F.col("inliers") >= F.col("matches") * 0.5) & (F.col("drift") < F.col("w") * DRIFT_CAP)
    ident = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    return d.select(*by, "t", F.when(ok, F.col("m")).otherwise(ident).alias("m"), F.when(ok, "affine").otherwise("none").alias("model"), F.when(ok, F.col("drift")).otherwise(0.0).alias("drift"))


def camera_static(pairs: DataFrame, by: Sequence[str] = ("clip",), clips: DataFrame | None = None) -> DataFrame:
    """Static or moving camera from the median drift of pairs with a real model; model label, residual and warnings.

    A clip of `clips` without any frame pair counts as static, with a warning."""
    by = list(by)
    c = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("model") == "none").alias("none"))
    med = quantiles(pairs.filter("model <> 'none'"), by, {"med": "drift"})
    if clips is not None:
        c = clips.select(*by).distinct().join(c, by, "left").fillna(0, ["pairs", "none"])
    d = c.join(med, by, "left")
    static = F.coalesce(F.col("med") < STATIC_PX, F.lit(True))
    return d.select(*by, static.alias("is_static"), F.when(static | (F.col("none") == F.col("pairs")), "none").otherwise("affine").alias("model"), F.round(F.coalesce("med", F.lit(0.0)), 3).alias("residual_px"),
                    F.array_compact(F.array(F.when(F.col("none") > 0, F.concat("none", F.lit("/"), "pairs", F.lit(" pairs without background points"))),
                                            F.when(F.col("med").isNull(), F.lit("no pair has a transform, camera taken as fixed")))).alias("warnings"))


def compose_transforms(pairs: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Cumulative product of per-pair similarities, frame 0 to frame i, as a, b, tx, ty of [[a,-b,tx],[b,a,ty]].

    The product does not commute, so it is a scan: blocks of frames are multiplied up each on its own, the
    blocks' products are scanned the same way, and every frame's product takes that of the blocks before it.
    Nothing is divided out again, so long zooms stay as exact as the steps.
    """
    by = list(by)
    m = lambda k: F.get("m", F.lit(k)).cast("double")
    d = scan_similarities(pairs.select(*by, F.col("t").cast("long").alias("t"), m(0).alias("a"), m(3).alias("b"), m(2).alias("tx"), m(5).alias("ty")), by)
    one = F.struct(F.lit(0).cast("long").alias("i"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    step = F.struct((F.col("t") + 1).alias("i"), "a", "b", "tx", "ty")
    out = d.select(*by, F.explode(F.when(F.col("t") == 0, F.array(one, step)).otherwise(F.array(step))).alias("c"))
    return out.select(*by, "c.i", *[fixed(F.col(f"c.{n}"), 6).alias(n) for n in ("a", "b", "tx", "ty")])


def scan_similarities(maps: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(by, t, a, b, tx, ty): the product of all maps of a group up to t, the last one applied last."""
    by = list(by)
    kept = "".join(f"`{c}` {maps.schema[c].dataType.simpleString()}, " for c in by)

    def multiply(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t")
        p, q, out = 1.0 + 0.0j, 0.0j, []
        for a, b, x, y in zip(*(rows[c].to_pylist() for c in ("a", "b", "tx", "ty")), strict=True):
            turn = complex(a, b)
            p, q = turn * p, turn * q + complex(x, y)
            out.append((p.real, p.imag, q.real, q.imag))
        got = np.array(out)
        last = np.arange(len(got)) == len(got) - 1
        return pa.table({**{c: rows[c] for c in [*by, "t"]}, **{c: got[:, k] for k, c in enumerate(("a", "b", "tx", "ty"))}, "last": last})

    inside = maps.withColumn("_blk", blocks("t", block)).groupBy(*by, "_blk").applyInArrow(multiply, f"{kept}t long, a double, b double, tx double, ty double, last boolean")
    inside = checkpoint(inside.withColumn("_blk", blocks("t", block)))
    ends = inside.filter("last")
    if ends.filter(F.col("_blk") > 0).isEmpty():
        return inside.drop("_blk", "last")
    whole = scan_similarities(ends.select(*by, F.col("_blk").alias("t"), "a", "b", "tx", "ty"), by, block)
    # the nearest block before may be some blocks off
    order = ends.select(*by, "_blk").withColumn("_next", F.lead("_blk").over(W.partitionBy(*by).orderBy("_blk")))
    before = whole.join(order.withColumnRenamed("_blk", "t"), [*by, "t"]).select(*by, F.col("_next").alias("_blk"), *[F.col(c).alias(f"_{c}") for c in ("a", "b", "tx", "ty")])
    d = inside.join(before, [*by, "_blk"], "left").fillna({"_a": 1.0, "_b": 0.0, "_tx": 0.0, "_ty": 0.0})
    a, b = F.col("a"), F.col("b")
    return d.select(*by, "t", (a * F.col("_a") - b * F.col("_b")).alias("a"), (b * F.col("_a") + a * F.col("_b")).alias("b"),
                    (a * F.col("_tx") - b * F.col("_ty") + F.col("tx")).alias("tx"), (b * F.col("_tx") + a * F.col("_ty") + F.col("ty")).alias("ty"))


def depth_summary(depth: DataFrame, mask: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Scene mean, object mean, spread and rank (share of the frame that is farther), averaged over the sampled frames.

    `depth` has frame, y, x, d. Clips without masked pixels get null object values.
    """
    by = list(by)
    m = mask.select(*by, "y", "x").distinct().withColumn("_in", F.lit(True))
    d = depth.join(m, by + ["y", "x"], "left")
    obj = F.when(F.col("_in"), F.col("d"))
    per = checkpoint(d.groupBy(*by, "frame").agg(F.avg("d").alias("scene"), F.avg(obj).alias("object"), F.stddev_pop(obj).alias("spread")))
    far = depth.join(per.select(*by, "frame", "object"), by + ["frame"]).groupBy(*by, "frame").agg(F.avg(F.when(F.col("object").isNotNull(), (F.col("d") < F.col("object")).cast("double"))).alias("rank"))
    s = per.join(far, by + ["frame"]).groupBy(*by).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("scene", "object", "rank", "spread")], F.count(F.lit(1)).alias("frames"))
    return s
