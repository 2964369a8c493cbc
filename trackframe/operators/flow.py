"""Dense and sparse flow fields: cells, masks, the eight dials, trajectories, grid optical flow.

A flow table has one row per (clip, frame, pixel or cell). Frame-level and clip-level results are
aggregated with map-side combine; per-pixel work is keyed by pixel, so a clip that holds a large
share of the rows is spread over its pixels or frames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.functions.scalar import TWO_PI, axis_degrees, axis_radians, clamp, clamp01, fixed, half_even, half_up
from trackframe.operators.series import halo, prefix_sums, salted_join
from trackframe.operators.spectra import dft, refined_bin, spectral_peak
from trackframe.session import checkpoint

MIN_FRAMES, MIN_PIXELS = 12, 4
NOISE_FLOOR = 0.55
STATIC_PERSISTENCE = 0.85
TRACK_CELL_FLOOR = 0.20
DIALS = ["frequency", "amplitude", "direction", "turbulence", "damping", "phaseSpread", "driftX", "driftY"]
FRAME_BLOCK = 256


# ---------------------------------------------------------------- geometry

def to_cells(flow: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Mean flow per grid cell; rows and columns left over by the integer cell size are dropped."""
    f = salted_join(flow, clips.select(*by, "height", "width", "grid"), by, ["y", "x"])
    gy = F.floor(F.col("y") / F.floor(F.col("height") / F.col("grid")))
    gx = F.floor(F.col("x") / F.floor(F.col("width") / F.col("grid")))
    f = f.withColumn("gy", gy).withColumn("gx", gx).filter((F.col("gy") < F.col("grid")) & (F.col("gx") < F.col("grid")))
    return f.groupBy(*by, "t", "gy", "gx").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))


def crop_geometry(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Pixel rectangle and output size of normalized boxes bx, by, bw, bh.

    A rectangle under 8 pixels on a side is degenerate (`ok` false, sizes null). Small crops are
    enlarged to at least 128 a side; both sides are cut down to a multiple of 8.
    """
    def edge(c: Column, size: Column) -> Column:
        return F.least(F.greatest(half_even(c * size), F.lit(0)), size.cast("long") - 1)

    d = boxes.withColumn("x0", edge(F.col("bx"), width)).withColumn("y0", edge(F.col("by"), height))
    d = (d.withColumn("x1", F.least(width.cast("long"), F.col("x0") + half_even(F.col("bw") * width)))
          .withColumn("y1", F.least(height.cast("long"), F.col("y0") + half_even(F.col("bh") * height))))
    cw, ch = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    scale = F.greatest(F.lit(1.0), F.try_divide(F.lit(128.0), ch), F.try_divide(F.lit(128.0), cw))
    ok = (cw >= 8) & (ch >= 8)

    def snapped(side: Column) -> Column:
        return F.when(ok, F.greatest(F.lit(128), F.floor(half_even(side * scale) / 8) * 8).cast("long"))

    return d.withColumn("ok", ok).withColumn("out_w", snapped(cw)).withColumn("out_h", snapped(ch))


def crop(flow: DataFrame, boxes: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Keep the pixels inside each clip's rectangle, renumbered from its corner; degenerate boxes keep all."""
    d = salted_join(flow, boxes.select(*by, "x0", "y0", "x1", "y1", "ok"), by, ["y", "x"])
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return (d.filter(~F.col("ok") | inside)
            .withColumn("x", F.when(F.col("ok"), F.col("x") - F.col("x0")).otherwise(F.col("x")))
            .withColumn("y", F.when(F.col("ok"), F.col("y") - F.col("y0")).otherwise(F.col("y")))
            .drop("x0", "y0", "x1", "y1", "ok"))


def resample_nearest(mask: DataFrame, src: tuple[Column, Column], out: tuple[Column, Column]) -> DataFrame:
    """Nearest-neighbour resize of a pixel set from (height, width) `src` to `out`.

    Output row r reads source row floor(r * src / out), so each source pixel knows which output
    rows and columns it fills: an expansion, no join.
    """
    def spread(c: str, s: Column, o: Column) -> Column:
        lo = F.ceil(F.col(c) * o / s).cast("long")
        hi = F.ceil((F.col(c) + 1) * o / s).cast("long") - 1
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    rows = mask.withColumn("_y", F.explode(spread("y", src[0], out[0])))
    return (rows.withColumn("_x", F.explode(spread("x", src[1], out[1]))).withColumn("y", F.col("_y"))
            .withColumn("x", F.col("_x")).drop("_y", "_x"))


def align_mask(mask: DataFrame, geometry: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Put a mask through the frames' geometry: resize to the frame, crop, resize to the flow.

    `geometry` holds per clip mask_h, mask_w, src_h, src_w, x0, y0, x1, y1, ok, out_h, out_w.
    """
    g = salted_join(mask, geometry, by, ["y", "x"])
    g = resample_nearest(g, (F.col("mask_h"), F.col("mask_w")), (F.col("src_h"), F.col("src_w")))
    x0, y0 = F.when(F.col("ok"), F.col("x0")).otherwise(0), F.when(F.col("ok"), F.col("y0")).otherwise(0)
    x1 = F.when(F.col("ok"), F.col("x1")).otherwise(F.col("src_w"))
    y1 = F.when(F.col("ok"), F.col("y1")).otherwise(F.col("src_h"))
    g = g.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    g = g.withColumn("_h", y1 - y0).withColumn("_w", x1 - x0).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)
    return resample_nearest(g, (F.col("_h"), F.col("_w")), (F.col("out_h"), F.col("out_w"))).select(*by, "y", "x")


def restrict_to_mask(flow: DataFrame, mask: DataFrame, by: Sequence[str] = ("clip",),
                     px: Sequence[str] = ("y", "x")) -> DataFrame:
    """Keep masked pixels; clips whose mask has under four pixels keep everything (`masked` false)."""
    m = mask.select(*by, *px).distinct()
    sizes = m.groupBy(*by).agg(F.count(F.lit(1)).alias("_px"))
    d = flow.join(m.withColumn("_in", F.lit(True)), [*by, *px], "left")
    d = salted_join(d, sizes, by, px, "left").withColumn("masked", F.coalesce(F.col("_px") >= MIN_PIXELS, F.lit(False)))
    return d.filter(~F.col("masked") | F.coalesce(F.col("_in"), F.lit(False))).drop("_in", "_px")


def cell_coverage(mask: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",), floor: float = TRACK_CELL_FLOOR) -> DataFrame:
    """Covered fraction of every grid cell and whether it may track: (by, gy, gx, coverage, keep)."""
    g = clips.select(*by, "height", "width", "grid")
    ch, cw = F.floor(F.col("height") / F.col("grid")), F.floor(F.col("width") / F.col("grid"))
    d = salted_join(mask, g, by, ["y", "x"]).withColumn("gy", F.floor(F.col("y") / ch)).withColumn("gx", F.floor(F.col("x") / cw))
    hit = (d.filter((F.col("gy") < F.col("grid")) & (F.col("gx") < F.col("grid")))
           .groupBy(*by, "gy", "gx").agg(F.count(F.lit(1)).alias("_hit")))
    axis = F.sequence(F.lit(0).cast("long"), F.col("grid") - 1)
    spine = g.withColumn("gy", F.explode(axis)).withColumn("gx", F.explode(axis)).withColumn("_area", ch * cw)
    out = spine.join(hit, [*by, "gy", "gx"], "left")
    cover = F.coalesce(F.col("_hit"), F.lit(0)) / F.col("_area")
    return out.select(*by, "gy", "gx", cover.alias("coverage"), (cover >= floor).alias("keep"))


# ---------------------------------------------------------------- frame and clip statistics

def frame_moments(flow: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Per frame: pixel count, mean flow, and how far the flow directions cancel."""
    mag = F.hypot("vx", "vy") + 1e-9
    return flow.groupBy(*by, "t").agg(
        F.count(F.lit(1)).alias("px"), F.avg("vx").alias("gx"), F.avg("vy").alias("gy"),
        F.sum("vx").alias("sx"), F.sum("vy").alias("sy"), F.sum(mag).alias("wsum"))


def clip_axis(frames: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Per clip: frame count, drift, principal axis of the frame means, direction, disorder."""
    moving = F.col("wsum") / F.col("px") > 0.02
    disorder = F.when(moving, 1 - F.hypot("sx", "sy") / F.col("wsum"))
    c = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("px").alias("px"), F.avg("gx").alias("drift_x"), F.avg("gy").alias("drift_y"),
        F.var_pop("gx").alias("cxx"), F.var_pop("gy").alias("cyy"), F.covar_pop("gx", "gy").alias("cxy"),
        F.coalesce(F.avg(disorder), F.lit(0.0)).alias("disorder"))
    c = c.filter((F.col("n") >= MIN_FRAMES) & (F.col("px") >= MIN_PIXELS)).join(clips, list(by))
    c = c.withColumn("theta", axis_radians(F.col("cxx"), F.col("cxy"), F.col("cyy")))
    scale = F.col("width") * 0.005
    return (c.withColumn("direction", half_even(axis_degrees(F.col("theta"))))
             .withColumn("driftX", clamp(F.col("drift_x") / scale, -1, 1))
             .withColumn("driftY", clamp(F.col("drift_y") / scale, -1, 1)))


def projection(frames: DataFrame, axis: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Frame means minus drift, projected on the clip's axis: a series (by, n, t, v)."""
    d = salted_join(frames.select(*by, "t", "gx", "gy"), axis.select(*by, "n", "drift_x", "drift_y", "theta"), by, ["t"])
    v = (F.col("gx") - F.col("drift_x")) * F.cos("theta") + (F.col("gy") - F.col("drift_y")) * F.sin("theta")
    return d.select(*by, "n", "t", v.alias("v"))


def rhythm(series: DataFrame, axis: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Dominant frequency, spectral flatness and damping of the projected series."""
    by = list(by)
    peak = spectral_peak(dft(series, by), by).join(axis.select(*by, "fps"), by)
    bin_ = refined_bin(F.col("k"), F.col("n"), F.col("mag_lo"), F.col("mag"), F.col("mag_hi"))
    peak = peak.withColumn("frequency", clamp(bin_ * F.col("fps") / F.col("n"), 0.05, 8.0))
    lag = F.greatest(F.lit(2), F.least(F.col("n") - 4, half_even(F.col("fps") / F.col("frequency"))))
    peak = checkpoint(peak.withColumn("lag", lag.cast("long")))
    return peak.join(lag_correlation(series, peak.select(*by, "lag"), by), by)


def lag_correlation(series: DataFrame, lags: DataFrame, by: Sequence[str]) -> DataFrame:
    """damping = 1 - |sum v(t) v(t+lag)| / sum v^2, where each group has its own lag."""
    by = list(by)
    a = salted_join(series, lags, by, ["t"]).withColumn("t2", F.col("t") + F.col("lag"))
    b = series.select(*by, F.col("t").alias("t2"), F.col("v").alias("v2"))
    pair = a.join(b, by + ["t2"], "left").groupBy(*by).agg(F.sum(F.pow("v", 2)).alias("den"), F.sum(F.col("v") * F.col("v2")).alias("num"))
    r = F.when(F.col("den") > 1e-9, F.abs(F.coalesce(F.col("num"), F.lit(0.0)) / F.col("den"))).otherwise(0.5)
    return pair.select(*by, clamp01(1 - r).alias("damping"))


def next_frame(flow: DataFrame, key: Sequence[str], v: str, t: str = "t") -> DataFrame:
    """Pair each pixel's value with its value in the next frame: adds next_<v>."""
    d = halo(flow, t, FRAME_BLOCK, 0, 1)
    lead = F.lead(v).over(W.partitionBy(*key, "_blk").orderBy(t))
    return d.withColumn(f"next_{v}", lead).filter("_own").drop("_blk", "_own")


def frame_correlation(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean over frames of the pixel correlation between a frame and the next: (by, persistence)."""
    per = pairs.filter(F.col(b).isNotNull()).groupBy(*by, "t").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    corr = F.col("n") * F.col("c") / (F.col("n") * F.sqrt(F.col("va") * F.col("vb")) + 1e-9)
    return per.groupBy(*by).agg(F.avg(corr).alias("persistence"))


def persistence(flow: DataFrame, by: Sequence[str] = ("clip",), px: Sequence[str] = ("gy", "gx")) -> DataFrame:
    """Persistence of the raw flow magnitude: near 1 on a static scene."""
    d = flow.withColumn("m", F.hypot("vx", "vy")).select(*by, *px, "t", "m")
    return frame_correlation(next_frame(d, [*by, *px], "m"), by, "m", "next_m")


def static_clips(flow: DataFrame, by: Sequence[str] = ("clip",), px: Sequence[str] = ("gy", "gx")) -> DataFrame:
    """Persistence with the static verdict (no regions) and the amplitude gate."""
    p = persistence(flow, by, px)
    return p.withColumn("is_static", F.col("persistence") >= STATIC_PERSISTENCE).withColumn(
        "gate", clamp01((0.92 - F.col("persistence")) / 0.12))


def _pixel_stage(flow: DataFrame, clip: DataFrame, by: list[str], px: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per clip: moving strength and phase spread; and the persistence of the residual magnitude."""
    need = clip.select(*by, "n", "drift_x", "drift_y", "theta", "k", "floor")
    d = salted_join(flow.select(*by, "t", *px, "vx", "vy"), need, by, px, keep_salt=True)
    d = d.withColumn("m", F.hypot(F.col("vx") - F.col("drift_x"), F.col("vy") - F.col("drift_y")))
    angle = F.pmod(F.greatest(F.col("k"), F.lit(1)) * F.col("t"), F.col("n")) * TWO_PI / F.col("n")
    q = F.col("vx") * F.cos("theta") + F.col("vy") * F.sin("theta")
    moving = F.col("m") > F.col("floor")
    per_px = d.groupBy(*by, "_salt", *px).agg(
        F.sum(q * F.cos(angle)).alias("re"), F.sum(-q * F.sin(angle)).alias("im"),
        F.sum(F.when(moving, F.col("m") - F.col("floor"))).alias("over"), F.count_if(moving).alias("moving"),
        F.count(F.lit(1)).alias("all"))
    mag = F.hypot("re", "im")
    w = F.pow(mag, 2)
    unit = F.lit(1.0) / (mag + 1e-12)
    per_clip = per_px.groupBy(*by).agg(
        F.sum("over").alias("over"), F.sum("moving").alias("moving"), F.sum("all").alias("all"), F.sum(w).alias("energy"),
        F.hypot(F.sum(F.col("re") * unit * w), F.sum(F.col("im") * unit * w)).alias("resultant"))
    spread = F.when(F.col("energy") > 1e-9, clamp01(1 - F.col("resultant") / F.col("energy"))).otherwise(0.3)
    out = per_clip.select(*by, (F.col("moving") / F.col("all")).alias("frac"), F.try_divide(F.col("over"), F.col("moving")).alias("strength"),
                          spread.alias("spread"))
    pairs = next_frame(d.select(*by, "_salt", *px, "t", "m"), [*by, "_salt", *px], "m")
    return out, frame_correlation(pairs, by, "m", "next_m")


def distill_parts(flow: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",), px: Sequence[str] = ("gy", "gx"),
                  noise_floor: float = NOISE_FLOOR) -> DataFrame:
    """Every measured piece behind the dials, unrounded. `clips` has by, fps, width and may have its own floor.

    Frame-level and clip-level steps feed several later ones, so their lineage is cut: each is a
    tiny fraction of the flow table.
    """
    by, px = list(by), list(px)
    if "floor" not in clips.columns:
        clips = clips.withColumn("floor", F.lit(float(noise_floor)))
    frames = checkpoint(frame_moments(flow, by))
    axis = checkpoint(clip_axis(frames, clips.select(*by, "fps", "width", "floor"), by))
    series = checkpoint(projection(frames, axis, by))
    beat = rhythm(series, axis, by).select(*by, "k", "frequency", "flatness", "damping")
    clip = checkpoint(axis.join(beat, by))
    moving, persist = _pixel_stage(flow, clip, by, px)
    d = reduce(lambda a, b: a.join(b, by), [clip, moving, persist])
    gate = clamp01((0.92 - F.col("persistence")) / 0.12)
    amp = clamp01(F.col("strength") / (F.col("width") * 0.006) * F.least(F.lit(1.0), F.col("frac") / 0.03) * gate)
    d = d.withColumn("amplitude", F.when(F.col("frac") > 0.003, amp).otherwise(0.0))
    dial_gate = F.least(F.lit(1.0), F.col("amplitude") / 0.10)
    return (d.withColumn("turbulence", clamp01((F.col("flatness") * 0.5 + F.col("disorder") * 0.5) * 1.4) * dial_gate)
             .withColumn("phaseSpread", F.col("spread") * dial_gate))


def distill(flow: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",), px: Sequence[str] = ("gy", "gx"),
            noise_floor: float = NOISE_FLOOR) -> DataFrame:
    """The eight dials per group. Groups with under 12 frames or 4 pixels give no row."""
    p = distill_parts(flow, clips, by, px, noise_floor)
    return p.select(*by, *[F.col(d).cast("double").alias(d) if d == "direction" else fixed(F.col(d), 3).alias(d) for d in DIALS])


# ---------------------------------------------------------------- sparse (validity-flagged) variant

def distill_sparse(flow: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",), px: Sequence[str] = ("gy", "gx")) -> DataFrame:
    """Six dials from a flow table with a `valid` flag; needs 16 frames. Clips give fps."""
    by, px = list(by), list(px)
    ok = F.col("valid")
    mag = F.hypot("vx", "vy")
    strong = ok & (mag >= 0.05)
    frames = flow.groupBy(*by, "t").agg(
        F.coalesce(F.avg(F.when(ok, F.col("vx"))), F.lit(0.0)).alias("gx"), F.coalesce(F.avg(F.when(ok, F.col("vy"))), F.lit(0.0)).alias("gy"),
        F.sum(F.when(strong, F.col("vx"))).alias("sx"), F.sum(F.when(strong, F.col("vy"))).alias("sy"),
        F.coalesce(F.sum(F.when(strong, mag)), F.lit(0.0)).alias("wsum"))
    frames = checkpoint(frames)
    dis = F.when(F.col("wsum") >= 0.3, 1 - F.hypot("sx", "sy") / F.col("wsum"))
    axis = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("gx").alias("drift_x"), F.avg("gy").alias("drift_y"),
        F.var_pop("gx").alias("cxx"), F.var_pop("gy").alias("cyy"), F.covar_pop("gx", "gy").alias("cxy"),
        F.coalesce(F.avg(dis), F.lit(0.0)).alias("disorder")).filter(F.col("n") >= 16).join(clips.select(*by, "fps"), by)
    axis = (axis.withColumn("theta", axis_radians(F.col("cxx"), F.col("cxy"), F.col("cyy")))
                .withColumn("direction", half_up(axis_degrees(F.col("theta"))).cast("double"))
                .withColumn("amplitude", clamp01(F.sqrt(F.col("cxx") + F.col("cyy")) / 1.5)))
    axis = checkpoint(axis)
    series = checkpoint(projection(frames, axis, by))
    peak = spectral_peak(dft(series, by), by).join(axis.select(*by, "fps"), by).withColumn("k", F.greatest(F.col("k"), F.lit(1)))
    bin_ = refined_bin(F.col("k"), F.col("n"), F.col("mag_lo"), F.col("mag"), F.col("mag_hi"), least=2)
    peak = peak.withColumn("frequency", clamp(bin_ * F.col("fps") / F.col("n"), 0.05, 8.0))
    lag = F.greatest(F.lit(2), F.least(F.col("n") - 4, half_up(F.col("fps") / F.col("frequency")))).cast("long")
    beat = checkpoint(peak.withColumn("lag", lag))
    damp = lag_correlation(series, beat.select(*by, "lag"), by)
    clip = axis.join(beat.select(*by, "k", "frequency", "flatness"), by).join(damp, by)
    d = salted_join(flow, clip.select(*by, "n", "theta", "k"), by, px)
    q = F.when(ok, F.col("vx") * F.cos("theta") + F.col("vy") * F.sin("theta")).otherwise(0.0)
    angle = F.pmod(F.col("k") * F.col("t"), F.col("n")) * TWO_PI / F.col("n")
    per_px = d.groupBy(*by, "n", *px).agg(F.sum(q * F.cos(angle)).alias("re"), F.sum(-q * F.sin(angle)).alias("im"), F.sum(q * q).alias("e"))
    live = per_px.filter(F.col("e") / F.col("n") >= 0.005)
    m = F.hypot("re", "im")
    m = F.when(m == 0, F.lit(1.0)).otherwise(m)
    phase = live.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), (F.hypot(F.sum(F.col("re") / m), F.sum(F.col("im") / m)) / F.count(F.lit(1))).alias("r"))
    out = clip.join(phase, by, "left")
    spread = F.when(F.coalesce(F.col("cells"), F.lit(0)) < 4, 0.3).otherwise(clamp01(1 - F.col("r")))
    turb = clamp01(clamp01(F.col("flatness")) * 0.5 + F.col("disorder") * 0.5)
    return out.select(*by, fixed(F.col("frequency"), 3).alias("frequency"), fixed(F.col("amplitude"), 3).alias("amplitude"), "direction",
                      fixed(turb, 3).alias("turbulence"), fixed(F.col("damping"), 3).alias("damping"), fixed(spread, 3).alias("phaseSpread"))


# ---------------------------------------------------------------- cells and tracks

def cell_features(cells: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Energy, drift, oscillation strength and axis of each cell."""
    return cells.groupBy(*by, "gy", "gx").agg(
        F.avg(F.hypot("vx", "vy")).alias("energy"), F.avg("vx").alias("drift_x"), F.avg("vy").alias("drift_y"),
        F.sqrt(F.var_pop("vx") + F.var_pop("vy")).alias("osc"),
        axis_radians(F.var_pop("vx"), F.covar_pop("vx", "vy"), F.var_pop("vy")).alias("osc_axis"))


def grid_tracks(cells: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",), keep: DataFrame | None = None) -> DataFrame:
    """Integrate cell flow into point tracks in frame units: n + 1 points per cell, point 0 at the cell centre.

    Cells that `keep` (by, gy, gx, keep) rules out stay at their start; they are never dropped.
    """
    by = list(by)
    d = salted_join(cells, clips.select(*by, "width", "height", "grid"), by, ["gy", "gx"])
    if keep is not None:
        d = d.join(keep.select(*by, "gy", "gx", "keep"), by + ["gy", "gx"], "left")
        live = F.coalesce(F.col("keep"), F.lit(False))
    else:
        live = F.lit(True)
    d = (d.withColumn("_dx", F.when(live, F.col("vx") / F.col("width")).otherwise(0.0))
          .withColumn("_dy", F.when(live, F.col("vy") / F.col("height")).otherwise(0.0)))
    run = prefix_sums(d, by + ["gy", "gx"], "t", {"_cx": "_dx", "_cy": "_dy"})
    # the first frame also emits the start point, so no second pass is needed for it
    first = F.array(F.struct(F.lit(0).cast("long").alias("t"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy")))
    step = F.array(F.struct((F.col("t") + 1).alias("t"), F.col("_cx").alias("cx"), F.col("_cy").alias("cy")))
    pts = run.withColumn("_p", F.explode(F.when(F.col("t") == 0, F.concat(first, step)).otherwise(step)))
    return pts.select(*by, "gy", "gx", F.col("_p.t").alias("t"),
                      ((F.col("gx") + 0.5) / F.col("grid") + F.col("_p.cx")).alias("x"),
                      ((F.col("gy") + 0.5) / F.col("grid") + F.col("_p.cy")).alias("y"))


# ---------------------------------------------------------------- grid optical flow

#: Pixels of a tile's side, frames of a tile.
TILE, TILE_FRAMES = 64, 16
SUMS = ("sxx", "sxy", "syy", "sxt", "syt")


def _tile_gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients along x, y and t inside a block of gray values (t, y, x); NaN where a neighbour is unknown."""
    now = g[:-1, 1:-1, 1:-1]
    return (g[:-1, 1:-1, 2:] - g[:-1, 1:-1, :-2]) * 0.5, (g[:-1, 2:, 1:-1] - g[:-1, :-2, 1:-1]) * 0.5, g[1:, 1:-1, 1:-1] - now


def lucas_kanade(gray: DataFrame, width: int = 160, height: int = 120, grid_x: int = 16, grid_y: int = 12, radius: int = 3,
                 min_eigen: float = 40.0, max_speed: float = 6.0, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Gradient-based flow at grid points from gray pixels (by, t, y, x, g); t pairs with t + 1.

    Pixels travel once, to their tile of space and time, with a border of one pixel and one frame, which
    makes little more than one row a pixel. Gradients and their products are summed inside the tile over
    what it has of each grid point's window; the few sums of a point from several tiles are added after.
    """
    by = list(by)
    kept = "".join(f"`{c}` {gray.schema[c].dataType.simpleString()}, " for c in by)
    y, x, t = F.col("y").cast("long"), F.col("x").cast("long"), F.col("t").cast("long")

    def tiles(c: Column, size: int, before: int, after: int) -> Column:
        """The tiles that need a place: its own, and those whose border it is."""
        own, rest = F.floor(c / size).cast("long"), F.pmod(c, F.lit(size))
        return F.explode(F.array_compact(F.array(own, F.when(rest < after, own - 1), F.when(rest >= size - before, own + 1))))

    sent = gray.filter(F.col("g").isNotNull()).select(*by, t.alias("t"), y.alias("y"), x.alias("x"), F.col("g").cast("double").alias("g"), tiles(t, TILE_FRAMES, 0, 1).alias("_tt"))
    sent = sent.withColumn("_ty", tiles(F.col("y"), TILE, 1, 1)).withColumn("_tx", tiles(F.col("x"), TILE, 1, 1))
    mid_x = [math.floor((k + 0.5) * width / grid_x + 0.5) for k in range(grid_x)]
    mid_y = [math.floor((k + 0.5) * height / grid_y + 0.5) for k in range(grid_y)]

    def sums(rows: pa.Table) -> pa.Table:
        t0, y0, x0 = (rows[c][0].as_py() * size for c, size in (("_tt", TILE_FRAMES), ("_ty", TILE), ("_tx", TILE)))
        g = np.full((TILE_FRAMES + 1, TILE + 2, TILE + 2), np.nan)
        at = tuple(rows[c].to_numpy() - low for c, low in (("t", t0), ("y", y0 - 1), ("x", x0 - 1)))
        np.fmax.at(g, at, rows["g"].to_numpy())
        ix, iy, it = _tile_gradients(g)
        ok = ~(np.isnan(ix) | np.isnan(iy) | np.isnan(it))
        inner = lambda low, size: (np.arange(low, low + TILE) >= 1) & (np.arange(low, low + TILE) < size - 1)
        ok &= inner(y0, height)[None, :, None] & inner(x0, width)[None, None, :]
        ix, iy, it = (np.where(ok, v, 0.0) for v in (ix, iy, it))
        products = (ix * ix, ix * iy, iy * iy, ix * it, iy * it)
        out = []
        reach = lambda mids, low: [(k, max(m - radius - low, 0), min(m + radius + 1 - low, TILE)) for k, m in enumerate(mids) if m + radius >= low and m - radius < low + TILE]
        for gy, a, b in reach(mid_y, y0):
            for gx, c, d in reach(mid_x, x0):
                there = np.flatnonzero(ok[:, a:b, c:d].any((1, 2)))
                if len(there):
                    out.append(np.stack([there + t0, np.full(len(there), gy), np.full(len(there), gx), *[p[there, a:b, c:d].sum((1, 2)) for p in products]], 1))
        got = np.concatenate(out) if out else np.zeros((0, 3 + len(SUMS)))
        same = {c: pa.repeat(rows[c][0], len(got)) for c in by}
        return pa.table({**same, **{c: got[:, k].astype(np.int64) for k, c in enumerate(("t", "gy", "gx"))}, **{c: got[:, 3 + k] for k, c in enumerate(SUMS)}})

    part = sent.groupBy(*by, "_tt", "_ty", "_tx").applyInArrow(sums, f"{kept}t long, gy long, gx long, " + ", ".join(f"{c} double" for c in SUMS))
    m = part.groupBy(*by, "t", "gy", "gx").agg(*[F.sum(c).alias(c) for c in SUMS])
    # least squares over the window: the symmetric matrix of its gradients, inverted by its determinant
    xx, xy, yy, xt, yt = (F.col(c) for c in SUMS)
    area = xx * yy - xy * xy
    least = (xx + yy - F.hypot(xx - yy, xy * 2)) / 2
    ok = (least >= min_eigen) & (area != 0)
    speed = {"vx": xy * yt - yy * xt, "vy": xy * xt - xx * yt}
    return m.select(*by, "t", "gy", "gx", *[F.when(ok, clamp(v / area, -max_speed, max_speed)).otherwise(0.0).alias(n) for n, v in speed.items()], ok.alias("valid"))
