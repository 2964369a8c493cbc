"""Travel paths and polylines: track choice, path building, arc length, as-of sampling, playback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.functions.scalar import TWO_PI, clamp, fixed, half_even
from trackframe.operators.series import BLOCK, dense_index, densify, halo, known_in_ranges, prefix_sums, salted_join, smooth_pinned
from trackframe.session import checkpoint

# Fixed thresholds of a travel path.
MIN_POINTS, FILLS_FRAME, HOVER, SHORT_TRACK = 6, 0.6, 0.02, 0.5
MARGIN = 8.0


def longest_track(detections: DataFrame, by: Sequence[str] = ("clip",), track: str = "track_id") -> DataFrame:
    """Rows of each clip's track with the most detections; the one seen first wins a tie."""
    by = list(by)
    size = detections.groupBy(*by, track).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"))
    best = size.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "t0", track)).alias("_b"))
    # the track id joins the key, so a hot clip still spreads over its tracks
    return detections.join(best.select(*by, F.col(f"_b.{track}").alias(track)), by + [track], "left_semi")


def build_path(track: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(points, summary) of one track per clip.

    `track` has t, cx, cy, w, h; `clips` has label, fps and total_frames (null when unknown). Tracks
    under six detections give no rows. Points are offsets from the path's own start.
    """
    by = list(by)
    size = track.groupBy(*by).agg(F.count(F.lit(1)).alias("raw")).filter(F.col("raw") >= MIN_POINTS)
    long = salted_join(track, size, by, ["t"])
    dense = densify(long.select(*by, "raw", "t", "cx", "cy", "w", "h"), by, ["cx", "cy", "w", "h"])
    dense = dense_index(dense, by, ["t", "filled"], F.col("t"), name="i")
    dense = checkpoint(dense)
    stats = dense.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sm = smooth_pinned(salted_join(dense, stats, by, ["i"]), by, ["cx", "cy"])
    first = sm.filter(F.col("i") == 0).select(*by, F.col("cx").alias("x0"), F.col("cy").alias("y0"))
    pts = salted_join(sm, first, by, ["i"]).withColumn("dx", F.col("cx") - F.col("x0")).withColumn("dy", F.col("cy") - F.col("y0"))
    pts = checkpoint(pts)
    points = pts.select(*by, "i", "t", "filled", fixed(F.col("dx"), 5).alias("dx"), fixed(F.col("dy"), 5).alias("dy"))
    legs = step_lengths(pts, by, "i", "cx", "cy")
    s = legs.groupBy(*by).agg(
        F.max("raw").alias("raw"), F.count(F.lit(1)).alias("frames"), F.count_if("filled").alias("interpolated"),
        F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.max_by("dx", "i").alias("dx"), F.max_by("dy", "i").alias("dy"),
        (F.max("cx") - F.min("cx")).alias("span_x"), (F.max("cy") - F.min("cy")).alias("span_y"),
        F.sum("leg").alias("dist"), F.avg("w").alias("w"), F.avg("h").alias("h")).join(clips, by)
    net = F.hypot("dx", "dy")
    conf = F.when(F.col("total_frames") > 0, F.round(F.try_divide(F.col("raw"), F.col("total_frames")), 3))
    lab = F.col("label")
    notes = F.array_compact(F.array(
        F.when(F.col("interpolated") > 0, F.concat(F.lit("gaps filled: "), F.col("interpolated"), F.lit(" frames of '"), lab, F.lit("'"))),
        F.when(net < HOVER, F.format_string("hovering: '%s' ends %.3f of the frame from its start", lab, net)),
        F.when(F.greatest("w", "h") > FILLS_FRAME, F.format_string("large box: '%s' fills %.2f by %.2f of the frame", lab, F.col("w"), F.col("h"))),
        F.when(conf < SHORT_TRACK, F.format_string("short track: '%s' is seen in %.0f%% of the clip", lab, conf * 100))))
    summary = s.select(
        *by, "label", "frames", F.round("fps", 2).alias("fps"), fixed(F.col("x0"), 5).alias("start_x"), fixed(F.col("y0"), 5).alias("start_y"),
        fixed(F.col("w"), 5).alias("size_w"), fixed(F.col("h"), 5).alias("size_h"), fixed(F.col("dx"), 5).alias("dx"), fixed(F.col("dy"), 5).alias("dy"),
        fixed(F.col("span_x"), 5).alias("span_x"), fixed(F.col("span_y"), 5).alias("span_y"), fixed(F.col("dist"), 5).alias("dist"),
        F.when(F.col("dist") > 1e-6, fixed(F.try_divide(net, F.col("dist")), 4)).otherwise(0.0).alias("straightness"), conf.alias("confidence"), notes.alias("warnings"))
    return points, summary


def step_lengths(pts: DataFrame, by: Sequence[str], i: str, x: str, y: str) -> DataFrame:
    """Adds leg, the distance from the row before (0 on the first), for densely numbered rows."""
    d = halo(pts, i, BLOCK, 1, 0)
    w = W.partitionBy(*by, "_blk").orderBy(i)
    leg = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return d.withColumn("leg", F.coalesce(leg, F.lit(0.0))).filter("_own").drop("_blk", "_own")


def arc_length(poly: DataFrame, by: Sequence[str] = ("clip",), i: str = "i", x: str = "x", y: str = "y") -> DataFrame:
    """Adds leg and cum, the distance along the polyline."""
    return prefix_sums(step_lengths(poly, by, i, x, y), by, i, {"cum": "leg"})


def bracket_sample(samples: DataFrame, instants: DataFrame, by: Sequence[str], at: str, cols: Sequence[str]) -> DataFrame:
    """Value at each instant between the two neighbouring samples; clamps past the ends.

    An as-of join by merging: samples and instants are laid out along `at` in one table, cut into ranges
    of about equal numbers of rows whatever the scale of `at`, and every instant takes the nearest sample
    on each side; a range gets what lies outside it through one carry row. No pairs are formed.
    """
    by = list(by)
    extra = [c for c in instants.columns if c not in by + [at]]
    both = samples.select(*by, at, *cols, F.lit(True).alias("_s")).unionByName(
        instants.withColumn("_s", F.lit(False)), allowMissingColumns=True)
    d = known_in_ranges(both, by, at, F.col("_s"), cols).filter(~F.col("_s"))
    f = F.coalesce(F.try_divide(F.col(at) - F.col("_left.o"), F.col("_right.o") - F.col("_left.o")), F.lit(0.0))
    out = [F.coalesce(F.col(f"_left.{c}") + f * (F.col(f"_right.{c}") - F.col(f"_left.{c}")), F.col(f"_left.{c}"), F.col(f"_right.{c}")).alias(c) for c in cols]
    return d.select(*by, at, *extra, *out)


def resample_by_arc(poly: DataFrame, instants: DataFrame, by: Sequence[str] = ("clip",), f: str = "f") -> DataFrame:
    """Points at fractions f of each polyline's length. Needs two points and a length over 0.5."""
    by = list(by)
    cum = checkpoint(arc_length(poly, by))
    total = cum.groupBy(*by).agg(F.max("cum").alias("total"), F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= 2) & (F.col("total") > 0.5))
    at = salted_join(instants, total.drop("_n"), by, [f]).withColumn("cum", clamp(F.col(f), 0, 1) * F.col("total")).drop("total")
    return bracket_sample(cum.join(total.select(*by), by, "left_semi").select(*by, "cum", "x", "y"), at, by, "cum", ["x", "y"])


def seam_gap(poly: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Distance from a polyline's last point to its first."""
    d = poly.groupBy(*by).agg(F.min_by(F.struct("x", "y"), "i").alias("a"), F.max_by(F.struct("x", "y"), "i").alias("b"))
    return d.select(*by, F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("gap"))


def extent_fit(points: DataFrame, art: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """One uniform scale (at most 1) that keeps a path inside the room around its figure.

    `art` has the figure's box bx, by_, bw, bh and the canvas vw, vh.
    """
    by = list(by)
    d = points.groupBy(*by).agg(F.max("dx").alias("r"), F.max(-F.col("dx")).alias("l"), F.max("dy").alias("d"), F.max(-F.col("dy")).alias("u"),
                                F.max("i").alias("span")).join(art, by)
    zero = F.lit(0.0)
    room = {"left": F.greatest(zero, F.col("bx") - MARGIN), "right": F.greatest(zero, F.col("vw") - (F.col("bx") + F.col("bw")) - MARGIN),
            "up": F.greatest(zero, F.col("by_") - MARGIN), "down": F.greatest(zero, F.col("vh") - (F.col("by_") + F.col("bh")) - MARGIN)}
    for k, v in room.items():
        d = d.withColumn(k, v)

    def fit(want: str, size: str, have: str) -> Column:
        w = F.greatest(zero, F.col(want)) * F.col(size)
        return F.when(w > 1e-3, F.try_divide(F.col(have), w)).otherwise(1.0)

    return d.withColumn("scale", F.least(F.lit(1.0), fit("r", "vw", "right"), fit("l", "vw", "left"), fit("d", "vh", "down"), fit("u", "vh", "up"))).drop("r", "l", "d", "u")


def path_playback(points: DataFrame, summary: DataFrame, art: DataFrame, dials: DataFrame, instants: DataFrame,
                  by: Sequence[str] = ("clip",), intensity: float = 1.0) -> DataFrame:
    """Offsets of a figure that follows a path back and forth, with a small bob across its course.

    `points` has i, dx, dy; `summary` has net dx, dy, fps; `dials` has amplitude, frequency;
    `instants` has tt, seconds. Offsets never leave the room around the figure.
    """
    by = list(by)
    fit = extent_fit(points, art, by)
    s = summary.select(*by, F.col("dx").alias("net_x"), F.col("dy").alias("net_y"), F.greatest(F.col("fps"), F.lit(1.0)).alias("fps"))
    meta = fit.join(s, by).join(dials.select(*by, "amplitude", "frequency"), by)
    d = salted_join(instants, meta, by, ["tt"])
    span = F.col("span").cast("double")
    u = F.pmod(F.col("tt") * F.col("fps"), span * 2)
    d = d.withColumn("_pos", F.when(u <= span, u).otherwise(span * 2 - u))
    d = d.withColumn("i", F.least(F.col("span") - 1, F.floor("_pos")).cast("long")).withColumn("_f", F.col("_pos") - F.col("i"))
    here = points.select(*by, "i", F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    after = points.select(*by, (F.col("i") - 1).alias("i"), F.col("dx").alias("cx"), F.col("dy").alias("cy"))
    d = d.join(here, by + ["i"]).join(after, by + ["i"])
    length = F.hypot("net_x", "net_y")
    length = F.when(length == 0, F.lit(1.0)).otherwise(length)
    bob = (F.col("amplitude") + 0.4) * 4.0 * intensity * F.sin((F.col("frequency") * 0.5 + 0.6) * (TWO_PI * 0.28) * F.col("tt"))
    dx = (F.col("ax") + (F.col("cx") - F.col("ax")) * F.col("_f")) * F.col("scale") * F.col("vw") * intensity - F.col("net_y") / length * bob
    dy = (F.col("ay") + (F.col("cy") - F.col("ay")) * F.col("_f")) * F.col("scale") * F.col("vh") * intensity + F.col("net_x") / length * bob
    return d.select(*by, "tt", F.greatest(-F.col("left"), F.least(F.col("right"), dx)).alias("dx"), F.greatest(-F.col("up"), F.least(F.col("down"), dy)).alias("dy"))


def route_playback(poly: DataFrame, routes: DataFrame, instants: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Offsets along a drawn route: eased once, or at constant speed when it loops. `routes` has duration, loop."""
    by = list(by)
    d = salted_join(instants, routes, by, ["tt"])
    raw = F.col("tt") / F.greatest(F.col("duration"), F.lit(0.1))
    once = F.least(F.lit(1.0), raw)
    d = d.withColumn("f", F.when(F.col("loop"), raw - F.floor(raw)).otherwise(once * once * (3 - once * 2)))
    at = resample_by_arc(poly, d.select(*by, "tt", "f"), by)
    start = poly.filter(F.col("i") == 0).select(*by, F.col("x").alias("x0"), F.col("y").alias("y0"))
    out = salted_join(at, start, by, ["tt"])
    return out.select(*by, "tt", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"))


def min_length_gate(rows: DataFrame, by: Sequence[str], least: int, what: str) -> DataFrame:
    """Row count per group, whether it reaches `least`, and a note when it does not."""
    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("ok", F.col("n") >= least).withColumn(
        "note", F.when(F.col("n") < least, F.concat(F.lit("only "), F.col("n"), F.lit(f" {what} (need {least})"))))
