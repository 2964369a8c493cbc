"""Body pose: clip normalization, gait, viewpoint, bones and limb tracks.

A pose table has one row per (clip, frame, joint). Frame-level work first turns the 13 joints into
columns with one aggregation keyed by (clip, frame), so a long clip is spread over its frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe import dims
from trackframe.functions.scalar import clamp01, deg180, fixed
from trackframe.operators.series import close_loop, dense_index, detrend_ends, fill_gaps, group_stats, hold_last, quantiles, salted_join, unwrap_degrees
from trackframe.operators.spectra import band_power, best_lag
from trackframe.session import checkpoint

# The 13 joints, in order.
JOINTS = ["nose", "l_sho", "r_sho", "l_elb", "r_elb", "l_wri", "r_wri", "l_hip", "r_hip", "l_knee", "r_knee", "l_ank", "r_ank"]
# Fixed thresholds.
VISIBLE = 0.5
GAP_FRAMES = 5
GAP_MIN, WALKABLE, ANKLE_VISIBLE = 0.30, 0.6, 0.5
ANTIPHASE_MAX, BAND_MIN, AGREE_MIN = -0.5, 0.5, 0.8
DEPTH_SCALE = 0.50
FORESHORTEN, SWING_MAX, LOOP_SEAM, LOOP_KEEP, CHORD_VISIBLE = 0.6, 75.0, 0.15, 0.55, 0.5
# Fixed joint map of a 22-joint skeleton.
JOINT22 = {15: "nose", 16: "l_sho", 17: "r_sho", 18: "l_elb", 19: "r_elb", 20: "l_wri", 21: "r_wri", 1: "l_hip", 2: "r_hip", 4: "l_knee", 5: "r_knee", 7: "l_ank", 8: "r_ank"}


def wide(pose: DataFrame, by: Sequence[str] = ("clip",), extra: Sequence[str] = ()) -> DataFrame:
    """One row per frame with a struct (x, y, vis, z) per joint, named after it."""
    cols = ["x", "y", "vis", "z", *extra]
    rec = F.struct(*[F.col(c) for c in cols])
    return pose.groupBy(*by, "frame").agg(*[F.max(F.when(F.col("joint") == j, rec)).alias(j) for j in JOINTS])


def mid(a: str, b: str, axis: str) -> Column:
    return (F.col(f"{a}.{axis}") + F.col(f"{b}.{axis}")) / 2


def visible(joint: str) -> Column:
    return F.col(f"{joint}.vis") >= VISIBLE


# ---------------------------------------------------------------- normalization

def pose_scale(frames: DataFrame, by: Sequence[str] = ("clip",), aspect: Column | None = None) -> DataFrame:
    """One constant scale per clip: the median torso height over trusted frames, else the clip's extent, else 1."""
    by = list(by)
    k = F.lit(1.0) if aspect is None else aspect
    hips = F.greatest("l_hip.vis", "r_hip.vis") >= VISIBLE
    sho = F.greatest("l_sho.vis", "r_sho.vis") >= VISIBLE
    torso = F.when(hips & sho, F.abs(mid("l_sho", "r_sho", "y") - mid("l_hip", "r_hip", "y")))
    xs, ys = [F.col(f"{j}.x") for j in JOINTS], [F.col(f"{j}.y") for j in JOINTS]
    d = frames.groupBy(*by).agg(((F.max(F.greatest(*xs)) - F.min(F.least(*xs))) * F.max(k)).alias("ex"), (F.max(F.greatest(*ys)) - F.min(F.least(*ys))).alias("ey")).join(quantiles(frames, by, {"torso": torso}), by, "left")
    return d.select(*by, F.coalesce(F.when(F.col("torso").isNotNull(), F.greatest(F.lit(1e-3), F.col("torso"))), F.greatest(F.lit(1e-3), F.col("ex"), F.col("ey")), F.lit(1.0)).alias("scale"))


def normalize_clip(pose: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(pose, root): one affine transform per clip into 0..1, and the anchor's own movement.

    `clips` has aspect (width / height). The anchor is the hip middle, or the frame's box centre where the
    hips are not trusted. Root is centred on its mean, in the same units as the pose.
    """
    by = list(by)
    f = salted_join(wide(pose, by), clips.select(*by, "aspect"), by, ["frame"])
    f = f.withColumns({j: F.struct((F.col(f"{j}.x") * F.col("aspect")).alias("x"), F.col(f"{j}.y").alias("y"), F.col(f"{j}.vis").alias("vis"), F.col(f"{j}.z").alias("z")) for j in JOINTS})
    xs, ys = [F.col(f"{j}.x") for j in JOINTS], [F.col(f"{j}.y") for j in JOINTS]
    hips = F.greatest("l_hip.vis", "r_hip.vis") >= VISIBLE
    f = f.withColumn("ax", F.when(hips, mid("l_hip", "r_hip", "x")).otherwise((F.least(*xs) + F.greatest(*xs)) / 2))
    f = checkpoint(f.withColumn("ay", F.when(hips, mid("l_hip", "r_hip", "y")).otherwise((F.least(*ys) + F.greatest(*ys)) / 2)))
    f = salted_join(f, pose_scale(f, by), by, ["frame"])
    lo = lambda v, a: F.min((F.least(*v) - F.col(a)) / F.col("scale"))
    hi = lambda v, a: F.max((F.greatest(*v) - F.col(a)) / F.col("scale"))
    box = f.groupBy(*by).agg(lo(xs, "ax").alias("x0"), hi(xs, "ax").alias("x1"), lo(ys, "ay").alias("y0"), hi(ys, "ay").alias("y1"), F.avg("ax").alias("mx"), F.avg("ay").alias("my"))
    box = box.withColumn("ext", F.greatest(F.lit(1e-6), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    d = checkpoint(salted_join(f, box, by, ["frame"]))
    root = d.select(*by, "frame", fixed((F.col("ax") - F.col("mx")) / F.col("scale") / F.col("ext"), 4).alias("dx"), fixed((F.col("ay") - F.col("my")) / F.col("scale") / F.col("ext"), 4).alias("dy"))
    padx, pady = (F.col("ext") - (F.col("x1") - F.col("x0"))) / 2, (F.col("ext") - (F.col("y1") - F.col("y0"))) / 2

    def place(j: str) -> Column:
        return F.struct(F.lit(j).alias("joint"), fixed(((F.col(f"{j}.x") - F.col("ax")) / F.col("scale") - F.col("x0") + padx) / F.col("ext"), 4).alias("x"),
                        fixed(((F.col(f"{j}.y") - F.col("ay")) / F.col("scale") - F.col("y0") + pady) / F.col("ext"), 4).alias("y"), F.round(f"{j}.vis", 3).alias("vis"),
                        fixed(F.col(f"{j}.z") / F.col("scale") / F.col("ext"), 4).alias("z"))

    out = d.select(*by, "frame", F.explode(F.array(*[place(j) for j in JOINTS])).alias("p")).select(*by, "frame", "p.*")
    return out, root


def normalize_frame(points: DataFrame, by: Sequence[str], floor: float = 1e-3) -> DataFrame:
    """Scale x and y to each frame's own box (`by` names the frame); sides under `floor` count as `floor`."""
    by = list(by)
    b = points.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    d = points.join(b, by)
    return (d.withColumn("x", fixed((F.col("x") - F.col("x0")) / F.greatest(F.lit(floor), F.col("x1") - F.col("x0")), 4))
             .withColumn("y", fixed((F.col("y") - F.col("y0")) / F.greatest(F.lit(floor), F.col("y1") - F.col("y0")), 4)).drop("x0", "x1", "y0", "y1"))


def joints22_to_pose(joints: DataFrame, by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(pose, frames): 22-joint 3-D rows (by, frame, j, x, y) as 13-joint pose, y flipped, per-frame box, vis 1.

    A frame with fewer than 22 joints becomes a gap: no pose rows, detected false.
    """
    by = list(by)
    names = F.create_map(*[x for k, v in JOINT22.items() for x in (F.lit(k), F.lit(v))])
    whole = joints.groupBy(*by, "frame").agg(F.countDistinct(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("j"))).alias("_n"))
    frames = whole.select(*by, "frame", (F.col("_n") >= 22).alias("detected"))
    good = joints.join(frames.filter("detected").select(*by, "frame"), by + ["frame"], "left_semi").filter(F.col("j").isin(*JOINT22))
    pts = good.select(*by, "frame", F.try_element_at(names, F.col("j").cast("int")).alias("joint"), "x", (-F.col("y")).alias("y"), F.lit(1.0).alias("vis"))
    return normalize_frame(pts, by + ["frame"]), frames


def fill_pose(pose: DataFrame, frames: DataFrame, by: Sequence[str] = ("clip",), k: int = GAP_FRAMES) -> DataFrame:
    """Fill missing frames of at most k in a row, joint by joint; adds flag."""
    by = list(by)
    joints = F.array(*[F.lit(j) for j in JOINTS])
    spine = frames.select(*by, "frame", F.explode(joints).alias("joint")).join(pose, by + ["frame", "joint"], "left")
    return fill_gaps(spine, by + ["joint"], ["x", "y", "vis", "z"], t="frame", k=k)


# ---------------------------------------------------------------- clip facts

def viewpoint(pose: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """front, side or unknown by majority over trusted frames; the label seen first wins a tie. Needs raw pose."""
    by = list(by)
    f = wide(pose, by)
    ok = (F.greatest("l_sho.vis", "r_sho.vis") >= VISIBLE) & (F.greatest("l_hip.vis", "r_hip.vis") >= VISIBLE)
    width = F.abs(F.col("l_sho.x") - F.col("r_sho.x"))
    ratio = width / F.greatest(F.lit(1e-3), F.abs(mid("l_sho", "r_sho", "y") - mid("l_hip", "r_hip", "y")))
    nose = F.abs(F.col("nose.x") - mid("l_sho", "r_sho", "x")) / F.greatest(width, F.lit(1e-3))
    skew = F.abs(F.col("l_sho.vis") - F.col("r_sho.vis"))
    label = F.when((ratio >= 0.45) & (F.least("l_sho.vis", "r_sho.vis") >= 0.6) & (nose <= 0.5), "front").when((ratio <= 0.25) | (skew >= 0.35) | (nose >= 0.9), "side").otherwise("unknown")
    votes = f.filter(ok).groupBy(*by, label.alias("viewpoint")).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"))
    best = votes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "first", "viewpoint")).alias("_b"))
    return pose.select(*by).distinct().join(best, by, "left").select(*by, F.coalesce("_b.viewpoint", F.lit("unknown")).alias("viewpoint"))


def skeleton_confidence(pose: DataFrame, frames: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Mean joint visibility and the share of frames with a detection."""
    by = list(by)
    v = pose.groupBy(*by).agg(F.round(F.avg("vis"), 3).alias("mean_visibility"))
    d = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected"))
    return d.join(v, by, "left").select(*by, "total", "detected", F.coalesce("mean_visibility", F.lit(0.0)).alias("mean_visibility"), F.round(F.col("detected") / F.greatest(F.lit(1), F.col("total")), 3).alias("detection_ratio"))


def subject_confidence(frames: DataFrame, pose: DataFrame, hands: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """(by, subject, confidence, confidence_of): what each kind of subject is trusted by, one row a clip.

    `frames` has subject (pose, hands or face), frame and detected; a body is trusted by its joints' mean
    visibility (`pose`: vis), hands by the mean score of which hand they are (`hands`: score, a row a hand),
    a face by the share of frames it is seen in. Clips without joints or hands get 0.
    """
    by = list(by)
    seen = frames.groupBy(*by, "subject").agg(F.avg(F.col("detected").cast("double")).alias("_seen"))
    vis = pose.groupBy(*by).agg(F.avg("vis").alias("_vis"))
    score = hands.groupBy(*by).agg(F.avg(F.round("score", 3)).alias("_score"))
    d = seen.join(vis, by, "left").join(score, by, "left")
    mean = F.when(F.col("subject") == "pose", F.col("_vis")).when(F.col("subject") == "hands", F.col("_score")).when(F.col("subject") == "face", F.col("_seen"))
    return d.select(*by, "subject", F.round(F.coalesce(mean, F.lit(0.0)), 3).alias("confidence"), dims.lookup(F.col("subject"), dims.CONFIDENCE_OF).alias("confidence_of"))


DEPTH_BONES = [("l_hip", "l_knee"), ("r_hip", "r_knee"), ("l_knee", "l_ank"), ("r_knee", "r_ank"), ("l_sho", "l_elb"), ("r_sho", "r_elb"), ("l_sho", "l_hip"), ("r_sho", "r_hip")]


def depth_scale(image: DataFrame, world: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Factor that puts image depth into the units of image y, from metric joints: a median over eight bones."""
    by = list(by)
    pair = wide(image, by).join(wide(world, by).select(*by, "frame", *[F.col(j).alias(f"w_{j}") for j in JOINTS]), by + ["frame"])
    bones = F.explode(F.array(*[F.struct(
        F.lit(i).alias("bone"), F.abs(F.col(f"{b}.y") - F.col(f"{a}.y")).alias("iy"), F.abs(F.col(f"{b}.z") - F.col(f"{a}.z")).alias("iz"),
        F.abs(F.col(f"w_{b}.y") - F.col(f"w_{a}.y")).alias("wy"), F.abs(F.col(f"w_{b}.z") - F.col(f"w_{a}.z")).alias("wz")) for i, (a, b) in enumerate(DEPTH_BONES)]))
    med = quantiles(pair.select(*by, bones.alias("b")).select(*by, "b.*"), by + ["bone"], {c: c for c in ("iy", "iz", "wy", "wz")})
    per_y = F.when((F.col("iy") >= 1e-4) & (F.col("iz") >= 1e-4), F.try_divide(F.col("wy"), F.col("iy")))
    ratio = F.when(per_y > 1e-6, F.try_divide(F.try_divide(F.col("wz"), F.col("iz")), per_y))
    out = med.groupBy(*by).agg(F.median(ratio).alias("r"))
    return image.select(*by).distinct().join(out, by, "left").select(*by, F.coalesce("r", F.lit(DEPTH_SCALE)).alias("depth_scale"))


def root_travel(root: DataFrame, frames: DataFrame, by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(held root, summary): the root track on every frame, carried over gaps, and how far it ranges; jump or dance."""
    by = list(by)
    spine = frames.select(*by, "frame").join(root, by + ["frame"], "left")
    held = hold_last(spine, by, ["dx", "dy"], t="frame")
    s = held.groupBy(*by).agg(F.round(F.max("dx") - F.min("dx"), 4).alias("x"), F.round(F.max("dy") - F.min("dy"), 4).alias("y"), (F.max("dx") - F.min("dx")).alias("_x"), (F.max("dy") - F.min("dy")).alias("_y"))
    return held, s.select(*by, "x", "y", F.when(F.col("_y") > F.col("_x"), "jump").otherwise("dance").alias("mode"))


# ---------------------------------------------------------------- gait

def gait(pose: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",), depth: bool = True) -> DataFrame:
    """Is there a walking cycle? `pose` is normalized, `clips` has fps.

    Measured on the gap between the ankles; where the picture shows none, on the depth of the ankles and
    thighs. Missing frames are dropped and time is closed up before the analysis.
    """
    by = list(by)
    f = wide(pose, by)
    f = dense_index(f, by, ["frame"], F.col("frame"), name="t")
    f = checkpoint(group_stats(f, by, [F.count(F.lit(1)).alias("n")], ["t"]).withColumn("gap", F.col("l_ank.x") - F.col("r_ank.x")))
    base = f.groupBy(*by).agg(F.max("n").alias("n"), (F.max("gap") - F.min("gap")).alias("swing"),
                              (F.max(F.col("l_ank.z") - F.col("r_ank.z")) - F.min(F.col("l_ank.z") - F.col("r_ank.z"))).alias("dswing"))
    seen = quantiles(f, by, {"_la": "l_ank.vis", "_ra": "r_ank.vis"})
    base = base.join(seen.select(*by, F.round(F.least("_la", "_ra"), 2).alias("ankle_visibility")), by, "left")
    long = f.filter(F.col("n") >= 12)
    beat = best_lag(long.select(*by, "n", "t", F.col("gap").alias("v")), by)
    d = base.join(beat, by, "left").join(clips.select(*by, "fps"), by)
    score = F.round(F.least(F.lit(1.0), F.col("swing") / GAP_MIN) * F.greatest(F.lit(0.0), F.col("corr")), 3)
    d = checkpoint(d.withColumn("score", F.when(F.col("n") < 12, 0.0).otherwise(score)))
    enough = F.col("n") >= 12
    walk = F.col("score") >= WALKABLE
    cols = {"depth_gap": "double", "depth_antiphase": "double", "depth_band_l": "double", "depth_band_r": "double", "depth_period_l": "double", "depth_period_r": "double", "depth_agreement": "double"}
    if depth:
        ask = d.filter(enough & ~walk)
        legs = long.join(ask.select(*by), by, "left_semi").select(
            *by, "n", "t", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.degrees(F.atan2(F.col(f"{s}_knee.z") - F.col(f"{s}_hip.z"), F.col(f"{s}_knee.y") - F.col(f"{s}_hip.y"))).alias("v")) for s in ("l", "r")])).alias("_s")).select(*by, "n", "t", "_s.*")
        legs = legs.filter(F.col("v").isNotNull())
        track = checkpoint(detrend_ends(unwrap_degrees(legs, by + ["side"], "v"), by + ["side"], "v"))
        pair = track.groupBy(*by, "t").agg(F.max(F.when(F.col("side") == "l", F.col("v"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("v"))).alias("r"))
        anti = pair.groupBy(*by).agg(F.covar_pop("l", "r").alias("c"), F.stddev_pop("l").alias("sl"), F.stddev_pop("r").alias("sr"))
        anti = anti.select(*by, F.when((F.col("sl") > 1e-9) & (F.col("sr") > 1e-9), F.try_divide(F.col("c"), F.col("sl") * F.col("sr"))).otherwise(0.0).alias("anti"))
        band = band_power(salted_join(track, d.select(*by, "fps"), by, ["t"]), by + ["side"], "fps")
        band = band.groupBy(*by).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("l", "r") for c in ("share", "period")])
        d = d.join(anti, by, "left").join(band, by, "left")
        agree = 1 - F.abs(F.col("period_l") - F.col("period_r")) / F.greatest(F.col("period_l"), F.col("period_r"), F.lit(1e-9))
        d = d.withColumn("agree", agree)
        admit = F.coalesce(enough & ~walk & (F.col("dswing") >= GAP_MIN) & (F.col("anti") <= ANTIPHASE_MAX) & (F.least("share_l", "share_r") >= BAND_MIN) & (F.col("agree") >= AGREE_MIN) & (F.col("ankle_visibility") >= ANKLE_VISIBLE), F.lit(False))
        got = {"depth_gap": F.round("dswing", 3), "depth_antiphase": F.round("anti", 2), "depth_band_l": F.round("share_l", 2), "depth_band_r": F.round("share_r", 2),
               "depth_period_l": F.round("period_l", 2), "depth_period_r": F.round("period_r", 2), "depth_agreement": F.round("agree", 2)}
        extra = [F.when(F.col("anti").isNotNull(), c).alias(n) for n, c in got.items()]
        both = (F.col("period_l") > 0) & (F.col("period_r") > 0)
        dscore = F.round(F.least(F.lit(1.0), F.col("dswing") / GAP_MIN) * F.abs(F.col("anti")), 3)
        dperiod = F.when(both, F.rint((F.col("period_l") + F.col("period_r")) / 2 * F.col("fps")).cast("long")).otherwise(F.lit(0).cast("long"))
    else:
        admit, extra, dscore, dperiod = F.lit(False), [F.lit(None).cast(t).alias(n) for n, t in cols.items()], F.lit(None).cast("double"), F.lit(None).cast("long")
    why = (F.when(~enough, F.concat(F.lit("only "), F.col("n"), F.lit(" frames with a body, not enough for a cycle")))
           .when(walk & ~admit, F.lit(None).cast("string")).when(admit, "walks toward or away from the camera")
           .when(F.col("ankle_visibility") < ANKLE_VISIBLE, "ankles mostly out of sight")
           .when(F.col("swing") < GAP_MIN, "feet stay together in this view")
           .otherwise("feet move without a rhythm"))
    fin = F.when(admit, dscore).otherwise(F.col("score"))
    return d.select(*by, fin.alias("score"), F.when(~enough, F.lit(0).cast("long")).when(admit, dperiod).when(F.col("score") > 0, F.col("lag")).otherwise(F.lit(0).cast("long")).alias("period"),
                    F.when(enough, F.round("swing", 3)).otherwise(0.0).alias("foot_gap"), F.when(enough, F.col("corr")).otherwise(0.0).alias("periodicity"), "ankle_visibility",
                    (admit | (enough & walk)).alias("walkable"), F.when(admit, "depth").otherwise("image").alias("stride_axis"), *extra, why.alias("note"))


# ---------------------------------------------------------------- bones and limbs

def _joint(name: str, axis: str) -> Column:
    if name == "@sho" or name == "@hip":
        l, r = ("l_sho", "r_sho") if name == "@sho" else ("l_hip", "r_hip")
        return F.least(f"{l}.vis", f"{r}.vis") if axis == "vis" else mid(l, r, axis)
    return F.col(f"{name}.{axis}")


def bones(pose: DataFrame, by: Sequence[str] = ("clip",), chords: bool = False) -> DataFrame:
    """Both ends of each limb bone per frame: (by, frame, role, length, angle, seen), lengths and angles in x-y and in z-y.

    With `chords`, also the line from each limb's root to the tip of the segment below it (role + '+').
    """
    by = list(by)
    named = dict(dims.LIMB_BONES)
    if chords:
        named.update({f"{r}+": (dims.LIMB_BONES[r][0], dims.LIMB_BONES[c][1]) for r, c in dims.LIMB_CHILD.items()})

    def bone(role: str, a: str, b: str) -> Column:
        dx, dy, dz = (_joint(b, c) - _joint(a, c) for c in ("x", "y", "z"))
        return F.struct(F.lit(role).alias("role"), F.hypot(dx, dy).alias("length"), F.atan2(dy, dx).alias("angle"), F.hypot(dz, dy).alias("length_z"), F.atan2(dy, dz).alias("angle_z"),
                        (F.least(_joint(a, "vis"), _joint(b, "vis")) >= VISIBLE).alias("seen"))

    w = wide(pose, by)
    return w.select(*by, "frame", F.explode(F.array(*[bone(r, a, b) for r, (a, b) in named.items()])).alias("b")).select(*by, "frame", "b.*")


def upper_median(df: DataFrame, by: Sequence[str], v: str, name: str) -> DataFrame:
    """The upper middle value of each group (no averaging): sorted[n // 2]."""
    return quantiles(df, by, {name: v}, upper=True)


def bone_visibility(pose: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Fraction of frames in which both ends of each bone, or chord, are seen."""
    return bones(pose, by, chords=True).groupBy(*by, "role").agg(F.avg(F.col("seen").cast("double")).alias("seen_fraction"))


def facing(pose: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Sign side of the capture: the upper median of left hip x minus right hip x over trusted frames (0 if none)."""
    by = list(by)
    w = wide(pose, by).select(*by, F.when(F.least("l_hip.vis", "r_hip.vis") >= VISIBLE, F.col("l_hip.x") - F.col("r_hip.x")).alias("dx"))
    m = upper_median(w.filter(F.col("dx").isNotNull()), by, "dx", "side")
    return w.select(*by).distinct().join(m, by, "left").select(*by, F.coalesce("side", F.lit(0.0)).alias("side"))


def bone_tracks(pose: DataFrame, limbs: DataFrame, clips: DataFrame, by: Sequence[str] = ("clip",)) -> tuple[DataFrame, DataFrame]:
    """(tracks, limbs): the swing of each drawn limb in degrees about its rest angle.

    `limbs` lists the drawn limbs (by, role, px) and `clips` may name stride_axis. A frame counts while
    both ends are seen and the bone is at least 0.6 of its median length; other frames hold the last good
    value. Swings are mirrored when capture and drawing face opposite ways, cut to the longest tail-free
    loop of both legs, and closed. Frames are the detected ones, numbered from 0.
    """
    by = list(by)
    frames = dense_index(wide(pose, by).select(*by, "frame"), by, ["frame"], F.col("frame"), name="i")
    b = bones(pose, by, chords=True).join(frames, by + ["frame"])
    vis = b.groupBy(*by, "role").agg(F.avg(F.col("seen").cast("double")).alias("_seen"))
    kids = F.create_map(*[x for r, c in dims.LIMB_CHILD.items() for x in (F.lit(r), F.lit(c))])
    drawn = limbs.select(*by, "role").distinct()
    child = drawn.select(*by, F.col("role").alias("_kid"), F.lit(True).alias("_has"))
    l = limbs.withColumn("_kid", F.try_element_at(kids, F.col("role"))).join(child, by + ["_kid"], "left")
    l = l.withColumn("_chord", F.concat("role", F.lit("+"))).join(vis.select(*by, F.col("role").alias("_chord"), "_seen"), by + ["_chord"], "left")
    l = l.withColumn("bone", F.when(F.col("_kid").isNotNull() & F.col("_has").isNull() & (F.col("_seen") >= CHORD_VISIBLE), F.col("_chord")).otherwise(F.col("role")))
    axis = clips.select(*by, F.col("stride_axis")) if "stride_axis" in clips.columns else clips.select(*by, F.lit("image").alias("stride_axis"))
    l = l.join(axis, by).withColumn("deep", (F.col("stride_axis") == "depth") & F.col("role").isin(*dims.DEPTH_ROLES)).select(*by, "role", "bone", "deep", "px")
    l = checkpoint(l)
    d = b.withColumnRenamed("role", "bone").join(l, by + ["bone"])
    d = d.withColumn("len", F.when(F.col("seen"), F.when(F.col("deep"), F.col("length_z")).otherwise(F.col("length")))).withColumn("ang", F.when(F.col("deep"), F.col("angle_z")).otherwise(F.col("angle")))
    d = checkpoint(d.select(*by, "role", "i", "len", "ang"))
    key = by + ["role"]
    med = upper_median(d.filter(F.col("len").isNotNull()), key, "len", "med")
    d = salted_join(d, med, key, ["i"], "left").withColumn("ok", F.coalesce(F.col("len") >= F.col("med") * FORESHORTEN, F.lit(False)))
    rest = d.filter("ok").groupBy(*key).agg(F.atan2(F.sum(F.sin("ang")), F.sum(F.cos("ang"))).alias("rest"), F.count(F.lit(1)).alias("usable"))
    d = salted_join(d, rest, key, ["i"], "left").withColumn("v", F.when(F.col("ok"), deg180(F.degrees(F.col("ang") - F.col("rest")))))
    side = facing(pose, by)
    art = limbs.groupBy(*by).agg(*[F.max(F.when(F.col("role") == r, F.col("px"))).alias(r) for r in ("leg-l", "leg-r", "arm-l", "arm-r")])
    legs, arms = F.coalesce(F.col("leg-l") - F.col("leg-r"), F.lit(0.0)), F.coalesce(F.col("arm-l") - F.col("arm-r"), F.lit(0.0))
    mirror = art.join(side, by).select(*by, (F.when(legs != 0, legs).otherwise(arms) * F.col("side") < 0).alias("mirror"))
    held = hold_last(d.select(*key, "i", "v"), key, ["v"], t="i")
    held = salted_join(held, mirror, by, ["i"]).withColumn("v", F.when(F.col("mirror"), -F.col("v")).otherwise(F.col("v")))
    held = checkpoint(held.select(*key, "i", "v"))
    keep = loop_trim(held, rest, by)
    cut = salted_join(held, keep, by, ["i"]).filter(F.col("i") < F.col("keep")).drop("keep")
    tracks = close_loop(cut, key, "v", t="i")
    facts = l.join(rest, key, "left").join(mirror, by).join(keep, by)
    rest_deg = F.degrees(F.coalesce("rest", F.lit(0.0)))
    return tracks, facts.select(*key, "bone", "deep", F.coalesce("usable", F.lit(0).cast("long")).alias("usable"), F.when(F.col("mirror"), deg180(180 - rest_deg)).otherwise(rest_deg).alias("rest_deg"), "mirror", "keep")


def loop_trim(tracks: DataFrame, usable: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """(by, keep): the longest n >= max(4, round(.55 N)) at which both legs end within .15 of their range of their start."""
    by = list(by)
    n = tracks.groupBy(*by).agg((F.max("i") + 1).alias("N"))
    legs = tracks.filter(F.col("role").isin("leg-l", "leg-r")).join(usable.select(*by, "role"), by + ["role"], "left_semi")
    s = legs.groupBy(*by, "role").agg(F.min_by("v", "i").alias("v0"), (F.max("v") - F.min("v")).alias("rng"))
    pair = s.groupBy(*by).agg(F.count(F.lit(1)).alias("pair"), F.min("rng").alias("least"))
    end = salted_join(legs, s, by + ["role"], ["i"]).withColumn("fits", F.abs(F.col("v") - F.col("v0")) <= F.col("rng") * LOOP_SEAM)
    both = end.groupBy(*by, "i").agg(F.count_if("fits").alias("fit")).filter("fit = 2")
    cand = salted_join(both, n.join(pair, by).filter("pair = 2 AND least > 0"), by, ["i"])
    cand = cand.filter(F.col("i") + 1 >= F.greatest(F.lit(4), F.floor(F.col("N") * LOOP_KEEP + 0.5)))
    best = cand.groupBy(*by).agg((F.max("i") + 1).alias("keep"))
    return n.join(best, by, "left").select(*by, F.coalesce("keep", "N").alias("keep"))


def body_channels(pose: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Lean and squash of the body per frame: shoulder tilt folded to +-90 about its median, torso length over its median minus 1."""
    by = list(by)
    w = wide(pose, by)
    sho = F.least("l_sho.vis", "r_sho.vis") >= VISIBLE
    a = F.degrees(F.atan2(F.col("r_sho.y") - F.col("l_sho.y"), F.col("r_sho.x") - F.col("l_sho.x")))
    tilt = F.when(sho, F.pmod(a + 90, F.lit(180.0)) - 90)
    torso = F.when(F.least("l_sho.vis", "r_sho.vis", "l_hip.vis", "r_hip.vis") >= VISIBLE, F.hypot(mid("l_sho", "r_sho", "x") - mid("l_hip", "r_hip", "x"), mid("l_sho", "r_sho", "y") - mid("l_hip", "r_hip", "y")))
    d = checkpoint(w.select(*by, "frame", tilt.alias("tilt"), torso.alias("torso")))
    mt = upper_median(d.filter("tilt IS NOT NULL"), by, "tilt", "mt")
    ms = upper_median(d.filter("torso IS NOT NULL"), by, "torso", "ms")
    meds = d.select(*by).distinct().join(mt, by, "left").join(ms, by, "left")
    d = salted_join(d, meds, by, ["frame"])
    d = d.select(*by, "frame", (F.col("tilt") - F.col("mt")).alias("tilt"), F.when(F.col("ms") != 0, F.col("torso") / F.col("ms") - 1).alias("squash"))
    t = hold_last(d, by, ["tilt"], t="frame")
    return hold_last(t, by, ["squash"], t="frame")


def wrist_height(pose: DataFrame, by: Sequence[str] = ("clip",)) -> DataFrame:
    """Mean wrist height above the shoulders in torso lengths, stretched to -1..1 over the clip."""
    by = list(by)
    w = wide(pose, by)
    up = (mid("l_sho", "r_sho", "y") - mid("l_wri", "r_wri", "y")) / F.greatest(F.lit(1e-3), F.abs(mid("l_sho", "r_sho", "y") - mid("l_hip", "r_hip", "y")))
    d = group_stats(w.select(*by, "frame", up.alias("v")), by, [F.min("v").alias("lo"), F.max("v").alias("hi")], ["frame"])
    return d.select(*by, "frame", ((F.col("v") - F.col("lo")) / F.greatest(F.lit(1e-3), F.col("hi") - F.col("lo")) * 2 - 1).alias("up"))
