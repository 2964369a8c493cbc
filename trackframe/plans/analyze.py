"""The whole texture job over many clips: mask, dials, tracks, regions, path, swatches, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe import dims
from trackframe.operators import contracts as ct
from trackframe.operators import flow as fl
from trackframe.operators import paths as pt
from trackframe.operators import regions as rg
from trackframe.session import checkpoint
from trackframe.sources.documents import nest_tracks


#: The tables of a run; those of the path come along where there are detections.
TABLES = ("params", "gate", "tracks", "regions", "swatches", "notes")


def analyze_batch(flow: DataFrame, clips: DataFrame, mask: DataFrame | None = None, detections: DataFrame | None = None, px: Sequence[str] = ("y", "x"),
                  files: DataFrame | None = None, profiles: DataFrame | None = None, want: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """Tables of one analysis run, all keyed by clip. Some steps are written as they are built, so a run that
    wants some tables only names them: regions need nothing of the others, and nothing else needs them.

    `flow` (clip, t, y, x, vx, vy); `clips` has fps, width, height, grid, frames, class, engine. A mask too
    thin to measure falls back to the whole clip; a mask that covers under a fifth of every cell leaves the
    tracks free; every fallback is a row in `notes`. Regions are always found without the mask, the path on
    uncropped detections.
    """
    cells = fl.to_cells(flow, clips)
    out = {}
    if "regions" in want:
        ch, cw = F.floor(F.col("height") / F.col("grid")), F.floor(F.col("width") / F.col("grid"))
        pix = fl.salted_join(flow, clips.select("clip", "width", "height", "grid"), ["clip"], list(px))
        pix = pix.withColumn("gy", F.floor(F.col("y") / ch)).withColumn("gx", F.floor(F.col("x") / cw)).filter((F.col("gy") < F.col("grid")) & (F.col("gx") < F.col("grid"))).drop("width", "height", "grid")
        out["regions"] = rg.segment_regions(pix, cells, clips, px=px, files=files, profiles=profiles)
        if set(want) == {"regions"}:
            return out
    notes = []
    whole = clips.select("clip", "fps", "width")
    if mask is not None:
        cut = fl.restrict_to_mask(flow, mask, ("clip",), px)
        dials = checkpoint(fl.distill(cut, whole, px=px))
        thin = checkpoint(mask.select("clip", *px).distinct().groupBy("clip").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < fl.MIN_PIXELS).select("clip"))
        notes.append(thin.select("clip", F.lit("object mask covers <4 px of the analyzed region; used the whole region").alias("note")))
        cover = fl.cell_coverage(mask, clips)
        kept = cover.groupBy("clip").agg(F.count_if("keep").alias("kept"))
        masked = mask.select("clip").distinct().join(thin, "clip", "left_anti")
        gate = clips.select("clip").join(masked.withColumn("_m", F.lit(True)), "clip", "left").join(kept, "clip", "left")
        gate = checkpoint(gate.select("clip", F.coalesce("_m", F.lit(False)).alias("masked"), F.when(F.col("_m") & (F.col("kept") > 0), F.col("kept")).alias("cells_tracked")))
        notes.append(gate.filter("masked AND cells_tracked IS NULL").select("clip", F.lit("object mask covers <20% of every grid cell; the trajectory field was left unmasked").alias("note")))
        keep = cover.join(gate.filter("cells_tracked IS NOT NULL").select("clip"), "clip", "left_semi")
        free = cover.join(gate.filter("cells_tracked IS NULL").select("clip"), "clip", "left_semi").withColumn("keep", F.lit(True))
        keep = keep.unionByName(free)
    else:
        dials, keep = checkpoint(fl.distill(flow, whole, px=px)), None
        gate = clips.select("clip", F.lit(False).alias("masked"), F.lit(None).cast("long").alias("cells_tracked"))
    short = clips.select("clip").join(dials.select("clip"), "clip", "left_anti")
    notes.append(short.select("clip", F.lit("not enough motion data").alias("note")))
    tracks = fl.grid_tracks(cells, clips, keep=keep)
    meta = clips.select("clip", "fps", F.coalesce("class", F.lit("")).alias("class"), "engine")
    thinned = ct.thin_tracks(tracks.join(dials.select("clip"), "clip", "left_semi"))
    doc = nest_tracks(thinned).join(meta, "clip").join(dials, "clip")
    doc = doc.select("clip", F.map_from_arrays(F.array(*[F.lit(k) for k in dims.PARAM_KEYS]), F.array(*[F.col(k) for k in dims.PARAM_KEYS])).alias("params"), "tracks", "track_stride",
                     (F.col("fps") / F.col("track_stride")).alias("fps"), "class", F.concat("engine", F.lit("+grid")).alias("engine"), F.array().cast("array<string>").alias("warnings"))
    swatches = ct.texture_swatch(doc, ["clip"])
    points = summary = None
    if detections is not None:
        track = checkpoint(pt.longest_track(detections))
        label = track.groupBy("clip").agg(F.min_by("label", "t").alias("label"))
        points, summary = pt.build_path(track, clips.select("clip", "fps", F.col("frames").alias("total_frames")).join(label, "clip"))
        summary = checkpoint(summary)
        notes.append(summary.select("clip", F.explode("warnings").alias("note")))
        notes.append(clips.select("clip").join(detections.select("clip").distinct(), "clip", "left_anti").select("clip", F.lit("no object was detected and tracked, so there is no travel path").alias("note")))
        # a path is at most one point per frame of its clip
        pts = points.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("t").cast("double").alias("t"), "dx", "dy"))), lambda p: F.array(p.getField("t"), p.getField("dx"), p.getField("dy"))).alias("points"))
        body = summary.join(pts, "clip").join(meta.select("clip", "class", "engine"), "clip")
        travel = F.create_map(*[x for k in ("dx", "dy", "span_x", "span_y", "dist", "straightness") for x in (F.lit(k), F.col(k))])
        body = body.select("clip", F.struct("label", "points", travel.alias("travel")).alias("path"), "fps", "confidence", F.when(F.col("class") == "", "rigid_path").otherwise(F.col("class")).alias("class"), "engine", "warnings")
        swatches = swatches.unionByName(ct.path_swatch(body, ["clip"]))
    swatches = ct.validate_swatch(swatches)
    notes.append(swatches.filter("NOT ok").select("clip", F.concat("kind", F.lit(" swatch failed validation: "), F.array_join("errors", "; ")).alias("note")))
    all_notes = notes[0]
    for n in notes[1:]:
        all_notes = all_notes.unionByName(n)
    out.update(params=dials, gate=gate, tracks=tracks, swatches=swatches, notes=all_notes)
    if points is not None:
        out.update(path_points=points, path_summary=summary)
    return out
