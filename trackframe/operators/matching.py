"""Lookups, routing and matching: classes, engines, swatches to layers, truth scoring, layer trees, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe import dims
from trackframe.functions.scalar import fixed
from trackframe.operators.series import salted_join, sorted_index, top_k
from trackframe.session import checkpoint


def classify_lookup(motions: DataFrame, cls: str = "class") -> DataFrame:
    """Adds backend, applicator and deforms from the class; constants, so no join at all."""
    c = F.col(cls)
    return (motions.withColumn("backend", dims.backend_of(c)).withColumn("applicator", dims.applicator_of(c))
            .withColumn("deforms", F.when(c.isin(*dims.MESH_CLASSES), "mesh").otherwise("rigid")))


def resolve_engine(requests: DataFrame, engines: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """Adds engine and reason: the named engine, or its kind's default when unknown or unavailable.

    `engines` (name, kind, is_default, available, reason) is a registry of a few dozen rows.
    """
    e = engines.select(F.col("name").alias(name), F.col("kind").alias(kind), F.col("available").alias("_av"), F.col("reason").alias("_why"))
    default = engines.filter("is_default").groupBy(F.col("kind").alias(kind)).agg(F.min("name").alias("_default"))
    d = requests.join(e, [name, kind], "left").join(default, kind, "left")
    asked = F.coalesce(F.col(name), F.lit("")) != ""
    reason = (F.when(~asked, F.lit(None).cast("string"))
              .when(F.col("_av").isNull(), F.concat(F.lit("'"), F.col(name), F.lit("' is not a registered "), F.col(kind), F.lit(" engine")))
              .when(~F.col("_av"), F.concat(F.col(name), F.lit(" unavailable ("), F.col("_why"), F.lit(")"))))
    return d.withColumn("engine", F.when(asked & F.coalesce(F.col("_av"), F.lit(False)), F.col(name)).otherwise(F.col("_default"))) \
            .withColumn("fallback", reason).drop("_av", "_why", "_default")


def resolve_route(requests: DataFrame, engines: DataFrame) -> DataFrame:
    """Adds engine, reason and usable for requests (class, subject_type, count, has_text_prompt).

    The rules of a class and the state of their engines become one array per class. Each request
    then picks its first matching rule and that rule's first available engine inside its own row. A
    rule none of whose engines is registered still matches, and ends on its class's floor; where that is not
    available either, `usable` is false and the reason says why.
    """
    spark = requests.sparkSession
    rules = dims.route_rules(spark).withColumn("floor", dims.lookup(F.col("class"), dims.CLASS_FLOOR))
    state = engines.select(F.col("name").alias("_e"), F.struct(F.col("name").alias("name"), "available", "reason").alias("st"))
    exploded = rules.select("class", "rule_no", "subject_type", "count", "has_text_prompt", "floor", F.posexplode("engines").alias("pos", "_e"))
    there = F.when(F.col("st").isNotNull(), F.struct("pos", "st"))
    listed = exploded.join(state, "_e", "left").groupBy("class", "rule_no", "subject_type", "count", "has_text_prompt", "floor").agg(
        F.transform(F.array_sort(F.collect_list(there)), lambda x: x.getField("st")).alias("engines"))
    per_class = listed.groupBy("class").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", "subject_type", "count", "has_text_prompt", "engines"))).alias("_rules"), F.max("floor").alias("_floor"))
    # the floor is probed like any other engine: it may be out of reach too
    per_class = per_class.join(state.select(F.col("_e").alias("_floor"), F.col("st").alias("_floor_state")), "_floor", "left")
    # six classes, thirteen rules: a fixed table
    d = requests.join(F.broadcast(per_class), "class", "left")

    def fits(rule: Column) -> Column:
        return reduce(lambda a, b: a & b, [rule.getField(k).isNull() | F.coalesce(rule.getField(k) == F.col(k), F.lit(False)) for k in ("subject_type", "count", "has_text_prompt")])

    d = d.withColumn("_list", F.get(F.filter("_rules", fits), F.lit(0)).getField("engines"))
    d = d.withColumn("_hit", F.get(F.filter("_list", lambda e: e.getField("available")), F.lit(0)).getField("name"))
    upto = F.when(F.col("_hit").isNull(), F.col("_list")).otherwise(F.slice("_list", 1, F.array_position(F.transform("_list", lambda e: e.getField("name")), F.col("_hit")).cast("int") - 1 + F.lit(0)))
    tried = F.transform(upto, lambda e: F.concat(e.getField("name"), F.lit(": "), e.getField("reason")))
    text = F.when(F.col("_hit").isNotNull(), F.when(F.size(tried) > 0, F.concat(F.lit("skipped "), F.array_join(tried, ", "))).otherwise("first choice")) \
            .otherwise(F.concat(F.lit("none available ("), F.array_join(F.coalesce(tried, F.array().cast("array<string>")), "; "), F.lit(")")))
    usable = F.when(F.col("_hit").isNull(), F.coalesce(F.col("_floor_state.available"), F.lit(False))).otherwise(True)
    why = F.when(~usable, F.concat(F.lit("; floor not usable ("), F.coalesce(F.col("_floor_state.reason"), F.lit("not registered")), F.lit(")")))
    out = d.withColumn("engine", F.coalesce("_hit", "_floor", F.lit("raft_small"))).withColumn("reason", F.concat(text, F.coalesce(why, F.lit("")))).withColumn("usable", usable)
    return out.drop("_rules", "_floor", "_floor_state", "_list", "_hit")


def match_to_layers(swatches: DataFrame, labels: DataFrame, by: Sequence[str] = (), least: float = dims.CONFIDENCE_MIN) -> tuple[DataFrame, DataFrame]:
    """(pairs, unmatched): the k-th swatch of a class takes the class's k-th most confident label.

    Equal to taking the best free label swatch by swatch, because classes do not compete. The ranks
    come from a range-partitioned numbering, so a class holding most rows is not one task's work.
    """
    by = list(by)
    sw = sorted_index(swatches.filter(F.coalesce(F.col("class"), F.lit("")) != ""), by + ["class"], [F.col("idx")], "rn")
    lb = labels.filter((F.coalesce(F.col("class"), F.lit("")) != "") & (F.col("confidence") >= least))
    lb = sorted_index(lb, by + ["class"], [F.col("confidence").desc(), F.col("pos")], "rn")
    pairs = sw.join(lb.select(*by, "class", "rn", "id", "confidence"), by + ["class", "rn"]).select(*by, "idx", "class", "id", "confidence")
    unmatched = swatches.select(*by, "idx", "class").join(pairs.select(*by, "idx"), by + ["idx"], "left_anti")
    return pairs, unmatched


def score(params: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """Checks of measured dials against known truth: one row per (on, check) with passed.

    Truth columns may be null: frequency, direction, phase_spread and turbulence (low / high), amplitude (zero).
    """
    t = truth.select(*on, *[F.col(c).alias(f"t_{c}") for c in ("frequency", "direction", "phase_spread", "turbulence", "amplitude")])
    d = params.join(t, list(on))
    err = F.try_divide(F.abs(F.col("frequency") - F.col("t_frequency")), F.col("t_frequency"))
    off = F.abs(F.pmod(F.col("direction") - F.col("t_direction") + 90, F.lit(180.0)) - 90)
    checks = F.array_compact(F.array(
        *[F.when(on_, F.struct(F.lit(n).alias("check"), ok.alias("passed"))) for n, on_, ok in [
            ("frequency", F.col("t_frequency").isNotNull(), err < 0.10), ("direction", F.col("t_direction").isNotNull(), off <= 8),
            ("phaseSpread low", F.col("t_phase_spread") == "low", F.col("phaseSpread") < 0.25), ("phaseSpread high", F.col("t_phase_spread") == "high", F.col("phaseSpread") > 0.5),
            ("turbulence low", F.col("t_turbulence") == "low", F.col("turbulence") < 0.35), ("turbulence high", F.col("t_turbulence") == "high", F.col("turbulence") > 0.5),
            ("amplitude zero", F.col("t_amplitude") == "zero", F.col("amplitude") < 0.05)]]))
    rest = [c for c in params.columns if c not in dims.PARAM_KEYS]
    return d.select(*rest, F.explode(checks).alias("_c")).select(*rest, "_c.check", "_c.passed")


def quality_report(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Passed and total checks per configuration, with a rollup total."""
    return scored.rollup(*by).agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


#: Levels of the pyramid of cells, levels a round goes down, candidates that end the search of a cell.
LEVELS, DOWN, FEW = 50, 2, 48


def nearest(a: DataFrame, b: DataFrame, by: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """Nearest b (b_id, bx, by_) to each a (a_id, ax, ay) within a group; the lowest id on ties.

    A pyramid of occupied cells is searched from the top, for all cells of a at once: a cell keeps the cells
    of b that may hold the nearest point of one of its points, which are those whose least distance is not
    above the smallest largest distance met. Kept pairs go down two levels at a time until a cell of a has
    at most `FEW` points of b left; points meet points only there. Bounds come from the boxes of the points
    in a cell, so far, crowded and repeated points cost no more than others. A point with a null, NaN or
    infinite coordinate is near nothing and nothing is near it: it comes out with a null partner.
    """
    by = list(by)

    def real(*cols: str) -> Column:
        return reduce(lambda p, q: p & q, [F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)) for c in map(F.col, cols)])

    b = b.filter(real("bx", "by_"))
    kind = dict(b.dtypes)[b_id]
    met = a.join(b.select(*by).distinct(), by, "left_semi").select(*by, a_id, F.col("ax").cast("double").alias("ax"), F.col("ay").cast("double").alias("ay"))
    lost = met.filter(~real("ax", "ay")).select(*by, a_id, F.lit(None).cast(kind).alias(b_id), F.lit(None).cast("double").alias("distance"))
    here = met.filter(real("ax", "ay")).withColumnsRenamed({"ax": "x", "ay": "y"})
    there = b.groupBy(*by, F.col("bx").cast("double").alias("x"), F.col("by_").cast("double").alias("y")).agg(F.min(b_id).alias(b_id))
    box = [f(c).alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in "xy"]
    whole = here.groupBy(*by).agg(*box).union(there.groupBy(*by).agg(*box)).groupBy(*by).agg(F.min("lx").alias("lx"), F.min("ly").alias("ly"), F.max("hx").alias("hx"), F.max("hy").alias("hy"))
    side = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"))

    def grid(points: DataFrame, spread: Sequence[str]) -> DataFrame:
        d = salted_join(points, whole.select(*by, "lx", "ly", side.alias("side")), by, spread)
        at = {f"g{c}": F.when(F.col("side") > 0, F.least(F.floor((F.col(c) - F.col(f"l{c}")) / F.col("side") * float(1 << LEVELS)), F.lit((1 << LEVELS) - 1))).otherwise(0).cast("long") for c in "xy"}
        return checkpoint(d.withColumns(at).drop("lx", "ly", "side"))

    here, there = grid(here, [a_id]), grid(there, ["x", "y"])

    def cell(c: str, level: int) -> Column:
        return F.shiftright(F.col(c), LEVELS - level)

    def cells(points: DataFrame, side: str, level: int, of: DataFrame | None) -> DataFrame:
        """Occupied cells of a level with the box and number of their points, below the cells `of` the level before."""
        if of is not None:
            up = points.withColumns({f"{side}px": cell("gx", level - DOWN), f"{side}py": cell("gy", level - DOWN)})
            points = up.join(of, [*by, f"{side}px", f"{side}py"], "left_semi")
        return points.groupBy(*by, cell("gx", level).alias(f"{side}x"), cell("gy", level).alias(f"{side}y")).agg(
            *[f(c).alias(f"{side}{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in "xy"], F.count(F.lit(1)).alias(f"{side}n"))

    def gap(c: str) -> tuple[Column, Column]:
        before, after = F.col(f"bl{c}") - F.col(f"ah{c}"), F.col(f"al{c}") - F.col(f"bh{c}")
        return F.greatest(F.lit(0.0), before, after), F.greatest(-before, -after)

    (near_x, far_x), (near_y, far_y) = gap("x"), gap("y")
    pair, mine = [*by, "ax", "ay", "bx", "by"], W.partitionBy(*by, "ax", "ay")
    level, ended = DOWN, []
    # sixteen cells a side to begin with
    pairs = cells(here, "a", level, None).join(cells(there, "b", level, None), by)
    while True:
        # far_* belongs to the corners farthest apart; a hair is left for rounding
        pairs = pairs.withColumn("lo", near_x * near_x + near_y * near_y).withColumn("hi", far_x * far_x + far_y * far_y)
        if "cap" in pairs.columns:  # nothing below a cell is worse off than the cell itself
            pairs = pairs.filter(F.col("lo") <= F.col("cap"))
        pairs = pairs.withColumn("cap", F.min("hi").over(mine) * (1 + 1e-9)).filter(F.col("lo") <= F.col("cap"))
        pairs = checkpoint(pairs.withColumn("left", F.sum("bn").over(mine)).select(*pair, "cap", "left"))
        over = F.lit(level >= LEVELS) | (F.col("left") <= FEW)
        ended.append((level, pairs.filter(over).select(*pair)))
        rest = pairs.filter(~over).select(*[F.col(c).alias(f"{c[0]}p{c[1]}") if c in ("ax", "ay", "bx", "by") else F.col(c) for c in pair], "cap")
        if level >= LEVELS or rest.isEmpty():
            break
        level += DOWN
        below = {s: cells(p, s, level, rest.select(*by, f"{s}px", f"{s}py").distinct()).withColumns({f"{s}p{c}": F.shiftright(f"{s}{c}", DOWN) for c in "xy"}) for s, p in (("a", here), ("b", there))}
        pairs = rest.join(below["a"], [*by, "apx", "apy"]).join(below["b"], [*by, "bpx", "bpy"])

    ended = [(k, d) for k, d in ended if not d.isEmpty()]
    if not ended:
        return lost
    spot = F.struct("x", "y", b_id)

    def leaf(points: DataFrame, side: str, levels: Sequence[int], *cols: str | Column) -> DataFrame:
        at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), cell("gx", k).alias(f"{side}x"), cell("gy", k).alias(f"{side}y")) for k in levels]))
        return points.withColumn("_at", at).select(*by, "_at.*", *cols)

    levels = [k for k, _ in ended]
    last = reduce(DataFrame.union, [d.withColumn("level", F.lit(k)) for k, d in ended])
    left = last.join(leaf(there, "b", levels, spot.alias("spot")), [*by, "level", "bx", "by"])
    own = leaf(here, "a", levels, a_id, F.col("x").alias("px"), F.col("y").alias("py"))
    d2 = lambda s: F.pow(F.col("px") - s.getField("x"), 2) + F.pow(F.col("py") - s.getField("y"), 2)
    rank = lambda s: F.struct(d2(s).alias("d2"), s.getField(b_id).alias("id"))
    few = left.filter(F.col("level") < LEVELS).groupBy(*by, "level", "ax", "ay").agg(F.collect_list("spot").alias("spots"))
    found = own.join(few, [*by, "level", "ax", "ay"]).select(*by, a_id, F.array_min(F.transform("spots", rank)).alias("b"))
    if levels[-1] == LEVELS:  # points of b as far as another, however many: they stay rows
        many = own.filter(F.col("level") == LEVELS).join(left.filter(F.col("level") == LEVELS), [*by, "level", "ax", "ay"])
        found = found.union(many.groupBy(*by, a_id, "px", "py").agg(F.min(rank(F.col("spot"))).alias("b")).select(*by, a_id, "b"))
    return lost.union(found.select(*by, a_id, F.col("b.id").alias(b_id), F.sqrt("b.d2").alias("distance")))


# ---------------------------------------------------------------- layer trees

def _nodes(layers: DataFrame, by: list[str], limbs: DataFrame | None = None) -> DataFrame:
    """One row for each layer and each parent, from one grouping: (by, id, low, high, inner, there, named, limb).

    low and high are the first and last of its parents by name, inner says that it is a parent, there that it
    has a row of its own. The parents' marks are summed up before they are passed on, however many children there are."""
    named = F.coalesce(F.col("name"), F.lit("")) != "" if "name" in layers.columns else F.lit(False)
    yes, no = F.lit(True), F.lit(False)
    own = F.struct("id", "parent", no.alias("inner"), yes.alias("there"), named.alias("named"), no.alias("limb"))
    mark = F.struct(F.col("parent").alias("id"), F.lit(None).cast(layers.schema["parent"].dataType).alias("parent"), yes.alias("inner"), no.alias("there"), no.alias("named"), no.alias("limb"))
    rows = layers.select(*by, F.explode(F.when(F.col("parent").isNull(), F.array(own)).otherwise(F.array(own, mark))).alias("_n")).select(*by, "_n.*")
    if limbs is not None:
        rows = rows.unionByName(limbs.select(*by, "id", yes.alias("limb")), allowMissingColumns=True)
    flags = [F.coalesce(F.max(c), no).alias(c) for c in ("inner", "there", "named", "limb")]
    return checkpoint(rows.groupBy(*by, "id").agg(F.min("parent").alias("low"), F.max("parent").alias("high"), *flags))


def _steps_up(layers: DataFrame, nodes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What leads up from the layers: (by, id, parent, inner) of those with one parent, (by, id, ancestor, depth) of
    all that are parents, and (by, id, parent, inner) of those with several parents, if there are any."""
    one = nodes.filter("low = high").select(*by, "id", F.col("low").alias("parent"), "inner")
    many = nodes.filter("low <> high")
    several = None
    links = one.filter("inner")
    if not many.isEmpty():
        key = [F.col(f"l.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*by, "id")]
        found = layers.filter(F.col("parent").isNotNull()).alias("l").join(many.alias("m"), key)
        several = checkpoint(found.select(*[f"l.{c}" for c in (*by, "id", "parent")], "m.inner").distinct())
        links = links.unionByName(several.filter("inner"))
    return one, _closure(links.select(*by, "id", F.col("parent").alias("ancestor")), by), several


def _closure(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, ancestor, depth) of (by, id, ancestor): the known steps are doubled until nothing new is reached."""
    out = checkpoint(links.withColumn("depth", F.lit(1).cast("long")))
    n = out.count()
    while n:
        step = out.select(*by, F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        further = out.join(step, by + ["ancestor"]).select(*by, "id", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        out = checkpoint(out.unionByName(further).groupBy(*by, "id", "ancestor").agg(F.min("depth").alias("depth")))
        before, n = n, out.count()
        if n == before:
            break
    return out


def _through(links: DataFrame, inner: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, ancestor, depth) of layers by their parents: the parent itself, and what the parent leads to."""
    above = inner.filter("ancestor <> id").select(*by, F.col("id").alias("parent"), "ancestor", (F.col("depth") + 1).alias("depth"))
    first = links.select(*by, "id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    return first.unionByName(links.join(above, by + ["parent"]).select(*by, "id", "ancestor", "depth"))


def ancestors(layers: DataFrame, by: Sequence[str] = ("art",)) -> DataFrame:
    """(by, id, ancestor, depth) of an adjacency list (by, id, parent); depth 1 is the parent.

    The steps between layers that have children are doubled until nothing new is reached, so a chain of any
    depth takes about as many joins as the logarithm of its length. Layers without children, most of a
    tree, are joined once with what their parents lead to. On a cycle every layer is met once, at its least depth.
    """
    by = list(by)
    one, inner, several = _steps_up(layers, _nodes(layers, by), by)
    out = inner.unionByName(_through(one.filter("not inner"), inner, by))
    if several is None:
        return out
    return out.unionByName(_through(several.filter("not inner"), inner, by).groupBy(*by, "id", "ancestor").agg(F.min("depth").alias("depth")))


def figure_of(limbs: DataFrame, layers: DataFrame, by: Sequence[str] = ("art",)) -> DataFrame:
    """The figure each limb belongs to: the nearest named ancestor that holds another limb, else the nearest
    unnamed one that does, else the nearest named ancestor. `layers` has name, '' when unnamed.

    Limbs below one parent share their ancestors, so limbs are counted and figures chosen for parents; only
    limbs with several parents meet their ancestors as rows."""
    by = list(by)
    nodes = _nodes(layers, by, limbs)
    one, inner, several = _steps_up(layers, nodes, by)
    single = nodes.filter("limb and low = high").select(*by, "id", F.col("low").alias("parent"))
    counts = checkpoint(single.groupBy(*by, "parent").agg(F.count(F.lit(1)).alias("held")))
    reach = checkpoint(_through(counts.select(*by, F.col("parent").alias("id"), "parent"), inner, by))
    held = reach.join(counts.withColumnRenamed("parent", "id"), by + ["id"]).select(*by, "ancestor", "held")
    up = None
    if several is not None:
        up = _through(several, inner, by).groupBy(*by, "id", "ancestor").agg(F.min("depth").alias("depth"))
        up = checkpoint(up.join(nodes.filter("limb and low <> high").select(*by, "id"), by + ["id"], "left_semi"))
        held = held.unionByName(up.select(*by, "ancestor", F.lit(1).cast("long").alias("held")))
    held = held.groupBy(*by, "ancestor").agg(F.sum("held").alias("held"))
    tier = F.when((F.col("held") > 1) & F.col("named"), 0).when(F.col("held") > 1, 1).when(F.col("named"), 2)
    ranked = checkpoint(held.join(nodes.filter("there and inner").select(*by, F.col("id").alias("ancestor"), "named"), by + ["ancestor"]).select(*by, "ancestor", tier.cast("long").alias("tier")).filter("tier is not null"))

    def best(d: DataFrame) -> DataFrame:
        return d.join(ranked, by + ["ancestor"]).groupBy(*by, "id").agg(F.min(F.struct("tier", "depth", F.col("ancestor").alias("figure"))).alias("_b")).select(*by, "id", "_b.figure", "_b.tier")

    out = single.join(best(reach).withColumnRenamed("id", "parent"), by + ["parent"]).select(*by, "id", "figure", "tier")
    return out if up is None else out.unionByName(best(up))


def layer_cover(layers: DataFrame, by: Sequence[str] = ("art",), max_cover: float = 0.9, max_depth: int = 3, cap: int = dims.MAX_LAYERS) -> DataFrame:
    """The layers worth labelling, in order: covering groups are opened (up to three levels), covering leaves dropped.

    `layers` has id, parent, pos (order among siblings, any number), name, w, h normalized. The first
    `cap` are kept as L1, L2, ..; the order is that of walking the tree. What is left out comes from
    `layer_cover_rest`.
    """
    walked = _walked(layers, by, max_cover, max_depth)
    ranked = top_k(walked.filter("why is null").drop("why"), list(by), [F.col("path"), F.col("id")], cap)
    return ranked.select(*by, F.concat(F.lit("L"), F.col("rank")).alias("label_id"), "rank", "id", "name")


def layer_cover_rest(layers: DataFrame, by: Sequence[str] = ("art",), max_cover: float = 0.9, max_depth: int = 3, cap: int = dims.MAX_LAYERS) -> DataFrame:
    """(by, id, name, why) of the layers met in the walk but not labelled: 'covers the canvas' or 'over the cap'."""
    by = list(by)
    walked = _walked(layers, by, max_cover, max_depth)
    shown = layer_cover(layers, by, max_cover, max_depth, cap).select(*by, "id")
    rest = walked.join(shown, by + ["id"], "left_anti")
    return rest.select(*by, "id", "name", F.coalesce("why", F.lit("over the cap")).alias("why"))


def _walked(layers: DataFrame, by: Sequence[str], max_cover: float, max_depth: int) -> DataFrame:
    """(by, id, name, path, why): layers in the order of the walk, why they are not to be labelled or null."""
    by = list(by)
    kids = layers.filter(F.col("parent").isNotNull()).select(*by, F.col("parent").alias("id")).distinct().withColumn("has_kids", F.lit(True))
    full = layers.join(kids, by + ["id"], "left").withColumn("cover", F.col("w") * F.col("h")).withColumn("has_kids", F.coalesce("has_kids", F.lit(False)))
    full = checkpoint(full.withColumn("big", F.col("cover") > max_cover))
    key = F.array("pos")
    level = full.filter(F.col("parent").isNull()).withColumn("path", key)
    out = None
    for depth in range(max_depth + 1):
        why = F.when(F.col("big"), "covers the canvas")
        found = level.filter(~F.col("big") | ~F.col("has_kids") | F.lit(depth == max_depth)).select(*by, "id", "name", "path", why.alias("why"))
        out = found if out is None else out.unionByName(found)
        if depth == max_depth:
            break
        opened = level.filter(F.col("big") & F.col("has_kids")).select(*by, F.col("id").alias("parent"), F.col("path").alias("_up"))
        level = full.join(opened, by + ["parent"]).withColumn("path", F.concat("_up", key)).drop("_up")
    return out


def limb_chain(limbs: DataFrame, by: Sequence[str] = ("figure",)) -> DataFrame:
    """Ancestors of each limb present on the same figure: (by, role, ancestor, depth). Untagged ones are skipped.

    The parent table is fixed and two deep, so the chain is a constant array per role.
    """
    by = list(by)

    def up(role: str) -> list[str]:
        chain = []
        while role in dims.LIMB_PARENT:
            role = dims.LIMB_PARENT[role]
            chain.append(role)
        return chain

    chain = F.create_map(*[x for r in dims.LIMB_BONES for x in (F.lit(r), F.array(*[F.lit(a) for a in up(r)]).cast("array<string>"))])
    d = limbs.select(*by, "role", F.posexplode(F.try_element_at(chain, F.col("role"))).alias("p", "ancestor"))
    return d.join(limbs.select(*by, F.col("role").alias("ancestor")), by + ["ancestor"], "left_semi").select(*by, "role", "ancestor", (F.col("p") + 1).cast("long").alias("depth"))
