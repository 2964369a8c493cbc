"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Fixed formats give the seeds. The words before a seed are lexical patterns; patterns and the
identifier-like tokens that they precede form a graph, on which both are scored in turn over the whole
corpus: a pattern by the share of its distinct tokens that are personal data, a token by its patterns.
Tokens with digits that only blanks part are looked at alone and together, as identifiers are written with
blanks too. What stands after a pattern of high score, and has the looks of the kind, is personal data too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import keyed
from trackframe.session import checkpoint

KINDS = ("email", "ip", "card", "phone")
# The four formats. Runs are taken whole (++), and a match starts where its run starts or
# the match before it ended (\G), so that long runs cost no second look; what they match is the same.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A token with a digit or an at sign; characters before it that may hold its context.
TOKEN, WINDOW = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", 80
#: Most digits of tokens looked at together: as many as the longest format has.
DIGITS = 19
#: Rounds of scoring; least distinct seeds and least score of a pattern that discovers.
ROUNDS, SEEDS, SCORE = 3, 8, 0.9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(rank: int, m: Column) -> Column:
    """Whether a match of the format counts."""
    if rank == 0:
        return F.lit(True)
    if rank == 1:
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if rank == 2:  # 14 to 19 digits with a sign between any two
        return F.when(F.length(m).between(14, 37), F.length(_digits(m)).between(14, 19) & _luhn(F.rpad(_digits(m), F.least(F.length(_digits(m)), F.lit(19)), F.lit("0")))).otherwise(False)
    return F.length(_digits(m)).between(10, 15)


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """What stands before each match, and the matches, in order."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m


def _walk(text: Column, pattern: str, guard: Column, holds, item, kind: str, context: int = 0) -> Column:
    """Go over the matches with the place reached; `item` makes what is kept of those that hold, from the
    place, the match, the gap before it and, with `context`, the last characters before it."""
    none = F.array().cast(f"array<{kind}>")
    gaps, m = _matches(text, pattern)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        last = lambda s: F.substring(s, F.lit(-context), F.lit(context)) if context else F.lit("")
        before = last(F.concat(a["tail"], x["g"]))
        kept = F.when(holds(x["m"]), F.concat(a["out"], F.array(item(start, end, x["m"], x["g"], before)))).otherwise(a["out"])
        return F.struct(end.alias("at"), last(F.concat(before, x["m"])).alias("tail"), kept.alias("out"))

    walked = F.aggregate(F.arrays_zip(gaps.alias("g"), m.alias("m")), F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")), step, lambda a: a["out"])
    return F.when(guard, walked).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the four formats: array of (start, rank of the kind, end) in order, code points, end exclusive."""
    guards = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), text.rlike("[0-9]"), F.contains(text, F.lit("+")))
    found = [_walk(text, p, g, lambda m, k=k: _holds(k, m), lambda s, e, m, g, before, k=k: F.struct(s.alias("start"), F.lit(k).alias("rank"), e.alias("end")), "struct<start:int,rank:int,end:int>") for k, (p, g) in enumerate(zip(PATTERNS, guards, strict=True))]
    return F.array_sort(F.concat(*found))


def candidates(text: Column) -> Column:
    """Identifier-like tokens: array of (start, end, token, one and two words before, blanks since the one before or 0)."""
    def item(s: Column, e: Column, m: Column, g: Column, before: Column) -> Column:
        before = F.filter(F.split(F.lower(before), r"\s+"), lambda w: w != "")
        n = F.size(before)
        one = F.when(n > 0, F.get(before, n - 1))
        return F.struct(s.alias("start"), e.alias("end"), m.alias("token"), one.alias("one"), F.when(n > 1, F.concat_ws(" ", F.get(before, n - 2), one)).alias("two"), F.when(g.rlike(r"^[\x20\t\u00A0]+$"), F.char_length(g)).otherwise(0).alias("blanks"))
    return _walk(text, TOKEN, text.rlike("[0-9@]"), lambda m: F.lit(True), item, "struct<start:int,end:int,token:string,one:string,two:string,blanks:int>", WINDOW)


def together(cand: Column) -> Column:
    """Runs of two or more candidates with digits and without an at sign that only blanks part, up to
    DIGITS digits: array of (start, end, token, one, two), with the words before the first."""
    kind = "struct<start:int,end:int,token:string,one:string,two:string,k:int>"

    def step(a: Column, c: Column) -> Column:
        run = a["run"]
        joins = (c["blanks"] > 0) & (run["end"] + c["blanks"] == c["start"]) & (F.length(_digits(run["token"])) + F.length(_digits(c["token"])) <= DIGITS)
        first = F.struct(c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"), c["one"].alias("one"), c["two"].alias("two"), F.lit(1).alias("k"))
        more = F.struct(run["start"].alias("start"), c["end"].alias("end"), F.concat(run["token"], F.lit(" "), c["token"]).alias("token"), run["one"].alias("one"), run["two"].alias("two"), (run["k"] + 1).alias("k"))
        joins = F.coalesce(joins, F.lit(False))
        return F.struct(F.when(joins, more).otherwise(first).alias("run"), F.when(~joins & (run["k"] > 1), F.concat(a["out"], F.array(run))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(None).cast(kind).alias("run"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(F.filter(cand, lambda c: ~F.contains(c["token"], F.lit("@"))), start, step, lambda a: F.when(a["run"]["k"] > 1, F.concat(a["out"], F.array(a["run"]))).otherwise(a["out"]))


def looks(rank: Column, token: Column) -> Column:
    """Whether a token may be of a kind at all: an address has its sign, the others mostly digits."""
    d = F.length(_digits(token))
    return F.when(rank == 0, token.rlike("[^@]@[^@]")).when(rank == 1, token.rlike(r"[0-9]+\.[0-9]+\.[0-9]+")).otherwise((d >= 7) & (2 * d >= F.length(token)) & ~token.rlike("@"))


def _graph(marked: DataFrame) -> DataFrame:
    """(inst, pattern, seed): identifier-like tokens and the patterns before them; seed: rank of a base span that begins there."""
    base = F.col("base")
    def seed(c: Column) -> Column:
        return F.get(F.transform(F.filter(base, lambda b: (b["start"] >= c["start"]) & (b["start"] < c["end"])), lambda b: b["rank"]), F.lit(0))
    covered = lambda c: F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    def shown(c: Column, seed: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"), c["one"].alias("one"), c["two"].alias("two"), seed.alias("seed"))
    alone = F.filter(F.transform("cand", lambda c: F.struct(shown(c, seed(c)).alias("c"), covered(c).alias("covered"))), lambda x: x["c"]["seed"].isNotNull() | ~x["covered"])
    runs = F.transform(together(F.filter("cand", lambda c: ~covered(c))), lambda c: shown(c, F.lit(None).cast("int")))
    return marked.select("row", F.explode(F.concat(F.transform(alone, lambda x: x["c"]), runs)).alias("c")).select("row", "c.*")


def discover(rows: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, score: float = SCORE) -> DataFrame:
    """(row, start, end, rank) of tokens that patterns of high score precede and no base span covers."""
    pattern = F.explode(F.array_compact(F.array(F.when(F.col("one").isNotNull(), F.concat(F.lit("1 "), "one")), F.when(F.col("two").isNotNull(), F.concat(F.lit("2 "), "two"))))).alias("pattern")
    inst = F.sha2(F.lower("token"), 256).alias("inst")
    edges = checkpoint(rows.select("seed", inst, pattern).groupBy("inst", "pattern").agg(F.max("seed").alias("seed")))
    # only patterns that precede some seeds matter, and only one kind each
    kinds = edges.filter("seed is not null").groupBy("pattern", "seed").agg(F.count(F.lit(1)).alias("n"))
    main = kinds.groupBy("pattern").agg(F.max(F.struct("n", (-F.col("seed")).alias("s"))).alias("m")).select("pattern", (-F.col("m.s")).alias("rank"), F.col("m.n").alias("n")).filter(F.col("n") >= seeds)
    live = checkpoint(edges.join(main, "pattern").withColumn("p", F.when(F.col("seed") == F.col("rank"), 1.0).otherwise(0.0)))
    scored = live
    for _ in range(rounds):
        by_pattern = scored.groupBy("pattern").agg((F.sum("p") / (F.count(F.lit(1)) + 0.5)).alias("s"))
        joined = live.select("inst", "pattern", "seed", "rank", "n").join(by_pattern, "pattern")
        by_inst = joined.groupBy("inst", "rank").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("s"), F.lit(1e-9)))))).alias("t"))
        scored = checkpoint(joined.join(by_inst, ["inst", "rank"]).withColumn("p", F.when(F.col("seed") == F.col("rank"), 1.0).when(F.col("seed").isNotNull(), 0.0).otherwise(F.col("t"))).select("inst", "pattern", "seed", "rank", "n", "p", "s"))
    good = scored.groupBy("pattern", "rank").agg(F.max("s").alias("s")).filter(F.col("s") >= score).select("pattern", "rank")
    free = rows.filter("seed is null").select("row", "start", "end", "token", pattern)
    return checkpoint(free.join(good, "pattern").filter(looks(F.col("rank"), F.col("token"))).groupBy("row", "start", "end").agg(F.min("rank").alias("rank")))


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"], s["end"])), ",")


def _marked(docs: DataFrame) -> DataFrame:
    spans = docs.withColumn("base", base_spans(F.col("text")))
    return spans.withColumn("cand", candidates(F.col("text"))).withColumn("row", F.monotonically_increasing_id())


def find(docs: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, score: float = SCORE) -> DataFrame:
    """Personal data of every text.

    Returns (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found): counts and hash of the
    fixed formats, all spans as kind:start:end, and how many the patterns added; a token and a run of tokens
    that holds it are a span each. A null or empty text
    has none. Rows that repeat an id each have their own row, those without an id are left out; an
    empty table gives no row. Only `doc_id` and `text` are read. The texts are read once; what is
    shuffled are identifier-like tokens with the words before them, as counts per pattern and token.
    """
    marked = checkpoint(_marked(keyed(docs)).select("row", "doc_id", "base", "cand"))
    more = discover(_graph(marked), rounds, seeds, score).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    out = marked.drop("cand").join(more, "row", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int>>")))
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    count = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *count, F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("found"))


def redact(docs: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, score: float = SCORE) -> DataFrame:
    """The same rows and columns with every span of personal data replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, under the kind of the first. `n_chars`, if there, follows the
    new text. Null texts stay null. Rows are told apart by a hash of their text beside the id.
    """
    use = keyed(docs)
    marked = checkpoint(_marked(use).select("row", "doc_id", F.xxhash64("text").alias("tie"), "base", "cand"))
    extra = discover(_graph(marked), rounds, seeds, score).join(marked.select("row", "doc_id", "tie"), "row")
    extra = checkpoint(extra.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_set(F.struct("start", "rank", "end")).alias("_more")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_base", base_spans(text)).withColumn("_h", F.xxhash64(text)).join(extra, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_h") == F.col("_tie")), "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def put(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        piece = F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.get(names, s["rank"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(piece))).alias("out"))

    def close(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text")))

    new = F.aggregate(F.col("_spans"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), put, close)
    rows = rows.withColumn("_spans", spans).withColumn("text", F.when(F.size("_spans") > 0, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
