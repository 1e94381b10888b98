"""Personal data: format checks, and gradient-boosted trees over loose candidates.

Base spans are the four checked formats. Besides them, high-recall generators
propose spans that may overlap anything; a boosted classifier scores each from
its format and its context, and a threshold calibrated on held-out documents
selects the spans that are added. Base spans always stay.

The classifier is trained here without hand labels: a candidate is positive
if a base span covers most of it. A candidate that failed a check (a card
number with a wrong check sum, an address part over 255, a plus sign with too
few digits) or whose features no base span has is negative. The rest, with the
features of base spans but no marker to check, is unlabelled: it takes no part
in fitting and calibration, so its share decides nothing. All other candidates of the corpus take part, as
counts of feature vectors; every feature has few values, so this table stays
small however large the corpus is. Documents are split by a hash of the text,
one half for fitting and one for calibration, and equal texts count once. The fitted trees become one SQL
expression, so scoring stays inside the scan.

Patterns are written so that no text makes them back-track or recurse: runs
are possessive and start where a run starts.

Positions are code points, ends exclusive. Defined cases: a null or empty text
has no spans; without candidates, or with candidates of one class only, no
span is added; equal texts get equal spans; columns named like a result are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.catalog import query
from lumenframe.llm.quality import let
from lumenframe.llm.rows import documents, text_key
from lumenframe.session import cut

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# kind: pattern; the order is the order of spans with equal starts.
BASE = {
    "email": f"(?:\\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\\.{LABEL}++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}+",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
CANDIDATES = {
    "number": "(?<![0-9A-Za-z])\\+?\\(?[0-9](?:[\\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "mail": f"(?<!{LOCAL}){LOCAL}{{1,64}}+\\x20?(?:@|[(\\[]at[)\\]])\\x20?{LABEL}{{1,63}}+(?:(?:\\.|\\x20?[(\\[]dot[)\\]]\\x20?){LABEL}{{1,63}}+){{1,8}}+",
}
FEATURES = ["generator", "digits", "groups", "longest_group", "parens", "dashes", "dots", "spaces", "cue", "label_before"]
CUES = "(?i)(?:phone|tel|call|fax|mobile|mail|contact|card|visa|account|ip|address|server)\\W{0,3}$"
CONTEXT = 24          # characters before a candidate that count as its context
TREES, DEPTH = 10, 3
PRECISION = 0.98      # of the selected candidates on the calibration half
BLOCK = 512
SEGMENT = 4096        # code points of a text that are cut from it together


def _running(values: Column, join=lambda a, b: a + b) -> Column:
    """What ``join`` makes of all earlier values (0 at first), for each. Blocks keep the appending short."""
    def scan(part: Column, start: Column) -> Column:
        empty = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, empty, lambda s, x: F.struct(
            join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), join)
    of = lambda parts: let(scan(F.transform(parts, total), F.lit(0)), lambda starts: F.flatten(
        F.transform(parts, lambda v, b: scan(v, F.get(starts, b)))))
    return let(values, lambda v: let(blocks(v), of))


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<start, end, match[, before]>> of a pattern's matches, leftmost first.

    ``before``: up to ``context`` characters in front of a match, back to the
    beginning of the match before it.
    """
    def place(found: Column) -> Column:
        # The pieces between the matches give their places and what is before them.
        between = F.split(text, pattern, -1)
        gaps, earlier = F.slice(between, F.lit(1), F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.size(found) - 1))
        # gap, match, gap, match ... : a start is what comes before, so sum gap and earlier match together
        steps = F.zip_with(gaps, earlier, lambda gap, before: (F.char_length(gap) + F.char_length(before)).cast("long"))
        placed = let(steps, lambda v: F.zip_with(F.zip_with(_running(v), v, lambda a, b: a + b), found, lambda s, m: F.struct(
            s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("match"))))
        if not context:
            return placed
        front = F.zip_with(gaps, earlier, lambda gap, before: F.right(F.concat(before, gap), F.lit(context)))
        return F.zip_with(placed, front, lambda x, f: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), f.alias("before")))
    extra = ",before:string" if context else ""
    none = F.array().cast(f"array<struct<start:bigint,end:bigint,match:string{extra}>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(place(m)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Do the digits pass the check sum? Every second digit from the right doubles."""
    def term(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    values = F.transform(F.reverse(F.split(number, "")), lambda c: c.cast("int"))
    return F.aggregate(F.transform(values, term), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.char_length(digits(match))
    if kind == "ip":
        return match.rlike("^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (its number), end>> in order."""
    def of(kind: str) -> Column:
        right = F.filter(matches(text, BASE[kind]), lambda x: valid(kind, x["match"]))
        return F.transform(right, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat(*map(of, KINDS)))


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, features...>> of all generators."""
    def describe(x: Column, generator: int) -> Column:
        m = x["match"]
        count = lambda drop: F.char_length(F.regexp_replace(m, drop, ""))
        n = F.char_length(digits(m))
        groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
        before = x["before"]
        quad = m.rlike("^[0-9]++(?:\\.[0-9]++){3}$")
        # Forms that the base checks judge: if no base span covers such a candidate, it failed.
        checked = F.lit(False) if generator else quad | m.startswith("+") | (n.between(14, 19) & m.rlike("^[0-9](?:[\\x20-]?[0-9])++$"))
        kind = F.lit(0) if generator else F.when(quad, 1).when(n >= 13, 2).otherwise(3)
        value = {
            "generator": F.lit(generator), "digits": F.least(n, F.lit(20)), "groups": F.least(F.size(groups), F.lit(6)),
            "longest_group": F.least(F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)), F.lit(8)),
            "parens": F.least(count("[^()]+"), F.lit(2)), "dashes": F.least(count("[^-]+"), F.lit(3)),
            "dots": F.least(count("[^.]+"), F.lit(4)), "spaces": F.least(count("[^\\x20]+"), F.lit(3)),
            "cue": before.rlike(CUES).cast("int"), "label_before": before.rlike("[:=#]\\W{0,2}$").cast("int")}
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), checked.alias("checked"),
                        *[value[f].cast("int").alias(f) for f in FEATURES])
    def of(generator: int, pattern: str) -> Column:
        return F.transform(matches(text, pattern, CONTEXT), lambda x: describe(x, generator))
    return F.concat(*[of(g, p) for g, p in enumerate(CANDIDATES.values())])


def lanes(spans: Column, by: str, count: int) -> Column:
    """Spans dealt by a number: in a lane they are in order and do not overlap, so a place is found by halving."""
    def lane(k: int) -> Column:   # a second parameter of the lambda would be the place in the array
        return F.filter(spans, lambda s: s[by] == k)
    return F.array(*map(lane, range(count)))


def last_before(lane: Column, x: Column) -> Column:
    """The last span of a lane that starts before ``x``; null if none does."""
    powers = F.filter(F.array(*[F.lit(1 << p) for p in reversed(range(28))]), lambda p: p <= F.size(lane))
    count = F.aggregate(powers, F.lit(0), lambda n, p: F.when(F.get(lane, n + p - 1)["start"] < x, n + p).otherwise(n))
    return F.get(lane, count - 1)


def in_any(lanes_: Column, which: range, test) -> Column:
    """Does ``test`` (of a lane) hold for one of the lanes?"""
    out = F.lit(False)
    for k in which:
        out = out | F.coalesce(test(F.get(lanes_, F.lit(k))), F.lit(False))
    return out


def covered(c: Column, base: Column) -> Column:
    """Does one span of the base lanes cover most of the candidate? It must then hold the candidate's middle."""
    middle = c["start"] + F.floor((c["end"] - c["start"] - 1) / 2)
    shared = lambda b: F.least(b["end"], c["end"]) - F.greatest(b["start"], c["start"])
    return in_any(base, range(len(KINDS)), lambda lane: let(last_before(lane, middle + 1), lambda b: (b["end"] > middle) & (shared(b) * 2 > c["end"] - c["start"])))


def touches(c: Column, lane: Column) -> Column:
    """Does a span of the lane overlap the candidate?"""
    return last_before(lane, c["end"])["end"] > c["start"]


@dataclass
class Selector:
    """The trees as (weight, root node of the fitted model) and the calibrated threshold."""
    trees: list
    threshold: float

    def score(self, c: Column) -> Column:
        def walk(node) -> Column:
            if node.subtreeDepth() == 0:
                return F.lit(float(node.prediction()))
            split = node.split()
            return F.when(c[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold())), walk(node.leftChild())).otherwise(walk(node.rightChild()))
        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * walk(root)
        return total


def fit(df: DataFrame, text: str = "text") -> Selector | None:
    """Selector trained on the candidates of ``df``; None if they have one class only."""
    raw = F.coalesce(F.col(text), F.lit(""))
    seen = df.select(raw.alias("_t")).select("_t", candidates(F.col("_t")).alias("_c")).filter(F.size("_c") > 0)
    seen = seen.select(F.xxhash64("_t").bitwiseAND(1).alias("half"), text_key("_t").alias("_k"), "_c", "_t")
    # Bound once: a candidate must not find the base spans of its text anew.
    labelled = seen.select("half", "_k", let(lanes(base_spans(F.col("_t")), "kind", len(KINDS)), lambda b: F.transform("_c", lambda c: F.struct(
        *[c[f].alias(f) for f in FEATURES], c["checked"].alias("checked"), covered(c, b).cast("double").alias("label")))).alias("_x"))
    rows = labelled.dropDuplicates(["_k"]).select("half", F.explode("_x").alias("x"))
    counts = rows.select("half", "x.*").groupBy("half", "label", "checked", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n"))
    alike = F.max("label").over(Window.partitionBy(*FEATURES)) > 0
    known = counts.withColumn("known", (F.col("label") > 0) | F.col("checked") | ~alike)
    every = cut(known.groupBy("half", "label", "known", *FEATURES).agg(F.sum("n").alias("n")))
    table = every.filter("known")
    if table.filter("label = 0").isEmpty():
        # Nothing speaks against any candidate: what looks like base spans is added.
        return None if every.filter("NOT known").isEmpty() else Selector([], 0.0)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    train = ready.filter("half = 0")
    if train.select("label").distinct().count() < 2:
        return None
    model: GBTClassificationModel = GBTClassifier(labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(train)
    # The lowest score from which on the held-out candidates are base spans often enough.
    scored = model.transform(ready.filter("half = 1")).select(
        F.round(vector_to_array("rawPrediction")[1] / 2, 6).alias("score"), "label", "n")
    by_score = scored.groupBy("score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits"))
    down = Window.orderBy(F.desc("score"))  # distinct scores of a few trees: a short table
    precise = by_score.select("score", (F.sum("hits").over(down) / F.sum("n").over(down)).alias("precision"))
    threshold = precise.filter(F.col("precision") >= PRECISION).agg(F.min("score")).first()[0]
    if threshold is None:
        return None
    trees = [(w, t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    return Selector(trees, threshold - 1e-6)


def find(df: DataFrame, selector: Selector | None, text: str = "text") -> DataFrame:
    """``df`` with base (the base spans) and added (the selected candidates)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    out = df.drop("base", "added").withColumn("base", base_spans(raw))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    if selector is None:
        return out.withColumn("added", none)
    generators = range(len(CANDIDATES))
    chosen = lambda base: F.filter(candidates(raw), lambda c: (selector.score(c) >= F.lit(selector.threshold)) & ~in_any(
        base, range(len(KINDS)), lambda lane: touches(c, lane)))
    # Generators are in order of trust from the last one: a candidate yields to one of a later generator.
    later = lambda c, by: in_any(by, generators, lambda lane: touches(c, lane) & (F.get(lane, F.lit(0))["generator"] > c["generator"]))
    alone = lambda all_: let(lanes(all_, "generator", len(CANDIDATES)), lambda by: F.filter(all_, lambda c: ~later(c, by)))
    slim = lambda a: F.transform(a, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    new = let(lanes(F.col("base"), "kind", len(KINDS)), lambda base: let(chosen(base), lambda a: slim(alone(a))))
    return out.withColumn("added", new)


def listing(spans: Column) -> Column:
    """kind:start:end of ordered spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap become one, named after the first.

    The text is cut into segments once, and what stays is taken from them, so
    the work grows with the text and the spans, not with their product.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.array().cast("array<string>")

    def stays(segments: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / SEGMENT).cast("int"), F.floor(b / SEGMENT).cast("int")
        at = (a % SEGMENT + 1).cast("int")
        inside = F.substring(F.get(segments, first), at, (b - a).cast("int"))
        across = F.concat(F.substring(F.get(segments, first), at, F.lit(SEGMENT)), F.array_join(F.slice(segments, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                          F.coalesce(F.substring(F.get(segments, last), F.lit(1), (b % SEGMENT).cast("int")), F.lit("")))
        return F.when(a >= b, F.lit("")).when(first == last, inside).otherwise(across)

    def build(ordered: Column, before: Column, segments: Column) -> Column:
        parts = F.flatten(F.zip_with(ordered, before, lambda x, a: F.when(
            x["start"] >= a, F.array(stays(segments, a, x["start"]), F.get(names, x["kind"]))).otherwise(none)))
        end = F.array_max(F.transform(ordered, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), stays(segments, end, F.char_length(text).cast("long")))
    furthest = lambda ordered: _running(F.transform(ordered, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    cut_up = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    return let(F.array_sort(spans), lambda o: let(furthest(o), lambda before: let(cut_up, lambda segments: build(o, before, segments))))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; n_chars follows the text.

    Overlapping spans become one replacement, named after the first.
    """
    clean = replaced(F.coalesce(F.col("text"), F.lit("")), F.concat("_found.base", "_found.added"))
    found = find(docs.select(F.struct(*docs.columns).alias("_row"), "text"), fit(docs.select("text")))
    found = found.select("_row", "text", F.struct("base", "added").alias("_found"))
    found = found.withColumn("_clean", F.when(F.size("_found.base") + F.size("_found.added") > 0, clean).otherwise(F.col("text")))
    named = {"text": F.col("_clean"), "n_chars": F.coalesce(F.char_length("_clean").cast("long"), F.lit(0).cast("long"))}
    return found.select(*[named.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, fit(docs))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *map(count, range(len(KINDS))),
                        F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listing(F.array_sort(F.concat("base", "added"))).alias("spans"))
