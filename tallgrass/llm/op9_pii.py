"""PII by candidate gradient boosting, with DataFrame functions alone.

Generators propose spans of four kinds with high recall: the four base patterns, and looser forms that may overlap them (disguised addresses, numbers without a plus
sign, groups of digits, dotted numbers). Each span gets format and context features. Boosted trees of depth two, grown here from histograms of gradients that Spark
aggregates, learn which candidates are written like spans that pass a base pattern's checks.

There are no labels of spans, so the checks stand for them. A match of a base pattern that passes is a yes, one of a wrong structure (too few or many digits, a part above 255) a no. A card
number of the right length whose check digit alone is wrong is neither: of ten numbers that someone made up one passes, so the digit says little about what was meant. A looser candidate
is a yes where it overlaps a passing span of its kind, a no where it overlaps one of another kind or is part of a match that fails, else neither. For each kind the threshold is the lowest at
which PRECISION of held-out candidates above it are a yes. Base spans always stay; other candidates are added where they reach the threshold and overlap no base span and no better candidate.

Positions are code points: a text is split at the matches, and lengths of the parts add up. Patterns use loops over single characters only, whose matching doesn't nest,
so very long texts can't exhaust a stack: dots and separators that join characters are first marked by private-use characters of the same length.

Scale: one pass over texts, without a shuffle, writes the candidates; training sees counts of equal feature rows, over all candidates. Rows are independent.

Null or empty text: no spans. Null doc_id stays null. Repeated rows repeat. An empty table, or one without candidates that fail or pass, adds no spans. Other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
TREES, RATE, LEAST_ROWS, RIDGE, PRECISION, MIN_HELD = 16, 0.4, 5.0, 1.0, 0.95, 20
FEATURES = ("kind", "digits", "letters", "marks", "groups", "head", "before", "after", "context", "tail", "form")
#: Stand for a dot between two characters of a host name, and for one separator between two digits.
DOT, JOIN = chr(0xE001), chr(0xE000)
_HOST, _LOCAL = r"A-Za-z0-9\-", rf"A-Za-z0-9._%+\-{DOT}"
_CONTEXT = r"(?i)(mail|phone|tel|call|fax|card|visa|credit|pay|host|addr|contact|server|\bip\b)"


def _base_patterns() -> dict[str, tuple[str, str]]:
    """Pattern of each kind, and the form of the text it runs on. They match what the plain patterns match: a match begins where its run of characters begins, or where the last match ended."""
    return {
        "email": ("dots", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++{DOT}[{_HOST}{DOT}]*+"),
        "ip": ("plain", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
        "card": ("joins", rf"[0-9][0-9{JOIN}]++"),
        "phone": ("plain", r"\+[0-9][\x20().0-9\-]+[0-9]"),
    }


#: Looser forms: kind, form of the text, pattern.
LOOSE = (
    ("email", "plain", r"[A-Za-z0-9][A-Za-z0-9_+\-]{0,63}\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9\-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9\-]{1,63}){1,4}"),
    ("phone", "plain", r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[\x20.\-][0-9]{3,4}[\x20.\-][0-9]{3,4}(?![0-9A-Za-z])"),
    ("card", "joins", rf"(?<![0-9])[0-9]{{12,19}}(?![0-9{JOIN}])"),
    ("ip", "plain", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})(?![0-9A-Za-z])"),
)


def _texts(text: Column) -> dict[str, Column]:
    """The text in three forms of equal length."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), DOT + JOIN, "§§")
    return {"plain": plain, "dots": F.regexp_replace(plain, rf"(?<=[{_HOST}])\.(?=[{_HOST}])", DOT), "joins": F.regexp_replace(plain, r"(?<=[0-9])[\x20\-](?=[0-9])", JOIN)}


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """(start, end, m, before, after) of every match, leftmost and not overlapping; before and after are the text up to the next matches, cut to 24 and 1 characters. guard is false where there can't be any."""
    parts, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
    empty = F.array().cast(kind)

    def spans(parts: Column, found: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(parts, i))
            m = F.get(found, i)
            end = start + F.length(m)
            one = F.struct(start.alias("start"), end.alias("end"), m.alias("m"), F.right(F.get(parts, i), F.lit(24)).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], one).cast(kind).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    both = F.transform(F.array(F.struct(parts.alias("p"), found.alias("f"))), lambda x: F.when(F.size(x["f"]) > 0, spans(x["p"], x["f"])).otherwise(empty))
    return F.when(guard, F.get(both, F.lit(0))).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a right check digit."""
    d = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return acc + F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """What a match of a base pattern has to pass; null where only a check digit speaks against it."""
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        # null: nothing but the check digit is wrong
        return F.when(~n.between(12, 19), False).when(luhn(F.when(n.between(12, 19), _digits(m)).otherwise(F.lit("1"))), True)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _class(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z]"), 2).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^[.,;:!?)]"), 4).otherwise(5)


def _candidate(x: Column, kind: int, form: int, ok: Column) -> Column:
    """A span with its features, all of them small numbers."""
    m = x["m"]
    cap = lambda c, most: F.least(c, F.lit(most)).cast("int")
    features = {
        "kind": F.lit(kind),
        "digits": cap(F.length(_digits(m)), 20),
        "letters": cap(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), 30),
        "marks": cap(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), 12),
        "groups": cap(F.size(F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")), 8),
        "head": F.when(m.startswith("+"), 1).when(m.startswith("("), 2).when(m.rlike("^[0-9]"), 3).otherwise(4),
        "before": _class(F.right(x["before"], F.lit(1))),
        "after": _class(x["after"]),
        "context": x["before"].rlike(_CONTEXT).cast("int"),
        "tail": cap(F.length(F.regexp_extract(m, "[0-9]*$", 0)), 6),
        "form": F.lit(form),
    }
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), ok.alias("ok"), *[v.cast("int").alias(k) for k, v in features.items()])


def _as_candidate(kind: int, form: int, check: str | None):
    return lambda x: _candidate(x, kind, form, F.lit(None).cast("boolean") if check is None else passes(check, x["m"]))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): spans of the base patterns with what they have to pass (ok), and looser candidates (ok null)."""
    forms = _texts(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", *[c.alias(k) for k, c in forms.items()])
    digits, at = F.col("plain").rlike("[0-9]"), F.contains("plain", F.lit("@"))
    guards = {"email": at, "ip": digits, "card": digits, "phone": F.contains("plain", F.lit("+"))}
    base, more = [], []
    for k, (kind, (form, pattern)) in enumerate(_base_patterns().items()):
        base.append(F.transform(matches(F.col(form), pattern, guards[kind]), _as_candidate(k, 0, kind)))
    for f, (kind, form, pattern) in enumerate(LOOSE):
        guard = F.col("plain").rlike(r"[\[({]at[\])}]") if kind == "email" else digits
        more.append(F.transform(matches(F.col(form), pattern, guard), _as_candidate(KINDS.index(kind), f + 1, None)))
    return docs.select("doc_id", F.concat(*base).alias("base"), F.concat(*more).alias("more"))


class Tree:
    """Depth two: a split, and one on each side; leaves are added to the score."""

    def __init__(self, root: tuple[str, int] | None, sides: dict[int, tuple[str, int] | None], leaves: dict[tuple[int, int], float]):
        self.root, self.sides, self.leaves = root, sides, leaves

    def node(self, get) -> tuple[Column, Column]:
        """Which side, and which leaf of it."""
        go = lambda split: F.lit(0) if split is None else F.when(get(split[0]) <= split[1], 0).otherwise(1)
        side = go(self.root)
        return side, F.when(side == 0, go(self.sides.get(0))).otherwise(go(self.sides.get(1)))

    def value(self, get) -> Column:
        side, leaf = self.node(get)
        by = lambda s: F.when(leaf == 0, self.leaves.get((s, 0), 0.0)).otherwise(self.leaves.get((s, 1), 0.0))
        return F.when(side == 0, by(0)).otherwise(by(1))


def _best(histogram: dict[str, dict[int, tuple[float, float, float]]]) -> tuple[str, int] | None:
    """The split (feature, at most) of highest gain; ties go to the first feature and the lowest value."""
    best, found = 1e-6, None
    for name in FEATURES:
        bins = sorted(histogram.get(name, {}).items())
        g, h, n = (sum(v[k] for _, v in bins) for k in range(3))
        gl = hl = nl = 0.0
        for value, (a, b, c) in bins[:-1]:
            gl, hl, nl = gl + a, hl + b, nl + c
            if nl < LEAST_ROWS or n - nl < LEAST_ROWS:
                continue
            gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
            if gain > best + 1e-9:
                best, found = gain, (name, value)
    return found


def boost(counts: DataFrame) -> tuple[float, list[Tree]]:
    """Trees from rows (features, ok, n): Newton steps on the logistic loss. Each level is one aggregation, whose result is a few hundred numbers."""
    # counts are as many as there are different feature rows, however large the corpus: one partition holds them, and no level shuffles
    counts = counts.coalesce(1)
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("p")).first()
    if not total.n or not total.p or total.p == total.n:
        return 0.0, []
    start = math.log(total.p / (total.n - total.p))
    trees: list[Tree] = []
    get = F.col

    def histograms(score: Column, keys: list[Column]) -> list:
        p = 1 / (1 + F.exp(-score))
        rows = counts.select("n", ((F.col("ok").cast("int") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"), F.concat_ws(":", *keys).alias("node"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x"))
        return rows.groupBy("node", "x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()

    def by_node(rows: list) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for r in rows:
            out.setdefault(r.node, {}).setdefault(r.f, {})[r.v] = (r.g, r.h, float(r.n))
        return out

    for _ in range(TREES):
        score = F.lit(start)
        for t in trees:
            score = score + t.value(get)
        root = _best(by_node(histograms(score, [F.lit("0")])).get("0", {}))
        if root is None:
            break
        top = Tree(root, {}, {})
        second = by_node(histograms(score, [top.node(get)[0].cast("string")]))
        sides = {s: _best(second.get(str(s), {})) for s in (0, 1)}
        leaves = {}
        for s in (0, 1):
            bins = second.get(str(s), {})
            name = sides[s][0] if sides[s] else FEATURES[0]
            for leaf in (0, 1):
                inside = [v for value, v in bins.get(name, {}).items() if sides[s] is None and leaf == 0 or sides[s] is not None and (value <= sides[s][1]) == (leaf == 0)]
                g, h = sum(v[0] for v in inside), sum(v[1] for v in inside)
                leaves[s, leaf] = RATE * g / (h + RIDGE)
        trees.append(Tree(root, sides, leaves))
    return start, trees


def thresholds(held: DataFrame, score: Column) -> dict[int, float]:
    """For each kind the lowest score above which PRECISION of its held-out candidates are a yes. A kind with fewer than MIN_HELD above any score takes the threshold of all kinds together; without that many in all there is none."""
    rows = held.coalesce(1).select("kind", F.round(score, 3).alias("s"), "ok", "n").groupBy("kind", "s").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("p")).collect()

    def lowest(some: list) -> float | None:
        by: dict[float, tuple[int, int]] = {}
        for r in some:
            n, p = by.get(r.s, (0, 0))
            by[r.s] = n + r.n, p + r.p
        n = p = 0
        found = None
        for s in sorted(by, reverse=True):
            n, p = n + by[s][0], p + by[s][1]
            if n >= MIN_HELD and p >= PRECISION * n:
                found = s
        return found

    together = lowest(rows)
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r.kind == kind]
        limit = lowest(own)
        if limit is None and sum(r.p for r in own) < MIN_HELD:
            limit = together
        if limit is not None:
            out[kind] = limit
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) in order; spans holds base and what the trees add."""
    found = materialize(candidates(docs), "op9-candidates")
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def judged(c: Column) -> Column:
        """A looser candidate, with what the base matches that it overlaps say."""
        yes = F.exists("base", lambda b: meets(b, c) & F.coalesce(b["ok"], F.lit(False)) & (b["kind"] == c["kind"]))
        around = lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])
        no = F.exists("base", lambda b: (~F.coalesce(b["ok"], F.lit(True)) & around(b)) | (F.coalesce(b["ok"], F.lit(False)) & (b["kind"] != c["kind"]) & meets(b, c)))
        return c.withField("ok", F.when(yes, True).when(no, False))

    every = found.select("doc_id", F.explode(F.concat("base", F.transform("more", judged))).alias("c")).where("c.ok IS NOT NULL")
    each = every.select("c.ok", *[f"c.{f}" for f in FEATURES], (F.pmod(F.xxhash64("doc_id", "c.start"), F.lit(4)) == 0).alias("held"))
    counts = materialize(each.groupBy("ok", "held", *FEATURES).agg(F.count("*").alias("n")).coalesce(4), "op9-counts")
    start, trees = boost(counts.where(~F.col("held")))

    def score(get) -> Column:
        total = F.lit(start)
        for t in trees:
            total = total + t.value(get)
        return F.round(total, 3)

    limits = thresholds(counts.where("held"), score(F.col)) if trees else {}
    brief = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("base", lambda c: c["ok"]), brief))
    out = found.select("doc_id", base.alias("base"), F.concat(F.filter("base", lambda c: ~F.coalesce(c["ok"], F.lit(False))), "more").alias("more"))
    if not limits:
        return out.select("doc_id", "base", F.col("base").alias("spans"))
    scored = F.transform("more", lambda c: F.struct(score(lambda f: c[f]).alias("s"), (-c["start"]).alias("first"), brief(c).alias("x")))
    limit = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(v)) for k, v in limits.items()], F.lit(1e9))
    out = out.withColumn("more", F.array_distinct(F.filter(scored, lambda y: y["s"] >= limit(y["x"]))))
    out = out.withColumn("more", F.filter("more", lambda y: ~F.exists("base", lambda b: meets(b, y["x"]))))
    alone = F.filter("more", lambda y: ~F.exists("more", lambda z: (z > y) & meets(z["x"], y["x"])))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.transform(alone, lambda y: y["x"]))).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256, spans, n_spans (all of them)."""
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
