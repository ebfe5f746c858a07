"""Personal data in whole texts: weak supervision over regex, gazetteer and context labelers.

All work is DataFrame functions. One scan finds candidates: the base patterns and wider ones
(bracketed e-mail spellings, national phone numbers, full IPv6 addresses, dotted card numbers), with
the characters around them. Splitting a text at the same pattern gives the gaps between its matches,
so starts are running sums of gaps and lengths. Four labelers vote on every candidate: a regex
labeler (format and check digits), a gazetteer (top-level domains, calling codes, card issuers, reserved
networks), a context labeler (words before it) and a boundary labeler. Expectation-maximisation
over the counts of vote patterns estimates how reliable each vote is, kind by kind; its
posteriors are the soft labels from which a final span classifier (naive Bayes on the span's
features) is trained by weighted counts. Base spans always stay; a wide candidate becomes a span if the
classifier gives it at least ``ACCEPT`` and it overlaps no other span. What reaches the driver is
one row per vote pattern and per feature value: a few hundred whatever the input.

Defined results: null text is empty; a document without spans has counts 0, empty spans and the
hash of the empty string; repeated rows and null doc_ids are rows of their own; a text of any
length is searched whole, in time linear in it but for sorting its spans; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import documents, stored

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a wide candidate is a span.
ACCEPT = 0.9
EM_ROUNDS = 50
CONTEXT = 24

# The patterns of the four kinds. They equal
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                phone \+[0-9][\x20().0-9-]+[0-9]
# with possessive repeats and start conditions that find the same matches without backtracking:
# a match can only start where a run of its first class starts or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns of the same kinds.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9A-Za-z.])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
# What a text must hold for a pattern to be tried on it.
NEEDS = {
    ("email", True): "@", ("phone", True): r"\+[0-9]", ("ip", True): r"[0-9]\.[0-9]", ("card", True): "[0-9]",
    ("email", False): r"[\[(]at[\])]", ("phone", False): "[0-9][ .-][0-9]{4}", ("ip", False): ":[0-9A-Fa-f]{1,4}:",
    ("card", False): r"[0-9]{4}\.[0-9]{4}",
}
# Gazetteers.
TOP_LEVEL = "com org net edu gov int io co info biz de fr es it uk eu us ca ch at nl be pl se no dk fi pt ie au jp cn in br mx"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 353 358 380 420 421"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|65|62|50|5[6-8]|63|67)"
RESERVED = r"^0*(0|127|169|224|255)\."
# Words before a span that speak for or against its kind.
FOR = {"email": r"(?i)(e-?mail|mail|contact|write|send|reach)\W{0,4}\w{0,4}\W{0,3}$", "ip": r"(?i)\b(ip|host|server|address|addr)\W{0,4}$",
       "card": r"(?i)(card|visa|master|amex|credit|payment)\W{0,4}\w{0,6}\W{0,3}$",
       "phone": r"(?i)(phone|tel|call|fax|mobile|cell|dial)\W{0,4}\w{0,4}\W{0,3}$"}
AGAINST = r"(?i)(token|key|hash|sha|version|id|isbn|order|invoice|section|no\.?)\W{0,4}$"
LABELERS = ("regex", "gazetteer", "context", "boundary")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits; digits of at most 19 characters."""
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + (
        lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))(F.substring(back, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The kind's base check of a match."""
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (lambda d: (F.length(d) <= 3) & (
            F.coalesce(d.try_cast("int"), F.lit(0)) <= 255))(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15)


def _around(text: Column, kind: str, base: bool) -> tuple[Column, Column]:
    """The pattern's matches in order, and the gaps before, between and after them (length and the
    characters next to a match); null where the text can't hold a match."""
    gaps = F.transform(F.split(text, (BASE if base else WIDE)[kind], -1), lambda gap: F.struct(
        F.length(gap).alias("len"), F.left(gap, F.lit(CONTEXT)).alias("head"), F.right(gap, F.lit(CONTEXT)).alias("tail")))
    may = text.rlike(NEEDS[kind, base])
    return F.when(may, F.regexp_extract_all(text, F.lit((BASE if base else WIDE)[kind]), F.lit(0))), F.when(may, gaps)


def _candidates(matches: Column, gaps: Column, kind: str, base: bool) -> Column:
    """The matches in order: kind, base, nth, gap (characters since the last match), len, value and the text around it."""
    n = F.size(matches)
    each = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), n).alias("before"), F.slice(gaps, F.lit(2), n).alias("after"))
    return F.transform(each, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("nth"), x["before"]["len"].alias("gap"),
        F.length(x["m"]).alias("len"), x["m"].alias("value"), x["before"]["tail"].alias("before"), x["after"]["head"].alias("after")))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and all candidates with their start and end (code points)."""
    names = {(k, b): f"{k}_{'base' if b else 'wide'}" for b in (True, False) for k in KINDS}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    # matches and gaps are columns of their own: an expression inside a lambda would be evaluated for each match
    parts = [x.alias(f"{n}_{part}") for (k, b), n in names.items() for part, x in zip(("matches", "gaps"), _around(F.col("t"), k, b))]
    lists = [_candidates(F.col(f"{n}_matches"), F.col(f"{n}_gaps"), k, b) for (k, b), n in names.items()]
    none = "array<struct<kind:string,base:boolean,nth:int,gap:int,len:int,value:string,before:string,after:string>>"
    rows = rows.select("row", "doc_id", *parts).select(
        "row", "doc_id", F.concat(*[F.coalesce(x, F.array().cast(none)) for x in lists]).alias("found"))
    rows = stored(rows, "pii-candidates")
    each = rows.select("row", F.inline("found"))
    so_far = Window.partitionBy("row", "kind", "base").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).withColumn(
        "start", F.col("end") - F.col("len"))
    return rows.select("row", "doc_id"), each


def _by_kind(of) -> Column:
    """of(kind) for the row's kind."""
    out = F.lit(None)
    for k in KINDS:
        out = F.when(F.col("kind") == k, of(k)).otherwise(out)
    return out


def votes(each: DataFrame) -> DataFrame:
    """Candidates with each labeler's vote: 1 (personal data), -1 (not) or 0 (abstains)."""
    value, digits = F.col("value"), _digits(F.col("value"))
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    valid = _by_kind(lambda k: _passes(k, value))
    wide_format = _by_kind(lambda k: {"email": F.lit(True), "ip": F.lit(True), "card": _luhn(digits),
                                      "phone": ~digits.rlike("^[01]")}[k])
    calling = digits.rlike("^(" + "|".join(CALLING.split()) + ")")
    lists = _by_kind(lambda k: {
        "email": sign(F.lower(value).rlike(r"(\.|dot[\])] ?)(" + "|".join(TOP_LEVEL.split()) + ")$"), F.lit(False)),
        "ip": sign(F.lit(False), value.rlike(RESERVED)),
        "card": sign(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": sign(F.col("base") & calling, F.col("base") & ~calling)}[k])
    context = _by_kind(lambda k: sign(F.col("before").rlike(FOR[k]), F.col("before").rlike(AGAINST)))
    free = ~F.col("before").rlike("[0-9A-Za-z_./=\"'#-]$") & ~F.col("after").rlike("^[0-9A-Za-z_/\"'=-]")
    return each.withColumn("valid", F.col("base") & valid).withColumn(
        "regex", F.when(F.when(F.col("base"), valid).otherwise(wide_format), 1).otherwise(-1)).withColumn(
        "gazetteer", lists).withColumn("context", context).withColumn("boundary", F.when(free, 1).otherwise(-1))


def estimate_reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple, float]:
    """Posterior probability of (kind, votes) by expectation-maximisation over pattern counts
    (kind, votes, count): votes are independent given the truth, with a rate of each vote for
    true and for false spans."""
    out = {}
    for kind in {k for k, *_ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        belief = {v: 1 / (1 + math.exp(-2 * (sum(v) + v[0]))) for v, _ in own}      # majority, the regex twice
        for _ in range(EM_ROUNDS):
            mass = [sum(n * (belief[v] if c else 1 - belief[v]) for v, n in own) for c in (0, 1)]
            total = sum(mass)
            rate = [[{x: (0.5 + sum(n * (belief[v] if c else 1 - belief[v]) for v, n in own if v[j] == x)) / (mass[c] + 1.5)
                      for x in (-1, 0, 1)} for j in range(len(LABELERS))] for c in (0, 1)]
            for v, _ in own:
                odds = math.log((mass[1] + 1) / (total + 2)) - math.log((mass[0] + 1) / (total + 2))
                odds += sum(math.log(rate[1][j][x]) - math.log(rate[0][j][x]) for j, x in enumerate(v))
                belief[v] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        out.update({(kind, v): p for v, p in belief.items()})
    return out


def _features() -> dict[str, Column]:
    """Features of a candidate; each has a few values. They do not hold the votes."""
    digits = F.length(_digits(F.col("value")))
    char = lambda c: F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9]"), "digit").when(
        c.rlike("[\"'`]"), "quote").when(c.rlike(r"\p{L}"), "letter").otherwise("other")
    return {"origin": F.col("base").cast("string"), "digits": F.least(digits, F.lit(24)).cast("string"),
            "length": F.floor(F.log2(F.col("len").cast("double"))).cast("string"),
            "before": char(F.right("before", F.lit(1))), "after": char(F.left("after", F.lit(1))),
            "groups": F.least(F.size(F.split("value", "[^0-9A-Za-z]+")), F.lit(9)).cast("string"),
            "passes": F.col("regex").cast("string"), "listed": F.col("gazetteer").cast("string")}


def _log_odds(weighted: DataFrame) -> dict[tuple[str, str, str], float]:
    """(kind, feature, value) -> log ratio of its rates among true and false spans, smoothed."""
    names = _features()
    long = weighted.select("kind", "belief", F.explode(F.map_from_arrays(
        F.array(*map(F.lit, names)), F.array(*names.values()))).alias("feature", "level"))
    rows = long.groupBy("kind", "feature", "level").agg(F.sum("belief").alias("yes"), F.sum(1 - F.col("belief")).alias("no")).collect()
    totals: dict[tuple, list[float]] = {}
    for r in rows:
        t = totals.setdefault((r["kind"], r["feature"]), [0.0, 0.0, 0.0])
        t[0], t[1], t[2] = t[0] + r["yes"], t[1] + r["no"], t[2] + 1
    out = {}
    for r in rows:
        yes, no, levels = totals[r["kind"], r["feature"]]
        out[r["kind"], r["feature"], r["level"]] = math.log((r["yes"] + 1) / (yes + levels)) - math.log((r["no"] + 1) / (no + levels))
    for k in {r["kind"] for r in rows}:
        yes, no, _ = totals[k, "origin"]
        out[k, "prior", ""] = math.log((yes + 1) / (no + 1))
    return out


def classify(voted: DataFrame) -> DataFrame:
    """Candidates with ``probability``, from the classifier trained on their own votes."""
    counts = voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()     # at most 4 * 3**4 rows
    belief = estimate_reliabilities([(r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counts])
    if not belief:
        return voted.withColumn("probability", F.lit(0.0))
    key = F.concat_ws(" ", "kind", *LABELERS)
    look = F.create_map(*[F.lit(x) for (k, v), p in sorted(belief.items()) for x in (" ".join([k, *map(str, v)]), p)])
    odds = _log_odds(voted.withColumn("belief", look[key]))
    table = F.create_map(*[F.lit(x) for k, v in sorted(odds.items()) for x in ("|".join(k), v)])
    total = table[F.concat_ws("|", F.col("kind"), F.lit("prior"), F.lit(""))]
    for name, level in _features().items():
        total = total + F.coalesce(table[F.concat_ws("|", F.col("kind"), F.lit(name), level)], F.lit(0.0))
    return voted.withColumn("probability", 1 / (1 + F.exp(-total)))


def _disjoint(kept: DataFrame) -> DataFrame:
    """Base spans, and the wide spans that overlap no base span and no wide span before them (by start, then
    kind): running ends of what starts earlier, and the next base start, so in n log n."""
    on = Window.partitionBy("row").orderBy("start", ~F.col("base"), "order").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("base"), F.col("order").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max("end").over(on), F.lit(0)) <= F.col("start")
    free = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(back) >= F.col("end"), F.lit(True))
    return kept.withColumn("free", F.col("base") | (ended & free)).filter("free").drop("free")


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row, doc_id and its spans (start, nth kind, kind, end, base, value), sorted."""
    rows, each = candidates(docs)
    judged = classify(stored(votes(each), "pii-votes"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    kept = judged.filter(F.col("valid") | (~F.col("base") & (F.col("probability") >= ACCEPT)))
    spans = _disjoint(kept.withColumn("order", order)).groupBy(F.col("row").alias("span_row")).agg(F.sort_array(
        F.collect_list(F.struct("start", "order", "kind", "end", "base", "value"))).alias("spans"))
    return rows.join(spans, rows["row"] == spans["span_row"], "left").drop("span_row")


def q_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: personal data of every document."""
    found = find(documents(spark, sf_dir))
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
                        text(spans).alias("spans"))
