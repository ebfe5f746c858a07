"""Mixing sources to target weights along a time-varying curriculum.

Sources by code point (null last) weigh 1, 2, 3 in turn and share all words; a target stops at
``CAP`` times its source's words and the rest is shared again, which is the level L with
sum(min(CAP * words, L * weight)) = total. A source's weight moves over training time t in
[0, 1] as 1 + a * (1 - 2t) (a = RAMP or -RAMP, so some sources come early and some late); its
integral t + a * (t - t*t) is the share of its words that training has asked for at t.

A source's documents come in the order of a seeded hash. Full passes take every document; the last, partial one
takes documents up to the hash at which the words taken are nearest to the target, found from word sums in
``BUCKETS`` hash buckets per source (pre-aggregated, so a hot source is no hot task): first for
documents that are large against the pass (over 1 / ``FINE`` of it), then for the others, which
make up for what the large ones take too much or too little.

The words that a pass of a document comes after, over all words its source gives, is its cumulative demand:
words of earlier passes, of earlier buckets (prefix sums), and of its own bucket before its hash. There, documents of
over 1 / ``BUCKETS`` of their source (fewer than ``BUCKETS`` a source) count one by one, and the others by the share of
the bucket that lies before the hash; so a position is right to the small documents of one bucket. Inverting the
integral gives the pass its training position. Output partitions are equal stretches of training time, which hold
about equal words; no range bounds are sampled.

Defined results: null text has no words; null is a source of its own; a document without words is
never taken; repeated rows share a hash and are taken alike, but rows of a doc_id (or none) that more than
``REPEATS`` rows share get hashes of their own; an empty table gives an empty result;
all columns, whatever their names, are carried. Nothing grows with the number of sources on the driver or in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import documents, shuffle_partitions, stored, with_repeat
from rowsmith.operators.keys import dense_index

CAP = 3
WEIGHTS = (1, 2, 3)
RAMP = 0.5
BUCKETS = 4096
FINE = 64
SEED = 77
#: Rows that may share a doc_id and with it a hash.
REPEATS = 1024
#: Levels of the target search that the driver takes at once, and rows of a plan that is broadcast.
LEVELS = 4096
BROADCAST_ROWS = 1 << 17


def words(text: Column) -> Column:
    """Number of runs of characters other than white space (space, tab to carriage return)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _sized(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row as ``doc`` (a struct of all or the carried columns) with src, size and its hash in [0, 1)."""
    row = with_repeat(docs, REPEATS).select(F.struct(*docs.columns).alias("all"), F.col("repeat").alias("copy"))
    doc = F.col("all") if carry is None else F.struct(*[F.col(f"all.{c}").alias(c) for c in carry])
    h = F.xxhash64(F.lit(SEED), F.col("all.doc_id"), F.col("all.text"), F.col("copy"))
    return row.select(doc.alias("doc"), F.col("all.source").alias("src"), words(F.col("all.text")).alias("size"),
                      (F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))).alias("hash"))


def fill_level(sums: DataFrame) -> float:
    """The level L with sum(min(CAP * source_size, L * weight)) = total over (source_size, weight) rows. The driver
    sees at most ``LEVELS`` sums: while more distinct levels are open, sums between their quantiles narrow them."""
    level = stored(sums.groupBy((CAP * F.col("source_size") / F.col("weight")).alias("level")).agg(
        F.sum(CAP * F.col("source_size")).alias("capped"), F.sum("weight").alias("weight"),
        F.sum("source_size").alias("size")), "mix-levels", narrow=True)
    total, free = level.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    capped, inside = 0, level       # what lies below the open levels takes capped words, the others weigh free
    while inside.count() > LEVELS:
        marks = [k / 64 for k in range(1, 65)]
        edges = sorted(set(inside.agg(F.percentile_approx("level", marks, 10_000)).first()[0]))
        step = sum((F.col("level") > x).cast("int") for x in edges)
        found = {r["step"]: r for r in inside.groupBy(step.alias("step")).agg(
            F.sum("capped").alias("capped"), F.sum("weight").alias("weight")).collect()}
        for k, x in enumerate(edges):
            more, weight = (found[k]["capped"], found[k]["weight"]) if k in found else (0, 0)
            if capped + more + x * (free - weight) > total:
                inside = inside.filter(F.col("level") <= x)
                break
            capped, free = capped + more, free - weight
            inside = inside.filter(F.col("level") > x)
    for r in sorted(inside.collect(), key=lambda r: r["level"]):
        if r["level"] >= (total - capped) / free:
            break
        capped, free = capped + r["capped"], free - r["weight"]
    return (total - capped) / free if free else 0.0


def targets(sums: DataFrame) -> DataFrame:
    """(name, source_size, target, passes, rest, ramp) of (src, source_size): passes are full ones, rest the words of
    the partial one. Sources are numbered by a range partition, not in one task."""
    order = sums.withColumn("order", F.struct(F.col("src").isNull().alias("last"), F.col("src").alias("src")))
    named = dense_index(order, "order", "number")[0].drop("order").withColumn("n", F.col("number") - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS) + 1).cast("int")))
    target = F.least((CAP * F.col("source_size")).cast("double"), F.lit(fill_level(named)) * F.col("weight"))
    s = named.withColumn("target", target).withColumn("passes", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    return s.select(F.col("src").alias("name"), "source_size", "target", "passes",
                    (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
                    F.when(F.col("n") % 2 == 0, RAMP).otherwise(-RAMP).alias("ramp"))


def plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, buckets). A row per source: name, source_size, target, passes, rest, large_cut and small_cut (hashes
    below which the partial pass takes), ramp and given (words it gives in all). A row per source and hash bucket that has
    documents: plan_src, plan_bucket; for full passes (full) and the partial one (part) the words ``before`` the bucket
    and the ``inner`` words of its small documents; and its ``giants`` (hash, size, whether in the partial pass), if
    any. Windows run over one source's buckets."""
    bucket, size_class = F.floor(F.col("hash") * BUCKETS).cast("int"), F.floor(F.log2("size")).cast("int")
    parts = stored(sized.groupBy("src", size_class.alias("size_class"), bucket.alias("bucket")).agg(F.sum("size").alias("w")),
                   "mix-parts", narrow=True)
    s = stored(targets(parts.groupBy("src").agg(F.sum("w").alias("source_size"))), "mix-targets", narrow=True)

    of_source = ["name", "source_size", "target", "passes", "rest", "ramp"]
    least = F.coalesce(F.pow(F.lit(2.0), "size_class"), F.lit(0.0))         # sizes of the class begin here
    e = parts.join(s, parts["src"].eqNullSafe(s["name"]))
    e = (e.withColumn("large", _large(least, F.col("rest"))).withColumn("giant", _giant(least)).groupBy(
        *of_source, "large", "bucket").agg(F.sum("w").alias("w"), F.sum(F.when(~F.col("giant"), F.col("w")).otherwise(0)).alias("inner")))
    group, own = Window.partitionBy("name"), Window.partitionBy("name", "large").orderBy("bucket")
    e = (e.withColumn("below", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("goal", F.col("rest") * F.sum(F.when(F.col("large"), F.col("w")).otherwise(0)).over(group)
                      / F.col("source_size")))

    def nearest(goal, rows):
        """(distance, words below, cut) of the bucket edge nearest to a goal; taking none counts as one."""
        edge = F.struct(F.abs(F.col("below") - goal).alias("off"), F.col("below").cast("long").alias("words"),
                        ((F.col("bucket") + 1) / F.lit(float(BUCKETS))).alias("cut"))
        none = F.struct(F.abs(goal).alias("off"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("cut"))
        return F.least(none, F.coalesce(F.min(F.when(rows, edge)).over(group), none))

    e = e.withColumn("big", nearest(F.col("goal"), F.col("large")))
    e = e.withColumn("small", nearest(F.col("rest") - F.col("big.words"), ~F.col("large")))
    e = e.withColumn("large_cut", F.col("big.cut")).withColumn("small_cut", F.col("small.cut"))
    taken = F.when(F.col("bucket") / F.lit(float(BUCKETS)) < _cut(F.col("large")), 1).otherwise(0)
    e = e.groupBy(*of_source, "large_cut", "small_cut", "bucket").agg(
        F.sum("w").alias("full"), F.sum(F.col("w") * taken).alias("part"),
        F.sum("inner").alias("full_inner"), F.sum(F.col("inner") * taken).alias("part_inner"))
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    e = e.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("full", "part")],
                 (F.col("passes") * F.col("source_size") + F.sum("part").over(group)).alias("given"))

    # fewer than BUCKETS documents a source, found through the sources' sizes alone
    big = sized.select("src", "size", "hash").filter("size > 0").join(s, F.col("src").eqNullSafe(F.col("name"))).filter(
        _giant(_class(F.col("size"))))
    big = big.groupBy(F.col("src").alias("big_src"), bucket.alias("big_bucket")).agg(F.collect_list(F.struct(
        "hash", "size", _class(F.col("size")).alias("least"))).alias("giants"))
    e = e.join(big, F.col("name").eqNullSafe(F.col("big_src")) & (F.col("bucket") == F.col("big_bucket")), "left")
    part = F.transform("giants", lambda g: F.struct(g["hash"].alias("hash"), g["size"].alias("size"), (
        g["hash"] < _cut(_large(g["least"], F.col("rest")))).alias("part")))
    e = stored(e.withColumn("giants", part), "mix-plan", narrow=True)
    sources = e.groupBy(*of_source, "large_cut", "small_cut", "given").agg(F.count(F.lit(1)).alias("buckets")).drop("buckets")
    buckets = e.select(F.col("name").alias("plan_src"), F.col("bucket").alias("plan_bucket"), "full_before", "full_inner",
                       "part_before", "part_inner", "giants")
    return stored(sources, "mix-sources", narrow=True), buckets


def _class(size: Column) -> Column:
    """The least size of a size's class (a power of two)."""
    return F.pow(F.lit(2.0), F.floor(F.log2(size)))


def _large(least: Column, rest: Column) -> Column:
    """Whether documents of a size class are large against a partial pass."""
    return F.coalesce(least > rest / FINE, F.lit(False))


def _giant(least: Column) -> Column:
    """Whether documents of a size class are counted one by one."""
    return least * BUCKETS > F.col("source_size")


def _cut(large: Column) -> Column:
    return F.when(large, F.col("large_cut")).otherwise(F.col("small_cut"))


def assign(docs: DataFrame, carry: list[str] | None = None, sized: DataFrame | None = None) -> DataFrame:
    """Every row as ``doc`` (a struct of all or the carried columns) with size, source_size, target,
    taken, the training positions (0 to 1) of its passes, none if it is left out, and u: the share of its
    source's words that a full pass asks for before it. ``sized``: the rows of ``_sized`` if they are written."""
    rows = _sized(docs, carry) if sized is None else sized
    narrow = rows.select("src", "size", "hash") if sized is not None else stored(rows.select("src", "size", "hash"), "mix-sizes")
    sources, buckets = plan(narrow)
    if buckets.count() <= BROADCAST_ROWS:       # else Spark chooses; a row is about 100 bytes
        buckets = F.broadcast(buckets)
    rows = rows.withColumn("bucket", F.floor(F.col("hash") * BUCKETS).cast("int")).join(sources, F.col("src").eqNullSafe(F.col("name")))
    rows = rows.join(buckets, F.col("src").eqNullSafe(F.col("plan_src")) & (F.col("bucket") == F.col("plan_bucket")))
    in_part = F.col("hash") < _cut(_large(_class(F.col("size")), F.col("rest")))
    copies = F.when(F.col("size") > 0, F.col("passes") + in_part.cast("long")).otherwise(F.lit(0))
    inside = F.col("hash") * BUCKETS - F.col("bucket")

    def before(kind, counts):
        giants = F.aggregate("giants", F.lit(0).cast("long"), lambda n, g: n + F.when(
            (g["hash"] < F.col("hash")) & counts(g), g["size"]).otherwise(0))
        return F.col(f"{kind}_before") + F.col(f"{kind}_inner") * inside + F.coalesce(giants, F.lit(0))

    rows = (rows.withColumn("copies", copies.cast("int")).withColumn("before", before("full", lambda g: F.lit(True)))
                .withColumn("before_part", before("part", lambda g: g["part"])))

    def position(i):
        words_before = F.when(i < F.col("passes"), i * F.col("source_size") + F.col("before")).otherwise(
            F.col("passes") * F.col("source_size") + F.col("before_part"))
        done = F.least(words_before / F.col("given"), F.lit(1.0))      # share of the source's words asked for before
        b = 1 + F.col("ramp")                                          # t * b - ramp * t * t = done
        return (b - F.sqrt(b * b - 4 * F.col("ramp") * done)) / (2 * F.col("ramp"))

    at = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(
        F.array().cast("array<double>"))
    return rows.select("doc", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                       at.alias("positions"), F.when(F.col("size") > 0, F.col("before") / F.col("source_size"))
                       .otherwise(F.col("hash")).alias("u"))


def _in_order(rows: DataFrame, order: str, most: float, partitions: int) -> DataFrame:
    """Rows in partitions of equal stretches of ``order`` (0 to ``most``), sorted inside."""
    part = F.least(F.floor(F.col(order) / most * partitions), F.lit(partitions - 1)).cast("int")
    return rows.repartitionById(partitions, part).sortWithinPartitions(order)


def mix(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mixture: the columns of ``docs``, a row per pass, in order of training position."""
    rows = assign(docs).select("doc", F.explode("positions").alias("position"))
    return _in_order(rows, "position", 1.0, partitions or shuffle_partitions(docs.sparkSession)).select("doc.*")


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents with the words that the mix takes, in order of their first position."""
    sized = stored(_sized(documents(spark, sf_dir), ["doc_id"]), "mix-documents")
    rows = assign(documents(spark, sf_dir), ["doc_id"], sized)
    first = F.get("positions", F.lit(0))
    # documents left out follow, spread by their place in the source
    rows = rows.withColumn("first_position", first).withColumn("order", F.coalesce(first, 1 + F.col("u")))
    return _in_order(rows, "order", 2.0, shuffle_partitions(spark)).select(
        "doc.doc_id", "size", "source_size", "target", "taken", "positions", "first_position")
