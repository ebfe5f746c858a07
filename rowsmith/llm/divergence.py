"""Source divergence audit over run-length columns.

Terms are runs of letters (A-Z, a-z with A-Z lower-cased, and non-ASCII characters). Each language keeps
the V terms found in at least ``least`` of its documents. A (lang, source) group, and each language, gives each kept term of
count c, zero included, the share p = 1 + floor(SCALE * (c + 1) / (N + V)), N its count over kept terms. A term
diverges by f = floor((p - q)^2 / q).

* ``pair``: each group against each other source of its language (q its share), f summed over all kept terms;
* ``term``: each group against its language (q its share), for terms it uses (c > 0) with p > q: the ``top`` largest f.

f depends on the two counts only. So terms with equal counts in every source of the language are one run: they are
grouped (one row and its length m), and the rows are range-sorted by their counts, which clusters equal
counts of a source too. Each range partition is a cell; in a cell every source's column is run-length encoded (runs
of zeros included, so absent terms cost nothing), and for a pair of sources the run boundaries are
intersected, f is taken once per piece and multiplied by its length. Cells give partial sums per pair; a
language's vocabulary is spread over all cells, and no task sees more than its cell and one row per source.

Counting: tasks sum counts per (lang, source, term) of a slice, Spark sums them before and after the shuffle, so a
source or term that holds a third of all words is a row per task. Arithmetic is exact in 64 bits (shares
by a two-step division): up to 2.8e14 words a language, and sums while (V + SCALE)^2 < 2^63.

Defined results: null text, lang and source are ''; a text without terms still makes its group occur; without
kept terms pair values are 0 and there is no term row; a language's only source has no pair row; texts are
read whole; repeated rows count each; ties go to the smaller item in UTF-8 order; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm import wordlist
from rowsmith.llm.common import documents, shuffle_partitions, slices, stored, text_session

LEAST = 3
TOP = 200
#: Shares are in parts of SCALE = HIGH * LOW; two factors keep products within 64 bits.
HIGH, LOW = 31_250, 32_000
SCALE = HIGH * LOW
#: Counts of a cell, about.
CELL = 1 << 20
#: Counts in a range key.
LEADING = 4
#: Bytes of text counted at once.
SLICE = 4 << 20
SEPARATOR = wordlist.separators(string.ascii_letters)


def _count(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n occurrences, df rows) of some texts."""
    w = wordlist.find(texts, SEPARATOR, lower=True)
    coded = w.words.dictionary_encode()
    terms, lang, source = coded.dictionary, langs.dictionary_encode(), sources.dictionary_encode()
    k, s = max(1, len(terms)), max(1, len(source.dictionary))
    row = np.repeat(np.arange(len(texts)), np.diff(w.rows))
    each, n = np.unique(row * k + coded.indices.to_numpy(), return_counts=True)
    group = lang.indices.to_numpy().astype(np.int64) * s + source.indices.to_numpy()
    names, group = np.unique(group, return_inverse=True)
    key, at = np.unique(group[each // k] * k + each % k, return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, at, n)
    of = names[key // k] if len(key) else key
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(of // s)), source.dictionary.take(pa.array(of % s)),
         terms.take(pa.array(key % k)).cast(pa.string()), pa.array(count), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))],
        names=["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) over all documents."""
    text_session(docs.sparkSession)
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]

    def work(batches):
        for batch in batches:
            for i, j in slices(batch.column("text"), SLICE):
                yield _count(*[batch.column(c).slice(i, j - i) for c in ("text", "lang", "source")])

    parts = docs.select(*blank).mapInArrow(work, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, counts): kept terms with their count per source that has them, by source."""
    return (term_counts(docs).groupBy("lang", "term")
            .agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
            .filter(F.col("df") >= least).drop("df"))


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per occurring (lang, source): words (its count over kept terms), all_words (its language's) and v."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = (kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("words")))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("all_words"), F.count(F.lit(1)).alias("v"))
    return groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)


def share(count: str, words: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (words + v)) of long columns, exact."""
    high, whole = f"(({count} + 1) * {HIGH})", f"({words} + v)"
    return F.expr(f"1 + ({high} div {whole}) * {LOW} + (({high} % {whole}) * {LOW}) div {whole}")


def _shares(counts: np.ndarray, whole: int) -> np.ndarray:
    high = (counts + 1) * HIGH
    return 1 + high // whole * LOW + high % whole * LOW // whole


def term_part(kept: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` terms of each group that diverge most above its language."""
    rows = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    rows = rows.join(sizes, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "words").alias("p"),
        share("total", "all_words").alias("q")).filter("p > q")
    rows = rows.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return _ranked(rows, "term").filter(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def run_length_rows(kept: DataFrame) -> DataFrame:
    """(lang, counts, m, cell, place): m terms have these counts; rows are range-sorted by their counts, a cell is one
    range, place the row's position. Written, so that cell and place belong to one layout."""
    runs = stored(kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("m")), "divergence-runs")
    entries = runs.agg(F.sum(F.size("counts"))).first()[0] or 0
    n = max(shuffle_partitions(kept.sparkSession), -(-entries // CELL))
    # Spark samples range keys on the driver: a few counts and a hash keep a key small however many sources there are
    rows = runs.repartitionByRange(n, "lang", F.slice("counts", 1, LEADING), F.xxhash64("counts"))
    return stored(rows.sortWithinPartitions("lang", "counts").withColumn("cell", F.spark_partition_id())
                      .withColumn("place", F.monotonically_increasing_id()), "divergence-cells")


def _column(place: np.ndarray, count: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of the runs of a column of ``total`` terms: from the (start, stop) of stretches with a
    count above zero, in order; the gaps are runs of zeros."""
    if not len(place):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    gap = np.append(place[1:, 0], total) > place[:, 1]
    lead = place[0, 0] > 0
    starts = np.insert(place[:, 0], np.flatnonzero(gap) + 1, place[gap, 1])
    values = np.insert(count, np.flatnonzero(gap) + 1, 0)
    if lead:
        starts, values = np.append(0, starts), np.append(0, values)
    first = np.append(True, values[1:] != values[:-1])
    return starts[first], values[first]


def pair_sums(counts: pa.Array, m: np.ndarray, sources: list[str], whole: list[int]) -> list[tuple[str, str, int]]:
    """(source, other, sum of f) over the given runs of terms, in order; ``whole``: the sources' N + V."""
    ends = np.cumsum(m)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return [(a, b, 0) for a in sources for b in sources if a != b]
    flat = counts.flatten()
    row = np.repeat(np.arange(len(counts)), pc.list_value_length(counts).to_numpy())
    source = pc.index_in(pc.struct_field(flat, "source"), value_set=pa.array(sources, pa.string())).to_numpy()
    order = np.argsort(source, kind="stable")
    at = np.searchsorted(source[order], np.arange(len(sources) + 1))
    n = pc.struct_field(flat, "n").to_numpy()[order]
    stretch = np.stack([ends - m, ends], axis=1)[row[order]]
    columns = []
    for k, w in enumerate(whole):
        starts, values = _column(stretch[at[k]:at[k + 1]], n[at[k]:at[k + 1]], total)
        columns.append((starts, _shares(values, w)))
    out = []
    for a, (sa, pa_) in enumerate(columns):
        for b in range(a + 1, len(columns)):
            sb, pb = columns[b]
            cut = np.union1d(sa, sb)
            length = np.diff(np.append(cut, total))
            x, y = pa_[np.searchsorted(sa, cut, "right") - 1], pb[np.searchsorted(sb, cut, "right") - 1]
            square = (x - y) ** 2
            out.append((sources[a], sources[b], int((square // y * length).sum())))
            out.append((sources[b], sources[a], int((square // x * length).sum())))
    return out


def pair_part(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every group against every other source of its language."""
    runs = run_length_rows(kept)
    # a cell without terms gives each pair its zero, so pairs without kept terms are there
    cells = runs.select(F.col("lang").alias("lang"), F.col("cell").alias("cell")).distinct().unionByName(sizes.select("lang", F.lit(-1).alias("cell")).distinct())
    own = sizes.select("lang", "source", (F.col("words") + F.col("v")).alias("whole")).join(cells, "lang")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("place").combine_chunks(), right.sort_by("source")
        counts = left.column("counts").chunk(0) if left.num_rows else None
        rows = pair_sums(counts, left.column("m").to_numpy(), right.column("source").to_pylist(), right.column("whole").to_pylist())
        lang = right.column("lang")[0].as_py()
        a, b, value = zip(*rows) if rows else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "source": pa.array(a, pa.string()),
                         "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    sums = (runs.groupBy("lang", "cell").cogroup(own.groupBy("lang", "cell"))
                .applyInArrow(work, "lang string, source string, item string, value long"))
    return _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others and by which terms."""
    kept = stored(vocabulary(docs, least), "divergence-terms")
    sizes = stored(group_sizes(docs, kept), "divergence-groups", narrow=True)
    return pair_part(kept, sizes).unionByName(term_part(kept, sizes, top))


def q_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the audit of all documents."""
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
grp AS (SELECT DISTINCT lang, source FROM doc),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0) AS c FROM grp g JOIN kept k ON g.lang = k.lang
          LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
own AS (SELECT *, 1 + 1000000000::hugeint * (c + 1) // (sum(c) OVER g + count(*) OVER g)::hugeint AS p
        FROM dense WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, 1 + 1000000000::hugeint * (c + 1) // (sum(c) OVER g + count(*) OVER g)::hugeint AS q
          FROM kept WINDOW g AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::bigint AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT o.lang, o.source, 'term', o.term, ((p - q) * (p - q) // q)::bigint
  FROM own o JOIN whole w ON o.lang = w.lang AND o.term = w.term WHERE o.c > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
"""
