"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the others, whatever their label, are an unlabelled sample
that holds some more. Linear numpy classifiers over the presence of words minimise the
class-prior-corrected logistic risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): where a
mini-batch's second part turns negative, which is overfitting, the step goes the other way.

The sample is bounded by ``POSITIVES`` and ``UNLABELLED`` documents, the first by a seeded hash
of doc_id; the class prior is the share of toxic labels over all training labels. Features are words (runs
of letters, without case) and their beginnings of ``PREFIXES`` bytes; those seen in at least ``LEAST`` positives
and ``LEAST_SHARE`` of them whose document frequencies differ by ``SIGNIFICANT`` standard errors are ranked by that, and
the ``VOCABULARY`` best are kept. ``MODELS`` classifiers learn in parallel tasks from different draws of the sample; a score
is the logistic function of their mean, moved so that 0.5 lies in the widest gap near the class prior of
the outputs of all training documents, whose histogram of at most ``BINS`` bins Spark counts.

Defined results: null and empty texts have the score of a text without known words; a doc_id
labelled both ways is toxic; null labels are none; without positives or other texts every
score is 0; repeated rows are scored each; columns other than doc_id and text are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import wordhash
from rowsmith.llm.common import documents, id_crc, slices, stored, table, text_session

POSITIVES = 4096
UNLABELLED = 12288
VOCABULARY = 4096
LEAST = 4
LEAST_SHARE = 0.004
PREFIXES = (4, 5, 6)
#: Standard errors by which a feature's document frequencies must differ.
SIGNIFICANT = 5.0
MODELS = 3
#: Shares of the class prior between which the rank of the last toxic document is looked for, at least;
#: and the standard errors of the prior by which it may lie elsewhere.
NEAR_PRIOR = (0.8, 1.05)
ERRORS = 2.0
#: Bins of the outputs above 0, and bins to a unit of output (the last bin takes all beyond).
BINS = 16384
BINS_PER_UNIT = 256
STEPS = 400
BATCH = 1024
RATE = 0.03
RIDGE = 3e-4
SEED = 31


@dataclass(frozen=True)
class Model:
    words: np.ndarray        # sorted 64-bit word hashes
    weights: np.ndarray      # mean of the classifiers
    bias: float


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of every row, and the rows' offsets into them."""
    hashes, edges = wordhash.words(texts, wordhash.NOT_LETTER, PREFIXES)
    return hashes.ravel(), edges * (1 + len(PREFIXES))


def _known(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, vocabulary place) of the distinct known words of every row, in order."""
    hashes, edges = _features(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(edges))
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes
    key = np.unique(row[hit] * len(vocabulary) + at[hit])
    return key // len(vocabulary), key % len(vocabulary)


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, int]:
    """(doc_id, positive) of the bounded training sample, the class prior and the labels it is from."""
    spread = F.xxhash64(F.lit(SEED), "doc_id")
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior, n = known.agg(F.avg((F.col("toxic") == 1).cast("double")), F.count(F.lit(1))).first()
    toxic = known.filter("toxic = 1").select("doc_id").orderBy(spread, "doc_id").limit(POSITIVES)
    other = docs.select("doc_id").distinct().orderBy(spread, "doc_id").limit(UNLABELLED)
    return stored(toxic.withColumn("positive", F.lit(True)).unionByName(other.withColumn("positive", F.lit(False))),
                  "toxic-sample"), prior or 0.0, n


def _selected(found: DataFrame) -> np.ndarray:
    """The vocabulary: sorted hashes of the words whose document frequencies differ most."""

    def count(batches):
        for batch in batches:
            positive = batch.column(0).to_numpy(zero_copy_only=False)
            each = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not each:
                continue
            value, at = np.unique(np.concatenate(each), return_inverse=True)
            of = np.repeat(positive, [len(x) for x in each])
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(value.view(np.int64)), "p": pa.array(np.bincount(at[of], minlength=len(value)), pa.int64()),
                "u": pa.array(np.bincount(at[~of], minlength=len(value)), pa.int64())})

    total = found.agg(F.sum(F.col("positive").cast("long")).alias("p"),
                      F.sum((~F.col("positive")).cast("long")).alias("u")).first()
    if not total["p"] or not total["u"]:
        return np.zeros(0, np.uint64)
    counts = found.select("positive", "words").mapInArrow(count, "word long, p long, u long").groupBy("word").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")).filter(
        F.col("p") >= max(LEAST, LEAST_SHARE * total["p"]))
    p, u = F.col("p") / float(total["p"]), F.col("u") / float(total["u"])
    pooled = (F.col("p") + F.col("u") + 1) / float(total["p"] + total["u"] + 2)
    z = F.abs(p - u) / F.sqrt(pooled * (1 - F.least(pooled, F.lit(0.999))) * (1 / total["p"] + 1 / total["u"]))
    best = counts.select("word", z.alias("z")).filter(F.col("z") >= SIGNIFICANT).orderBy(F.col("z").desc(), "word").limit(VOCABULARY).collect()
    return np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))


def _train(rows: list[np.ndarray], positive: np.ndarray, features: int, prior: float, seed: int) -> np.ndarray:
    """Weights and, last, the bias of one classifier."""
    rng = np.random.default_rng(seed)
    size = np.array([len(r) for r in rows])
    start = np.cumsum(size) - size
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    w, m, v = (np.zeros(features + 1) for _ in range(3))
    w[-1] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    # each classifier sees another draw of both
    pos, unl = (rng.choice(x, max(1, len(x) * 4 // 5), replace=False) for x in (pos, unl))

    def batch(of):
        pick = of if len(of) <= BATCH else rng.choice(of, BATCH, replace=False)
        at = np.concatenate([flat[start[i]:start[i] + size[i]] for i in pick]) if size[pick].sum() else flat[:0]
        own = np.repeat(np.arange(len(pick)), size[pick])
        return at, own, len(pick)

    for t in range(1, STEPS + 1):
        (ap, op, np_), (au, ou, nu) = batch(pos), batch(unl)
        fp = np.bincount(op, w[ap], minlength=np_) + w[-1]
        fu = np.bincount(ou, w[au], minlength=nu) + w[-1]
        risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        if risk >= 0:
            gp, gu = -prior * (1 - sp) / np_ - prior * sp / np_, su / nu
        else:
            gp, gu = prior * sp / np_, -su / nu
        g = np.zeros(features + 1)
        g[:-1] = np.bincount(ap, gp[op], minlength=features) + np.bincount(au, gu[ou], minlength=features) + RIDGE * w[:-1]
        g[-1] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both training rows only."""
    text_session(docs.sparkSession)
    sample, prior, labelled = _sample(docs, labels)

    def scan(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                hashes, edges = _features(batch.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_pydict({
                    "positive": batch.column(0).slice(i, j - i),
                    "words": pa.array([np.unique(hashes[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                    "spread": batch.column(2).slice(i, j - i)})

    # at most POSITIVES + UNLABELLED ids
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = stored(picked.select("positive", "text", F.xxhash64(F.lit(SEED), "doc_id", "text"))
                         .mapInArrow(scan, "positive boolean, words binary, spread long"), "toxic-words")
    vocabulary = _selected(found)
    if not len(vocabulary):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)

    def shrink(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                x = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
                rows.append(at[vocabulary[at] == x].astype(np.int32).tobytes())
            for k in range(MODELS):
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array([k] * len(rows), pa.int32()), "positive": batch.column(0),
                    "places": pa.array(rows, pa.binary()), "spread": batch.column(2)})

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by([("spread", "ascending"), ("positive", "ascending")])
        rows = [np.frombuffer(x, np.int32) for x in t["places"].to_pylist()]
        k = t["model"][0].as_py()
        w = _train(rows, t["positive"].to_numpy(), len(vocabulary), prior, SEED + k)
        return pa.table({"model": pa.array([k], pa.int32()), "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    trained = found.mapInArrow(shrink, "model int, positive boolean, places binary, spread long").groupBy("model") \
        .applyInArrow(train, "model int, w array<double>").collect()      # MODELS rows of VOCABULARY numbers
    w = np.mean([r["w"] for r in sorted(trained, key=lambda r: r["model"])], axis=0)

    model = Model(vocabulary, w[:-1], 0.0)
    return Model(vocabulary, w[:-1], -_boundary(*_histogram(docs, model), prior, labelled))


def _outputs(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for i, j in slices(texts):
        if len(model.words):
            row, at = _known(texts.slice(i, j - i), model.words)
            out[i:j] += np.bincount(row, model.weights[at], minlength=j - i)
    return out


def _histogram(docs: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """(documents, least, greatest output) of each bin of all documents' outputs above 0, the
    highest bin first, and the number of all documents. Collects at most ``BINS`` rows."""

    @F.pandas_udf("double")
    def output(texts):
        import pandas as pd
        return pd.Series(_outputs(pa.array(texts, pa.string(), from_pandas=True), model))

    at = F.when(F.col("f") > 0, F.least(F.floor(F.col("f") * BINS_PER_UNIT), F.lit(BINS - 1))).otherwise(-1)
    bins = docs.select(output("text").alias("f")).groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("f").alias("least"), F.max("f").alias("greatest")).collect()
    above = sorted((r for r in bins if r["bin"] >= 0), key=lambda r: -r["bin"])
    return np.array([(r["n"], r["least"], r["greatest"]) for r in above]).reshape(-1, 3), sum(r["n"] for r in bins)


def _boundary(bins: np.ndarray, total: int, prior: float, labelled: int) -> float:
    """Output at which a document counts as toxic: the middle of the widest gap between the bins of all
    outputs around the rank that the class prior gives to the last toxic one, above what a document without
    evidence gets. Where no bin is empty there, the lower end of the one with the fewest documents."""
    if not len(bins):
        return 1.0
    n, least, below = bins[:, 0], bins[:, 1], np.append(bins[1:, 2], 0.0)
    reached = np.cumsum(n).astype(np.int64)
    # labels of all documents leave the prior no error
    error = ERRORS * np.sqrt((1 - prior) / max(prior * labelled, 1) * max(0.0, 1 - labelled / total))
    near = min(NEAR_PRIOR[0], 1 - error), max(NEAR_PRIOR[1], 1 + error)
    lo, hi = (min(max(int(round(total * prior * x)), 1), reached[-1]) for x in near)
    inside = np.flatnonzero((reached >= lo) & (reached <= hi))
    if not len(inside):               # all in one bin, which is not cut
        inside = np.array([np.searchsorted(reached, lo)])
    gap = (least - below)[inside]
    k = inside[gap.argmax() if gap.max() >= 1 / BINS_PER_UNIT else n[inside].argmin()]
    return float(least[k] + below[k]) / 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row as ``doc`` (a struct of its columns) with its score (0 to 1)."""
    text_session(docs.sparkSession)

    @F.pandas_udf("double")
    def judge(texts):
        import pandas as pd
        out = _outputs(pa.array(texts, pa.string(), from_pandas=True), model)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))) if len(model.words) else np.zeros(len(out)))

    return docs.select(F.struct("*").alias("doc")).withColumn("score", judge(F.col("doc.text")))


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's toxicity, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    training = id_crc(F.col("doc_id")) % 5 != 0
    labels = table(spark, sf_dir, "labels").filter(training).select("doc_id", "toxic")
    model = fit(docs.filter(training), labels)
    return score(docs, model).select(
        "doc.doc_id", (id_crc(F.col("doc.doc_id")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
