"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text's letters (lower-cased; runs of other characters count as one blank) give n-grams of 1
to ``LONGEST`` characters. A language's profile is the ranking of its ``PROFILE`` most frequent
n-grams, counted over all training texts with Spark aggregations. A document's own ranking is
compared with each profile: an n-gram's distance is the difference of its two ranks, or
``PROFILE`` if the profile lacks it; the language with the least mean distance wins.

The score is the share of the greatest possible distance that the winner saves, so it is 0 for a
text that shares no n-gram with any profile, and low for very short texts. Ties in counts go to
the smaller n-gram, ties in distance to the language first in code point order. Null text and text
without letters is ``und`` with score 0; a text of any length is profiled whole; without
training rows everything is ``und``; repeated rows are scored each; an alphabet of any size is counted
exactly; extra columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import documents, id_crc, slices, text_session

LONGEST = 3
PROFILE = 400
UNKNOWN = "und"
#: Score below which the pipeline rejects a document: it shares next to nothing with any profile.
REJECT_BELOW = 0.05
SLICE = 1 << 19


@functools.cache
def _letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = True
    return out


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count, alphabet): all n-grams of the texts, row by row. A gram is a number in
    base len(alphabet) + 1 whose digits are alphabet places plus one (blank: place of a space)."""
    rows = [x.lower() if x else "" for x in texts.to_pylist()]
    size = np.array([len(x) for x in rows], np.int64)
    code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(rows), dtype=np.int64), size)
    letter = _letter_table()[code]
    # drop all but the first of a run of other characters, and blanks at a row's ends
    first_of_row = np.ones(len(code), bool)
    first_of_row[1:] = row[1:] != row[:-1]
    after_letter = np.zeros(len(code), bool)
    after_letter[1:] = letter[:-1] & ~first_of_row[1:]
    keep = letter | after_letter
    code, row, letter = code[keep], row[keep], letter[keep]
    seen = np.zeros(0x110000, bool)
    seen[code[letter]] = True
    alphabet = np.concatenate([[0x20], np.flatnonzero(seen)])
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    digit = np.where(letter, place[code], 1)
    base = len(alphabet) + 1
    grams, owners = [], []
    value = np.zeros(len(digit), np.int64)
    for n in range(1, LONGEST + 1):
        if len(digit) < n:
            break
        value = value[:len(digit) - n + 1] * base + digit[n - 1:]
        fits = row[:len(value)] == row[n - 1:]
        if n == 1:
            fits &= letter
        grams.append(value[fits])
        owners.append(row[:len(value)][fits])
    if not grams:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, alphabet
    span, names = base ** LONGEST, None
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    if len(rows) * span >= 1 << 63:         # row and gram don't fit one number: number the grams that occur
        names, grams = np.unique(grams, return_inverse=True)
        span = len(names)
    key = owners * span + grams
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    gram = key % span
    return key // span, gram if names is None else names[gram], count, alphabet


def _spell(gram: int, alphabet: np.ndarray) -> str:
    out = []
    while gram:
        gram, d = divmod(int(gram), len(alphabet) + 1)
        out.append(chr(alphabet[d - 1]))
    return "".join(reversed(out))


def _value(text: str, alphabet: np.ndarray, place: dict[int, int]) -> int | None:
    v = 0
    for c in text:
        if ord(c) not in place:
            return None
        v = v * (len(alphabet) + 1) + place[ord(c)]
    return v


def profiles(training: DataFrame, size: int = PROFILE) -> dict[str, list[str]]:
    """language -> its ``size`` most frequent n-grams in order, over all rows of
    (text, lang). Collects ``size`` short strings a language."""
    text_session(training.sparkSession)

    def count(batches):
        for batch in batches:
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column(0).filter(pc.equal(langs, lang))
                for i, j in slices(texts, SLICE):
                    _, gram, n, alphabet = _grams(texts.slice(i, j - i))
                    order = np.argsort(gram, kind="stable")
                    gram, n = gram[order], n[order]
                    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else []
                    total = np.add.reduceat(n, first) if len(gram) else n
                    names = [_spell(g, alphabet) for g in gram[first]] if len(gram) else []
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(names), pa.string()), "gram": pa.array(names, pa.string()),
                        "n": pa.array(total, pa.int64())})

    counts = training.filter("lang is not null").select("text", "lang").mapInArrow(
        count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # grams of up to three letters: one row each; only the first `size` of a language leave the window
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= size)
    out: dict[str, list[tuple[int, str]]] = {}
    for r in top.collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(v)] for lang, v in sorted(out.items())}


def _distances(texts: pa.Array, model: dict[str, list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean distance of every row to every language, number of ranked n-grams of every row)."""
    row, gram, count, alphabet = _grams(texts)
    order = np.lexsort((gram, -count, row))
    row, gram = row[order], gram[order]
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    rank = np.arange(len(row)) - edges[row]
    top = rank < size
    row, gram, rank = row[top], gram[top], rank[top]
    place = {int(c): i + 1 for i, c in enumerate(alphabet)}
    known: dict[int, dict[int, int]] = {}
    for k, lang in enumerate(model):
        for r, g in enumerate(model[lang]):
            v = _value(g, alphabet, place)
            if v is not None:
                known.setdefault(v, {})[k] = r
    values = np.array(sorted(known), np.int64)
    ranks = np.full((len(values) + 1, len(model)), -1, np.int64)
    for i, v in enumerate(values.tolist()):
        for k, r in known[v].items():
            ranks[i, k] = r
    at = np.searchsorted(values, gram)
    at[(at >= len(values)) | (values[np.minimum(at, len(values) - 1)] != gram if len(values) else True)] = len(values)
    n = np.bincount(row, minlength=len(texts))
    out = np.zeros((len(texts), len(model)))
    for k in range(len(model)):
        other = ranks[at, k]
        far = np.where(other < 0, size, np.abs(other - rank))
        out[:, k] = np.bincount(row, far, minlength=len(texts)) / np.maximum(n, 1)
    return out, n


def predict(docs: DataFrame, model: dict[str, list[str]], size: int = PROFILE) -> DataFrame:
    """Every row as ``doc`` (a struct of its columns) with lang_pred and score."""
    text_session(docs.sparkSession)
    langs = list(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts):
        import pandas as pd
        arr = pa.array(texts, pa.string(), from_pandas=True)
        names, scores = [], []
        for i, j in slices(arr, SLICE):
            far, n = _distances(arr.slice(i, j - i), model, size)
            if not langs:
                names += [UNKNOWN] * (j - i)
                scores += [0.0] * (j - i)
                continue
            best = far.argmin(axis=1)
            names += [langs[b] if c else UNKNOWN for b, c in zip(best.tolist(), n.tolist())]
            scores += np.where(n > 0, 1 - far[np.arange(j - i), best] / size, 0.0).tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return (docs.select(F.struct("*").alias("doc")).withColumn("found", identify(F.col("doc.text")))
                .select("doc", "found.lang_pred", "found.score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` without documents whose language can't be told: ``und`` or a score
    below ``REJECT_BELOW``. Profiles are learned from all labelled rows of ``docs``."""
    model = profiles(docs)
    return (predict(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= REJECT_BELOW))
                                .select("doc.*"))


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's language, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    held_out = id_crc(F.col("doc_id")) % 3 == 1
    model = profiles(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc.doc_id", (id_crc(F.col("doc.doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score")
