"""Periodic run detection by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
and that is at least ``least`` words and ``repeats`` periods long. A word of a run comes back in
it at least ``repeats`` times, so a word that is rarer than that in its segment (at first the
whole text) belongs to no run there: such words split the segment. Parts are counted anew and
split again until none changes; parts shorter than ``least`` are dropped. Splitting is exact
pruning: no run touches a split.

The surviving segments are scanned lag by lag. A run of period q is a stretch of
m = max(least - q, (repeats - 1) * q) or more positions whose word equals the word q later, and any
such stretch holds a whole block of b = (m + 1) // 2 positions that starts at a multiple of b. So lag
q needs n / b block comparisons, n log n over all lags. Blocks are compared by numbers that stand
for stretches of 1, 2, 4 ... words and are equal for equal stretches only (each level numbers pairs of
the level below), so nothing is hashed; matching blocks are widened by descending the same levels.
A stretch found at a multiple of its smallest period has been found at that period before.

Cost: splitting counts all segments of a batch at once for ``ROUNDS`` rounds; a text that then still
loses words bit by bit goes on with counts in which only the smaller part of a split is
counted anew, so the worst case stays n log n. Memory of a segment: four bytes a word and level.

Defined results: null and empty text have no words, no runs and an empty collapsed text; texts are
read whole whatever their length; repeated rows are handled each; an empty table gives an empty
result; the carried columns come back as the struct ``doc`` and clash with nothing. Words are
compared exactly, case included.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import wordlist
from rowsmith.llm.common import documents, id_crc, slices, text_session

LEAST = 24
REPEATS = 3
#: Rounds of splitting over a whole batch before segments are settled one by one.
ROUNDS = 24
SPACE = wordlist.separators(space=True)


def _settle(codes: np.ndarray, lo: int, hi: int, least: int, repeats: int) -> list[tuple[int, int]]:
    """The stable parts of one segment; after a split only the smaller part is counted."""
    word = codes[lo:hi].tolist()
    where = defaultdict(list)
    for i, c in enumerate(word):
        where[c].append(i)
    count = Counter(word)
    out, todo = [], [(0, len(word), count, [i for c, n in count.items() if n < repeats for i in where[c]])]
    while todo:
        a, b, count, rare = todo.pop()
        if b - a < least:
            continue
        if not rare:
            out.append((lo + a, lo + b))
            continue
        cuts = sorted(rare)
        parts = list(zip([a] + [i + 1 for i in cuts], cuts + [b]))
        large = max(parts, key=lambda p: p[1] - p[0])
        gone = Counter(word[i] for i in cuts)
        for p in parts:
            if p != large:
                own = Counter(word[p[0]:p[1]])
                gone.update(own)
                if p[1] - p[0] >= least:
                    todo.append((*p, own, [i for i in range(*p) if own[word[i]] < repeats]))
        count.subtract(gone)
        todo.append((*large, count, [i for c in gone if 0 < count[c] < repeats for i in _within(where[c], *large)]))
    return out


def _within(places: list[int], lo: int, hi: int) -> list[int]:
    a, b = np.searchsorted(places, [lo, hi]).tolist()
    return places[a:b]


def split(codes: np.ndarray, rows: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """(start, stop) of the segments that survive frequency splitting, over the words of all rows."""
    live = np.stack([rows[:-1], rows[1:]], axis=1)
    live = live[live[:, 1] - live[:, 0] >= least]
    done, span = [], int(codes.max()) + 1 if len(codes) else 1
    for _ in range(ROUNDS):
        if not len(live):
            break
        size = live[:, 1] - live[:, 0]
        segment = np.repeat(np.arange(len(live)), size)
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(live[:, 0] - (ends - size), size)
        names = pd.factorize(segment * span + codes[place])[0]
        rare = np.bincount(names)[names] < repeats
        hit = np.zeros(len(live), bool)
        hit[segment[rare]] = True
        done.append(live[~hit])
        cut = place[rare]       # the parts between rare words
        starts = np.sort(np.concatenate([live[hit, 0], cut + 1]))
        stops = np.sort(np.concatenate([cut, live[hit, 1]]))
        live = np.stack([starts, stops], axis=1)
        live = live[live[:, 1] - live[:, 0] >= least]
    for lo, hi in live.tolist():
        done.append(np.array(_settle(codes, lo, hi, least, repeats), np.int64).reshape(-1, 2))
    return np.concatenate(done) if done else np.zeros((0, 2), np.int64)


def _levels(codes: np.ndarray, size: np.ndarray, longest: int) -> list[np.ndarray]:
    """levels[k][i] names the 2^k words from i on; a level covers the segments (longest first)
    in which blocks of that length occur."""
    levels = [codes]
    while 2 << (len(levels) - 1) <= longest:
        half = 1 << (len(levels) - 1)
        below = levels[-1]
        n = int(size[size >= 2 * half].sum()) - 2 * half + 1
        pair = below[:n].astype(np.int64) * (int(below.max()) + 1) + below[half:half + n]
        levels.append(pd.factorize(pair)[0].astype(np.int32))
    return levels


def lag_scan(codes: np.ndarray, segments: np.ndarray, least: int = LEAST,
             repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs inside the segments, in the numbering of ``codes``."""
    if not len(segments):
        return []
    size = segments[:, 1] - segments[:, 0]
    order = np.argsort(-size, kind="stable")
    segments, size = segments[order], size[order]
    ends = np.cumsum(size)
    begins = ends - size
    shift = np.repeat(segments[:, 0] - begins, size)
    word = pd.factorize(codes[np.arange(ends[-1]) + shift])[0].astype(np.int32)
    most = int(size[0]) // repeats
    block_of = lambda q: (max(least - q, (repeats - 1) * q) + 1) // 2
    levels = _levels(word, size, max(block_of(q) for q in (1, most)))
    found: dict[tuple[int, int], int] = {}
    for q in range(1, most + 1):
        need = max(least, repeats * q)
        n = int(ends[np.searchsorted(-size, -need, "right") - 1])     # words of segments that are long enough
        b = block_of(q)
        k = b.bit_length() - 1
        name, tail = levels[k], b - (1 << k)
        last = min(n - q - b, len(name) - 1 - q - tail)
        if last < 0:
            continue
        same = name[:last + 1:b] == name[q:q + last + 1:b]
        if tail and same.any():
            same &= name[tail:tail + last + 1:b] == name[tail + q:tail + q + last + 1:b]
        if not same.any():
            continue
        at = np.flatnonzero(same) * b
        segment = np.searchsorted(ends, at, "right")
        fits = at + b + q <= ends[segment]
        at, segment = at[fits], segment[fits]
        if not len(at):
            continue
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(at) != b) | (np.diff(segment) != 0)
        lo, of = at[head], segment[head]
        hi = at[np.append(np.flatnonzero(head)[1:] - 1, len(at) - 1)] + b
        for j in range(k, -1, -1):
            step, level = 1 << j, levels[j]
            left = lo - step
            ok = left >= begins[of]
            ok[ok] = level[left[ok]] == level[left[ok] + q]
            lo = np.where(ok, left, lo)
            ok = hi + step + q <= ends[of]
            ok[ok] = level[hi[ok]] == level[hi[ok] + q]
            hi = np.where(ok, hi + step, hi)
        length = hi - lo + q
        enough = length >= need
        for s, n_words, g in zip(lo[enough].tolist(), length[enough].tolist(), of[enough].tolist()):
            found.setdefault((s + int(segments[g, 0] - begins[g]), n_words), q)
    return [(s, n, q) for (s, n), q in found.items()]


RUNS = "array<struct<start:long,length:long,period:long>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _work(texts: pa.Array, least: int, repeats: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, runs by start and period, collapsed text) of each text."""
    w = wordlist.find(texts, SPACE)
    codes = w.codes()
    runs = np.array(lag_scan(codes, split(codes, w.rows, least, repeats), least, repeats), np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    # words of a run after its first period go
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    row = np.searchsorted(w.rows, runs[:, 0], "right") - 1
    each = pa.StructArray.from_arrays([pa.array(runs[:, 0] - w.rows[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                                      names=["start", "length", "period"])
    at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    return (pa.array(np.diff(w.rows)), pa.ListArray.from_arrays(pa.array(at), each).cast(_ARROW_RUNS),
            wordlist.joined(w.words, w.rows, keep))


def find_runs(docs: DataFrame, text: str = "text", carry: list[str] | None = None, least: int = LEAST,
              repeats: int = REPEATS) -> DataFrame:
    """Every row as ``doc`` (a struct of all or the carried columns) with n_words, ``runs`` (by start,
    then period; word numbers from 0) and ``collapsed``: the text's words without those that a
    run repeats, joined by one space. Narrow: no shuffle."""
    if least < 1 or repeats < 2:
        raise ValueError("a run needs at least one word and two periods")
    text_session(docs.sparkSession)
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                n, runs, collapsed = _work(batch.column("text").slice(i, j - i), least, repeats)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, j - i), n, runs, collapsed],
                                                 names=["doc", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, f"doc {kind}, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smaller start, then period
    (``runs`` is in that order)."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where for h = crc32(doc_id) and g = h // 10 each tenth text (h % 10 = 0) of n
    words repeats, from word a = g % n on, its next p = 1 + (n - a) // (3 + g % 8) words."""
    h = id_crc(F.col("doc_id"))
    g = F.floor(h / 10)
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"))
    n = F.size("words")
    d = d.withColumn("n", n.cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    rest = F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")),
                                    F.ceil(rest / F.col("p")).cast("int")))
    planted = F.concat_ws(" ", F.slice("words", 1, F.col("a").cast("int")), F.slice(tail, 1, rest.cast("int")))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def q_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the runs of every document (a tenth of them with a planted repetition)."""
    found = find_runs(with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")), carry=["doc_id"])
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                  F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc.doc_id", "n_words", "runs", strongest(F.col("runs")).alias("best"), line.alias("lines"), "collapsed")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(F.concat_ws("", "lines"), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
