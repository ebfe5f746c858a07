"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. A window is ``width``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

Items are cut into pieces of at most ``PIECE`` words that overlap by width - 1, so each window lies in
a piece. All pieces of a benchmark of up to ``PAYLOAD_BYTES`` go to the executors as one payload: the
vocabulary, the distinct windows' hashes (sorted, with a bit table before them), the pieces' words and the
windows' items. A larger benchmark is dealt by hash into several payloads of about that size; documents are
then scanned once per payload, and what one scan found is written with the documents for the next, so no task
ever holds more than one payload and nothing is dropped.

A scan numbers the documents' words by the payload's vocabulary (exactly; other words end a window), hashes
the windows without such words, looks the hashes up and verifies each hit word by word. Scans are narrow:
documents are never shuffled, however many of them share a passage.

Defined results: null, empty and wordless texts have no words and no hits; texts are read whole; repeated
rows are scanned each; items without words have no window; equal item ids count once, a null id is ''; item
ids are compared and sorted as strings; an empty benchmark leaves every document clean; an empty
table gives an empty result; the documents' columns travel in the struct ``doc`` and clash with nothing.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import wordlist
from rowsmith.llm.common import documents, gather_ranges, slices, stored, table, text_session

WIDTH = 10
#: Words of a piece besides the overlap, and bytes of pieces that a scan holds at most (one longer piece apart).
PIECE = 512
PAYLOAD_BYTES = 8 << 20
BITS_A_WINDOW = 16
SEPARATOR = wordlist.separators(string.ascii_letters + string.digits)
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_PLACE = np.random.default_rng(0xDEC0).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _normal_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(1))


def pieces(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, piece): the items' ids as strings and their words, in overlapping pieces joined by one space."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             _normal_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    at = words.select("item", "words", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE))).alias("at"))
    return at.select("item", F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.lit(PIECE + width - 1))).alias("piece"))


def _hashes(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of each stretch of ``width`` codes that begins at one of ``at``."""
    out = np.full(len(at), _PLACE[width + 16])
    for k in range(width):
        out += (codes[at + k].astype(np.uint64) + np.uint64(1)) * _PLACE[k]
    out ^= out >> np.uint64(29)
    out *= _PLACE[50]
    return out ^ (out >> np.uint64(32))


@dataclass
class Windows:
    """The distinct windows of one width: their hashes in order, where their words begin in the
    payload's codes, and their items (those of window w are items[at[w]:at[w + 1]])."""

    width: int
    hashes: np.ndarray
    begins: np.ndarray
    at: np.ndarray
    items: np.ndarray
    bits: np.ndarray
    most: int       # windows that share a hash


@dataclass
class Payload:
    vocabulary: pa.Array
    codes: np.ndarray
    names: pa.Array
    sets: list[Windows]


def _windows(codes: np.ndarray, rows: np.ndarray, owner: np.ndarray, width: int, full: int) -> Windows | None:
    """The distinct windows of ``width`` words: all of longer pieces, or the shorter pieces that are one window."""
    size = np.diff(rows)
    some = np.flatnonzero(size >= width if width == full else size == width)
    if not len(some):
        return None
    count = size[some] - width + 1
    begin = gather_ranges(rows[:-1][some], count).astype(np.int64)
    item = np.repeat(owner[some], count)
    h = _hashes(codes, begin, width)
    order = np.lexsort((item, begin, h))
    begin, item, h = begin[order], item[order], h[order]
    # windows of equal hash are neighbours; those spelled alike are made one
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    for k in range(width):
        fresh[1:] |= codes[begin[1:] + k] != codes[begin[:-1] + k]
    window = np.cumsum(fresh) - 1
    pair = np.unique(window * (int(item.max()) + 1) + item)
    at = np.searchsorted(pair // (int(item.max()) + 1), np.arange(int(window[-1]) + 2))
    hashes = h[fresh]
    log = max(10, int(BITS_A_WINDOW * len(hashes) - 1).bit_length())
    bits = np.zeros(1 << log, bool)
    bits[hashes >> np.uint64(64 - log)] = True
    same = np.unique(hashes, return_counts=True)[1]
    return Windows(width, hashes, begin[fresh], at, (pair % (int(item.max()) + 1)).astype(np.int32), bits, int(same.max()))


def payload(rows: list[tuple[str, str]], width: int) -> Payload:
    """The lookup tables of (item, piece) rows."""
    names = pa.array(sorted({r[0] for r in rows}), pa.string())
    number = {n: i for i, n in enumerate(names.to_pylist())}
    found = wordlist.find(pa.array([r[1] for r in rows], pa.string()), SEPARATOR)
    coded = found.words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32)
    owner = np.array([number[r[0]] for r in rows], np.int64)
    sets = [w for m in range(1, width + 1) if (w := _windows(codes, found.rows, owner, m, width))]
    return Payload(coded.dictionary, codes, names, sets)


def payloads(benchmark: DataFrame, width: int = WIDTH):
    """The benchmark's payloads, one after another: the driver holds one at a time, of bounded size."""
    rows = stored(pieces(benchmark, width).distinct(), "benchmark-pieces", narrow=True)
    total = rows.agg(F.sum(F.octet_length("piece") + F.octet_length("item"))).first()[0] or 0
    n = -(-total // PAYLOAD_BYTES)
    part = F.pmod(F.xxhash64("piece"), F.lit(max(1, n)))
    for k in range(n):
        some = [(r["item"], r["piece"]) for r in rows.filter(part == k).collect()]
        if some:
            yield payload(some, width)


def _scan(texts: pa.Array, p: Payload) -> tuple[wordlist.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, whether each word is hit, row of each find, its item's number): finds are distinct."""
    w = wordlist.find(texts, SEPARATOR, lower=True)
    n = len(w.words)
    codes = pc.fill_null(pc.index_in(w.words, value_set=p.vocabulary), -1).to_numpy().astype(np.int32)
    # known words from each word on, to its row's end
    stop = np.ones(n + 1, bool)
    stop[:n] = codes < 0
    stop[w.rows] = True
    edges = np.flatnonzero(stop)
    edge = np.zeros(n + 1, np.int64)
    finds = [np.zeros((0, 2), np.int64)]
    for s in p.sets:
        if n < s.width:
            continue
        start = np.arange(n - s.width + 1)
        start = start[(codes[:len(start)] >= 0)]
        after = edges[np.searchsorted(edges, start + 1)]      # the next unknown word or row start
        start = start[after - start >= s.width]
        if not len(start):
            continue
        h = _hashes(codes, start, s.width)
        some = s.bits[h >> np.uint64(64 - (len(s.bits) - 1).bit_length())]
        start, h = start[some], h[some]
        lo, hi = np.searchsorted(s.hashes, h, "left"), np.searchsorted(s.hashes, h, "right")
        for k in range(s.most):
            cand = np.flatnonzero(lo + k < hi)
            at, window = start[cand], lo[cand] + k
            same = np.ones(len(cand), bool)
            for j in range(s.width):
                same &= codes[at + j] == p.codes[s.begins[window] + j]
            at, window = at[same], window[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + s.width, -1)
            seen = np.unique(np.stack([np.searchsorted(w.rows, at, "right") - 1, window], axis=1), axis=0)
            count = s.at[seen[:, 1] + 1] - s.at[seen[:, 1]]
            items = s.items[gather_ranges(s.at[seen[:, 1]], count)]
            finds.append(np.stack([np.repeat(seen[:, 0], count), items], axis=1))
    found = np.unique(np.concatenate(finds), axis=0)
    return w, np.cumsum(edge[:-1]) > 0, found[:, 0], found[:, 1]


_SPAN = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())])


def _spans(w: wordlist.Words, hit: np.ndarray) -> pa.Array:
    """The maximal stretches of hit words of each row: first word, number of words and the UTF-8
    bytes from begin to stop."""
    n = len(hit)
    row = np.searchsorted(w.rows, np.arange(n), "right") - 1
    head = hit.copy()
    head[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    a, b = np.flatnonzero(head), np.flatnonzero(last)
    of = row[a]
    each = pa.StructArray.from_arrays([pa.array(x) for x in (a - w.rows[of], b - a + 1, w.starts[a] - w.text_at[of],
                                                             w.stops[b] - w.text_at[of])], fields=list(_SPAN))
    at = np.searchsorted(of, np.arange(len(w.rows))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), each)


def _words_of_spans(spans: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    """The words inside the spans of an earlier scan."""
    flat = spans.flatten()
    owner = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy())
    first = pc.struct_field(flat, "first").to_numpy() + rows[owner]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + pc.struct_field(flat, "words").to_numpy(), -1)
    return np.cumsum(edge[:-1]) > 0


FOUND = ("n_words long, n_hit long, items array<string>, "
         "spans array<struct<first:long,words:long,begin:long,stop:long>>")


def annotate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``doc`` (a struct of all or the carried columns) with n_words, n_hit, items
    (their ids as sorted strings) and spans (stretches of hit words: first word, words, and UTF-8 bytes)."""
    if not 1 <= width <= 32:
        raise ValueError("a window has 1 to 32 words")
    text_session(docs.sparkSession)
    none = "array()"
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col("text").alias("text"),
                       F.expr(f"cast({none} as array<string>)").alias("items"),
                       F.expr(f"cast({none} as array<struct<first:long,words:long,begin:long,stop:long>>)").alias("spans"))
    kind = rows.schema["doc"].dataType.simpleString()

    def scan(p: Payload, with_text: bool):
        def work(batches):
            for batch in batches:
                for i, j in slices(batch.column("text")):
                    part = batch.slice(i, j - i)
                    w, hit, row, item = _scan(part.column("text"), p)
                    hit = hit | _words_of_spans(part.column("spans"), w.rows, len(hit))
                    own = p.names.take(pa.array(item))
                    at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                    items = _united(part.column("items"), pa.ListArray.from_arrays(pa.array(at), own))
                    n_hit = np.add.reduceat(np.append(hit, 0).astype(np.int64), w.rows[:-1]) * (np.diff(w.rows) > 0)
                    out = {"doc": part.column("doc"), "n_words": pa.array(np.diff(w.rows)), "n_hit": pa.array(n_hit.astype(np.int64)),
                           "items": items, "spans": _spans(w, hit)}
                    if with_text:
                        out["text"] = part.column("text")
                    yield pa.RecordBatch.from_pydict(out)

        return work

    empty = Payload(pa.array([], pa.large_string()), np.zeros(0, np.int32), pa.array([], pa.string()), [])
    before, some = None, False
    for p in payloads(benchmark, width):
        if before is not None:      # more than one payload: what this scan finds is written for the next one
            rows = stored(rows.mapInArrow(scan(before, True), f"doc {kind}, {FOUND}, text string"), "scanned")
            rows = rows.select("doc", "text", "items", "spans")
        before, some = p, True
    return rows.mapInArrow(scan(before if some else empty, False), f"doc {kind}, {FOUND}")


def _united(a: pa.Array, b: pa.Array) -> pa.Array:
    """The lists of a and b, row by row, sorted and without repeats. Item numbers follow the
    names' order, so b's lists are sorted already."""
    if not len(a.flatten()):
        return b
    return pa.array([sorted({*x, *y}) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.string()))


def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the bytes of their spans."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    w = wordlist.find(texts, SEPARATOR)
    flat = spans.flatten()
    text_at = w.text_at[np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy())]
    edge = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(edge, pc.struct_field(flat, "begin").to_numpy() + text_at, 1)
    np.add.at(edge, pc.struct_field(flat, "stop").to_numpy() + text_at, -1)
    keep = np.cumsum(edge[:-1]) == 0
    at = np.concatenate([[0], np.cumsum(keep)])[w.text_at]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(w.data[keep])).cast(pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, remove: str = "spans",
                  from_share: float = 0.0) -> DataFrame:
    """The columns of ``docs``: without the texts' hit spans (``remove="spans"``), or without the documents that are hit
    (``remove="documents"``), where only documents with more than ``from_share`` of their words hit are touched."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove spans or documents, not {remove!r}")
    rows = annotate(docs, benchmark, width)
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") > from_share * F.col("n_words"))
    if remove == "documents":
        return rows.filter(~dirty).select("doc.*")
    rows = rows.select("doc", "spans", F.when(dirty, F.col("doc.text")).alias("text"))      # clean texts don't travel twice
    kind = rows.schema["doc"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                cut = without_spans(part.column("text"), part.column("spans")) if part.column("text").null_count < j - i else \
                    part.column("text")
                yield pa.RecordBatch.from_arrays([part.column("doc"), pc.is_valid(part.column("text")), cut],
                                                 names=["doc", "dirty", "cut"])

    rows = rows.mapInArrow(work, f"doc {kind}, dirty boolean, cut string")
    text = F.when(F.col("dirty"), F.col("cut")).otherwise(F.col("doc.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: what every document shares with the benchmark."""
    found = annotate(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT coalesce(item_id::varchar, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
spot AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
         FROM doc, (SELECT DISTINCT m FROM win), unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m),
find AS (SELECT r, spot.m, i, item FROM spot JOIN win ON spot.s = win.s AND spot.m = win.m),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM find, unnest(range(0, m)) AS u(j) GROUP BY r),
of AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM find) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(hit.n, 0)::bigint AS n_hit, coalesce(of.n, 0)::bigint AS n_items,
       sha256(coalesce(of.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN of USING (r)
"""
