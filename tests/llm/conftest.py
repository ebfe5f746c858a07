from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, size long, kept boolean, doc string, row long, "
          "hash long, score double, u double, src string")


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    rnd = random.Random(3)
    words = ["the", "and", "thing", "river", "stone", "der", "und", "stein", "fluss", "haus", "nicht", "ist"]
    text = lambda n, lo=0, hi=12: " ".join(rnd.choice(words[lo:hi]) for _ in range(n))
    base = text(120)
    extra = (7, True, "x", 1, 2, 0.5, 0.25, "s")
    rows = [
        (None, "no id here at all", "en", "a", *extra), (1, None, "en", "a", *extra), (2, "", None, None, *extra),
        (3, "   \n\t ", "en", "b", *extra), (4, base, "en", "a", *extra), (5, base, "en", "b", *extra),
        (5, base, "en", "b", *extra), (6, base + " tail", "en", "a", *extra), (7, text(30, 0, 5), "en", None, *extra),
        (8, text(30, 5, 12), "de", "c", *extra), (9, text(40000), "en", "a", *extra), (10, "x" * 200000, None, "b", *extra),
        (11, "one two three", "en", "a", *extra), (12, "ONE two THREE", "en", "a", *extra),
        (13, "漢字 😀 İstanbul ẞ \x00 <|endoftext|>", "xx", "é", *extra), (14, "12345 67890 !!!", "en", "a", *([None] * 8)),
        (-3, "negative id " * 30, "en", "a", *extra), (15, "﻿ \x85 odd\x1cspace", "en", "", *extra),
    ]
    return rows + [(100 + i, text(5 + i, (i % 2) * 5, 5 + (i % 2) * 7), "de" if i % 2 else "en", "abc"[i % 3], *extra)
                   for i in range(60)]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Small tables: few shuffle partitions keep the many small jobs short."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [r[1] for r in odd_rows()]
