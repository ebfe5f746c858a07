"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import datetime

import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, duck_views

QUERIES = E.queries()
SQL = E.oracle_sql()


def _norm(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        vals = []
        for v in row:
            if isinstance(v, float) and v != v:
                vals.append("NaN")
            elif v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
                vals.append("NULL")
            elif isinstance(v, (pd.Timestamp, datetime.date)):
                vals.append(pd.Timestamp(v).isoformat())
            else:
                vals.append(repr(v.item() if hasattr(v, "item") else v))
        out.append("|".join(vals))
    return sorted(out)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["c_mktsegment", "avg_o_totalprice", "row_count"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    duck_views(duck, SF_SMALL)
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    exp = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert _norm(got) == _norm(exp)
