"""Every registered query against its SQL statement on another engine."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import CHECK, SMALL, TABLES

import __spark_entry__ as entry_points
import oracles
from lintlake import rules as R
from lintlake.plans.catalogue import QUERIES

ORACLES = oracles.build()
# Small tables hold too few files for language-bound rules; these run on the larger set.
AT_CHECK_SCALE = {"injection_findings", "rule_hit_counts", "python_syntax_findings", "request_replay"}


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return None
        v = v.item() if isinstance(v, np.generic) else v
        if isinstance(v, bool):
            return v
        return round(float(v), 9) if isinstance(v, (int, float)) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, row)) for row in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def duck():
    def connect(folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return {SMALL: connect(SMALL), CHECK: connect(CHECK)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    folder = CHECK if name in AT_CHECK_SCALE else SMALL
    ours = QUERIES[name](spark, folder).toPandas()
    theirs = duck[folder].execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert plain(ours) == plain(theirs)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_every_rule_fires(spark):
    fired = {r["rule_id"] for r in QUERIES["rule_hit_counts"](spark, CHECK).select("rule_id").distinct().collect()}
    assert fired == {r.rule_id for r in R.ALL_RULES}


def test_entry(spark):
    assert entry_points.entry(spark).count() == 20


def test_look_ahead_free_pattern_is_the_same():
    """The SQL form of the one rule with a look-ahead, against the original, on random calls."""
    import random
    import re

    from oracles import ssrf_pattern

    # RE2's class names, in Python's spelling.
    ours = re.compile(ssrf_pattern().replace(r"\p{Z}", "\xa0\u2028"), re.S)
    original = re.compile(R.by_id("SSRF_REQUESTS")[0].pattern, re.M | re.S)
    rnd, n = random.Random(3), 0
    pieces = ["requests.get(", "requests.post (", " ", "  ", "\n", '"', "'", "h", "t", "p", "htt", "http", "https://", "url", "params", "query",
              "req.", "request.", "endpoint", ",", ")", "x", "y" * 79, "z" * 70]
    for _ in range(30000):
        text = "requests.get(" + "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9)))
        spans = [m.span() for m in original.finditer(text)]
        assert [m.span() for m in ours.finditer(text)] == spans, text
        n += bool(spans)
    assert n > 5000
