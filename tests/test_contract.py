"""The driver contract: every registered query against its DuckDB oracle at sf0.001."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_mod
from clickweave.plans.oracle import ORACLE
from clickweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return "\x00"
    if isinstance(v, float):
        return repr(round(v, 9)) if not math.isnan(v) else "nan"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


_WITHOUT_LLM = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "clickweave.llm" or name.startswith("clickweave.llm."):
            raise ModuleNotFoundError(name, name="clickweave.llm")
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
from clickweave.plans.registry import QUERIES
assert set(e.queries()) == set(e.oracle_sql()) == set(QUERIES)
"""


def test_entry_without_the_training_data_operators():
    """They, and the pipeline that imports them, are left out where their folder is absent."""
    done = subprocess.run([sys.executable, "-c", _WITHOUT_LLM], cwd=Path(entry_mod.__file__).parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert want
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, got) == _rows(cols, want)


def test_checks_come_in_order(spark):
    def column(name, c):
        return [r[c] for r in QUERIES[name](spark, SF).collect()]

    for name, c in (("check_funnel_monthly", "event_month"), ("check_cohort", "cohort_week"), ("check_rfm_recency", "r_score"),
                    ("check_product_monthly", "event_month"), ("check_electronics_clean", "event_month")):
        got = column(name, c)
        assert got == sorted(got) and len(got) > 2, name
    for name, c in (("check_funnel_category", "category_cvr"), ("check_rfm_segments", "user_count")):
        got = column(name, c)
        assert got == sorted(got, reverse=True), name


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["row_type", "event_month", "category_top"]
