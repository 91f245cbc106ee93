"""Registered queries vs their DuckDB oracle on the smallest tables."""
import math

import pytest

from ledgerlens.plans.registry import load_all

REG = load_all()
NAMES = ["r_high_value", "r_spending_spike", "r_late_night", "rule_engine_fixture", "summary_statistics",
         "spending_trends", "score_transactions", "episodes", "p_flag_table", "cf_warnings", "standardize",
         "txt_parse_layout", "map_training_format", "txt_parse_context", "st_rapid", "structuring",
         "portfolio_summary", "cf_metrics"]


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    q = REG[name]
    df = q.build(spark, "/root/testdata/sf0.001")
    cols = df.columns
    a = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == sorted(cols)
    idx = [dcols.index(c) for c in sorted(cols)]
    b = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert a == b
