"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from spanlab import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def rows(frame, columns):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_trained_scores_draws_from_all_citations(spark, monkeypatch):
    """Every citation is a target, and the result equals a count and mean by hand over the scored tokens."""
    from spanlab.operators import scoring
    from spanlab.plans import train

    seen, scored = [], []
    whole, transform = train.train, scoring.MLScorer.transform
    monkeypatch.setattr(train, "train", lambda base, targets, n, **k: seen.append((targets.count(), n)) or whole(base, targets, n, **k))
    monkeypatch.setattr(scoring.MLScorer, "transform", lambda self, rows: scored.append(transform(self, rows)) or scored[-1])
    got = {r.label: r for r in catalog.trained_scores(spark, str(DATA), n=60, held=20).collect()}
    assert seen == [(catalog.citations(spark, str(DATA)).count(), 60)] and seen[0][0] > 200
    assert all(0 <= r.mean_pos_prob <= 1 for r in got.values()) and got[1].mean_pos_prob + got[2].mean_pos_prob > 2 * got[0].mean_pos_prob
    rows = scored[0].select("label", "p_b", "p_i").collect()
    for label, r in got.items():
        p = [x.p_b + x.p_i for x in rows if x.label == label]
        assert len(p) == r.n and math.isclose(sum(p) / len(p), r.mean_pos_prob, rel_tol=1e-9)
