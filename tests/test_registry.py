import os
from collections import Counter

import duckdb
import pytest

from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def shown(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(int(v.timestamp() * 1e6)) if hasattr(v, "timestamp") else str(v)


from quillgraph.plans import registry  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    if name in ("latest_status",):
        cols_no_time = [c for c in cols if c != "updated_at"]
        got = Counter(tuple(shown(r[c]) for c in cols_no_time) for r in df.collect())
        assert got == Counter(tuple(v for c, v in zip(cols, k) if c != "updated_at") for k in want.elements())
    else:
        assert Counter(tuple(shown(r[c]) for c in cols) for r in df.select(*cols).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["links_capped", "chunk_text", "louvain", "graph_json", "yake", "html_to_text"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
