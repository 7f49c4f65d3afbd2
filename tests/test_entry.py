from tests.conftest import DATA

import __spark_entry__
from slidegrid.plans import ORACLE_SQL, QUERIES


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 130
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_some_queries_match_their_oracle(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("supplier", "lineitem", "embeddings", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    for name in ("patch_metrics", "split_grouped", "kappa_quadratic", "components", "froc_curve", "pool2d", "annot_paint", "px_otsu"):
        got = QUERIES[name](spark, f"{DATA}/sf0.001")
        columns = sorted(got.columns)
        clean = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
        want = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert clean([r[names.index(c)] for c in columns] for r in want.fetchall()) == clean([r[c] for c in columns] for r in got.collect()), name
