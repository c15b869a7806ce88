import os
import subprocess
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_subpackage(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries(); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_slices_agree_with_their_sql(spark):
    import duckdb

    from sievewright.plans import slices

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")

    def plain(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    for name, sql in slices.ORACLE.items():
        df = slices.QUERIES[name](spark, DATA)
        rel = c.execute(sql)
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns), name
        assert plain(df.select(*columns).collect()) == plain(rel.fetchall()), name


@pytest.mark.parametrize(("name", "wanted"), [("unique_decl", "left_semi"), ("passage_mentions", "Join"), ("conditional_limit", "Window")])
def test_plans_have_no_nested_loop_over_both_tables(spark, name, wanted):
    from sievewright.plans import slices

    plan = slices.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
