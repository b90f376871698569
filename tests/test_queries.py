"""Every registered query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from cairn.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DIR):
        pytest.skip(f"{DIR} is not there")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    fix = lambda v: round(float(v), 9) if isinstance(v, (float, Decimal)) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(map(tuple, df.select(columns).collect())) == plain([r[i] for i in at] for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry_is_importable_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_entry_works_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "cairn"):
        (shutil.copytree if name == "cairn" else shutil.copy)(f"{root}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(f"{tmp_path}/cairn/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op1_') or q == 'pipeline' for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
