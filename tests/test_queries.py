"""Every query with SQL agrees with it; every other one runs."""

from pathlib import Path

import pytest

from feedlens.plans import library

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19].replace("T", " ").removesuffix(" 00:00:00")
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_agrees_with_sql(spark, oracle, name):
    got = library.QUERIES[name](spark, str(DATA))
    want = oracle.execute(library.SQL[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in want.description].index(n) for n in columns]
    assert plain(got.select(*columns).collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_runs(spark, name):
    library.QUERIES[name](spark, str(DATA)).collect()


def test_entry_imports_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "feedlens", tmp_path / "feedlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
