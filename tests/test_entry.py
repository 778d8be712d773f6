import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["entity_id", "head_seq", "balance", "purchases"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


from tidelog.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    got = QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(norm, r)) for r in got.select(*columns).collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def _entry_in(folder, pipeline: str | None) -> tuple[int, str]:
    """Exit code and output of importing the entry beside the library without its text operators."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "tidelog", folder / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", folder)
    if pipeline is not None:
        (folder / "corpus_pipeline.py").write_text(pipeline)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=folder, capture_output=True, text=True, timeout=100)
    return done.returncode, done.stdout + done.stderr


def test_entry_without_the_text_operators(tmp_path):
    code, said = _entry_in(tmp_path, None)
    assert code == 0 and said.split()[:2] == [str(len(QUERIES)), "True"]


def test_a_broken_dependency_is_no_missing_folder(tmp_path):
    code, said = _entry_in(tmp_path, "import no_such_package_at_all\n")
    assert code != 0 and "no_such_package_at_all" in said
