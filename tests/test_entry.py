import os
import pathlib

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent
SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 80 and all(map(callable, names.values()))


def test_the_core_does_not_import_the_training_package():
    for path in (ROOT / "kvasir").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "kvasir.llm" not in path.read_text(), path


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables here")
def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]
    got = entry.entry(spark)
    assert got.count() > 0
    assert all(r.score > 0 and 1 <= r["rank"] <= 10 for r in got.collect())
