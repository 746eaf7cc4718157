"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gsig.plans import registry

SF = os.environ.get("GSIG_TEST_SF", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    expected = sorted((tuple(map(plain, r)) for r in rel.select(quoted).fetchall()), key=repr)
    assert got == expected
    assert got


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_part(tmp_path, pipeline):
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "gsig", tmp_path / "gsig", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "gsig/llm/__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if (here / name).exists():
            shutil.copy(here / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]


@pytest.mark.parametrize("missing", ["public_tokenizers", "tokenizers", "zstandard", "gsig.llm.bpe"])
def test_entry_when_a_part_cannot_be_imported(missing):
    """The training-data part is left out if anything that it needs is missing; the rest is there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]
