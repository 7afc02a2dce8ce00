import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_without_the_subpackage(tmp_path):
    """The core imports and lists its queries where the optional subpackage is missing."""
    import shutil

    shutil.copytree(ROOT / "wordloom", tmp_path / "wordloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'p5_found' in e.queries(), any(q.startswith('p1_') for q in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["True", "False"], out.stderr


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["locale", "word", "value", "weight", "rank"] and df.count() > 0
