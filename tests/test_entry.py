"""The driver's contract, with and without the training-data subpackage."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = os.environ | {"PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout
    return [line.split() for line in out.strip().split("\n")]


def test_imports_without_the_subpackage(tmp_path):
    for part in ("__spark_entry__.py", "pixelweave"):
        source = ROOT / part
        files = [source] if source.is_file() else [p for p in source.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
        for p in files:
            target = tmp_path / p.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(p.read_bytes())
    queries, sql = names(tmp_path)
    assert "segment_pipeline" in queries and set(queries) == set(sql)


def test_oracles_belong_to_queries():
    queries, sql = names(ROOT)
    assert set(sql) <= set(queries)


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["image_id", "g", "label", "red", "green", "blue"] and found.count() == 1000
