"""The library stands without its training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CHECK = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = entry.queries()
assert len(names) > 150 and "pipeline" not in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names), sorted(names)
assert set(entry.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert names["o04_distinct"](spark, "DATA").count() > 0
spark.stop()
"""


def test_without_the_subpackage(tmp_path, data):
    for name in ("textloom", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "textloom" / "llm", ignore_errors=True)  # it may be gone already
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", CHECK.replace("DATA", data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_nothing_else_imports_it():
    for f in [*ROOT.glob("*.py"), *(ROOT / "textloom").rglob("*.py")]:
        if f.parent.name != "llm" and f.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", f.read_text()), f
