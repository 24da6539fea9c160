import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


def run(folder, code=COUNT):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True)


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    found = run(tmp_path / "r")
    assert re.match(r"\d+ True False", found.stdout), found.stderr
    (tmp_path / "r/recallgrid/llm/__pycache__").mkdir(parents=True)
    assert re.match(r"\d+ True False", run(tmp_path / "r").stdout)


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "recallgrid")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as file:
                        assert not re.search(r"^\s*(from|import)\b.*\bllm\b", file.read(), re.MULTILINE), name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
