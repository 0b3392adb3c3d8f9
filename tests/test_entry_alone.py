"""The driver's entry without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "mailscreen"), copy / "mailscreen", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 80 and set(e.oracle_sql()) <= set(n) and not any(k.startswith('op') for k in n)"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=environment, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
