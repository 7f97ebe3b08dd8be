"""The library stands without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_operators(tmp_path):
    for name in ("redoubt", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(s) <= set(q) and not any(n.startswith('op') for n in q); print('fine')"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert ran.stdout.strip() == "fine", ran.stderr


def test_the_suite_collects_without_the_operators(tmp_path):
    for name in ("redoubt", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    ran = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert ran.returncode == 0 and "test_engine.py" in ran.stdout, ran.stdout + ran.stderr
    ran = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests/test_checks.py", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert ran.returncode == 0, ran.stdout + ran.stderr


def test_nothing_else_imports_the_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "redoubt")):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert "redoubt.llm" not in (text := f.read()) and "..llm" not in text, name
