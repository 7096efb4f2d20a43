"""The driver contract, with and without the optional subpackage."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def ask(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=300, check=False)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()[-3:]


def copy(tmp_path, *parts):
    for name in ("__spark_entry__.py", "verity", *parts):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)


def test_stands_without_the_subpackage(tmp_path):
    copy(tmp_path)
    n, ops, pipeline = ask(tmp_path)
    assert int(n) > 60 and ops == "0" and pipeline == "False"


def test_stands_without_the_subpackage_but_with_the_pipeline_file(tmp_path):
    copy(tmp_path, "corpus_pipeline.py")
    (tmp_path / "verity" / "llm").mkdir()
    n, ops, pipeline = ask(tmp_path)
    assert int(n) > 60 and ops == "0" and pipeline == "False"


def test_registers_what_is_there():
    n, ops, pipeline = ask(ROOT)
    there = (ROOT / "verity" / "llm" / "__init__.py").exists()
    assert int(n) > 60 and (int(ops) >= 10 if there else ops == "0") and pipeline == str(there and (ROOT / "corpus_pipeline.py").exists())
