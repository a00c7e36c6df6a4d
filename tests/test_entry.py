"""The engine alone: the entry points work without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def listed(folder):
    out = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1]), out[2] == "True"


def test_entry_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (copy / "loomgraph/llm/__pycache__").mkdir(exist_ok=True)
    for path in (copy / "loomgraph/llm").glob("*.py"):
        path.unlink()  # the empty folder may stay behind
    left = listed(copy)
    shutil.rmtree(copy / "loomgraph/llm")
    assert listed(copy) == left
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(copy) == left and left[0] > 150 and not left[2]


def test_entry_works_where_a_library_of_the_operators_is_missing(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in ("xxhash", "zstandard", "tokenizers", "public_tokenizers"):
        (copy / f"{name}.py").write_text("raise ImportError('not installed')")
    some = listed(copy)
    assert some[0] > 150 and not some[2]
