"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') or n == 'pipeline' for n in q), len(q) > 100)"


def asked(folder):
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def copied(tmp_path, *without):
    left_out = shutil.ignore_patterns(".git", "__pycache__", *without)
    return shutil.copytree(HERE, tmp_path / "copy", ignore=left_out)


def test_without_the_subpackage_and_its_pipeline(tmp_path):
    assert asked(copied(tmp_path, "llm", "corpus_pipeline.py")) == ["0", "True"]


def test_with_the_pipeline_alone(tmp_path):
    assert asked(copied(tmp_path, "llm")) == ["0", "True"]


def test_with_an_empty_folder_left(tmp_path):
    folder = copied(tmp_path, "llm", "corpus_pipeline.py")
    (folder / "candlewick/llm/__pycache__").mkdir(parents=True)
    assert asked(folder) == ["0", "True"]
