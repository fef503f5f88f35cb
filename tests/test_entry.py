"""The entry works without the text part, and without the libraries that only it needs."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "a4_cohort_retention" in names and not any(n.startswith("op") for n in names), names
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("missing", ["mercato.llm", "corpus_pipeline", "tiktoken", "public_tokenizers"])
def test_store_queries_are_there_without(missing):
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", SCRIPT.format(missing=missing)], capture_output=True, text=True, cwd=HERE)
    assert done.returncode == 0, done.stderr
