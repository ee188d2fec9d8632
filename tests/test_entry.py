"""The entry works when what the model-corpus queries need isn't there."""

import subprocess
import sys

CODE = """
import sys
sys.modules["{name}"] = None  # as if it weren't installed
import __spark_entry__ as e
names = set(e.queries())
assert "weekly_share" in names and len(names) > 150, len(names)
assert not any(n.startswith("op2_") for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_a_package():
    for name in ("zstandard", "tidemark.llm"):
        done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
        assert done.returncode == 0, done.stderr[-500:]
        assert "without all queries" in done.stderr
