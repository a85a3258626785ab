"""The entry module, also where the corpus operators have been taken away."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDDEN = """
import importlib.abc, sys

class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r} or any(name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
known, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(known) and "view_by_role_family" in known
print(sum(k.startswith("op") and k[2].isdigit() for k in known), "pipeline" in known)
"""


def counts_without(*hidden: str) -> str:
    code = HIDDEN.format(hidden=hidden)
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def test_entry_lives_without_the_corpus_operators():
    assert counts_without("quern.llm", "corpus_pipeline") == "0 False"
    assert counts_without("quern.llm") == "0 False"


def test_entry_takes_what_is_there():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
