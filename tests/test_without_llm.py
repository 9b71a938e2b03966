"""The engine stands without the subpackage of training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_llm():
    code = "import sys; sys.modules['answerloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) >= 50 and not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_llm():
    found = subprocess.run(["grep", "-rln", "answerloom.llm", "--include=*.py", "answerloom", "bench.py"], cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert all(f.startswith("answerloom/llm/") for f in found), found


def test_other_faults_are_not_hidden():
    """A library that the operators need and that isn't there must not make their queries vanish in silence."""
    code = "import sys; sys.modules['zstandard'] = None\ntry:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    assert e.name == 'zstandard', e.name\nelse:\n    import os; assert not os.path.exists('answerloom/llm')"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
