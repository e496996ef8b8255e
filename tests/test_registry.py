import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_training_subpackage():
    code = """
    import sys
    sys.modules["strandline.llm"] = None
    sys.modules["corpus_pipeline"] = None
    import __spark_entry__ as e
    names = set(e.queries())
    assert "label_top2_posterior" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert set(e.oracle_sql()) <= names
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=ROOT)


def test_nothing_else_imports_the_training_subpackage():
    for path in (ROOT / "strandline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text()
