import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from [node.module or "", *(f"{node.module}.{a.name}" for a in node.names)]


def test_nothing_in_the_library_needs_the_optional_subpackage():
    for path in (ROOT / "tidewright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(name.startswith("tidewright.llm") for name in imports(path)), path


def test_entry_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['tidewright.llm'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert q and set(e.oracle_sql()) <= set(q), set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_statement_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 120
