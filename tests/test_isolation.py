"""The library holds without the corpus subpackage."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_subpackage():
    for f in (ROOT / "tidewatch").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            if isinstance(node, ast.ImportFrom | ast.Import):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names + [a.name for a in node.names]), f
