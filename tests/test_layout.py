"""The training-data operators can be taken away: nothing else in the library refers to them."""

import ast
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent / "veilspark"


def test_nothing_imports_the_training_data_operators():
    for path in TOP.rglob("*.py"):
        if path.is_relative_to(TOP / "llm"):
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
