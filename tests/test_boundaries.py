"""What may import what, and that nothing reaches the network."""

from __future__ import annotations

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
NETWORK = {"socket", "requests", "urllib.request", "http.client", "ftplib", "smtplib", "asyncio"}


def imports(path: Path) -> set[str]:
    found = set()
    for node in ast.walk(ast.parse(path.read_text("utf-8"))):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found |= {node.module} | {f"{node.module}.{a.name}" for a in node.names}
    return found


def test_only_the_entry_point_knows_the_training_data_operators():
    for path in (ROOT / "sitelens").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(x.startswith("sitelens.llm") for x in imports(path)), path


def test_functions_do_not_know_operators():
    for path in (ROOT / "sitelens/functions").glob("*.py"):
        assert not any(x.startswith(("sitelens.operators", "sitelens.sinks", "sitelens.plans", "sitelens.streaming")) for x in imports(path)), path


def test_no_network():
    for path in [*(ROOT / "sitelens").rglob("*.py"), *ROOT.glob("*.py")]:
        assert not imports(path) & NETWORK, path
