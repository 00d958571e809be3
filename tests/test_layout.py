"""The layout that the tests and the optional subpackage rely on."""

import re
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_base_names_of_tests_differ():
    names = Counter(p.name for p in (ROOT / "tests").rglob("test_*.py"))
    assert not [n for n, k in names.items() if k > 1]


def test_nothing_else_in_the_library_imports_the_text_preparation():
    others = [p for p in (ROOT / "moderata").rglob("*.py") if "llm" not in p.parts]
    assert len(others) > 10 and not [p for p in others if re.search(r"(from|import)\s+moderata\.llm", p.read_text())]
