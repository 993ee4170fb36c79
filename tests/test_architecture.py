import re
from pathlib import Path

PACKAGE = Path(__file__).resolve().parents[1] / "ledgermark"


def test_one_gateway_to_facts_and_prices():
    readers = [p.name for p in (PACKAGE / "plans").glob("*.py") if re.search(r"store\.(fact|price)\b(?!\.spark)", p.read_text()) and p.name not in ("asof.py", "registry.py", "oracle.py")]
    assert readers == []


def test_nothing_imports_the_corpus_operators():
    for p in PACKAGE.rglob("*.py"):
        if "llm" not in p.parts:
            assert "ledgermark.llm" not in p.read_text(), p


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
