"""Source-level guards for the design rules of the library code."""

import pathlib
import re

import pytest

LIB = pathlib.Path(__file__).resolve().parent.parent / "dbpulse"

FORBIDDEN = {
    "localCheckpoint": r"localCheckpoint",                 # lineage must be cut reliably
    "row-at-a-time UDF": r"F\.udf\(|@udf\b|functions\.udf\(",
    "RDD API": r"\.rdd\b|mapPartitions\(",
    "unchecked broadcast hint": r"\bbroadcast\(",          # AQE decides from measured sizes
    "cross join": r"crossJoin\(|how=\"cross\"",
    "driver-side collect": r"\.collect\(\)|toPandas\(|toLocalIterator\(",
}


@pytest.mark.parametrize("rule", sorted(FORBIDDEN))
def test_library_source_rules(rule):
    rx = re.compile(FORBIDDEN[rule])
    hits = [f"{p.relative_to(LIB)}:{i}" for p in LIB.rglob("*.py") if p.relative_to(LIB).parts[0] != "llm"
            for i, line in enumerate(p.read_text().splitlines(), 1)
            if rx.search(line) and not line.lstrip().startswith("#")]
    assert not hits, hits


def test_nothing_else_imports_the_llm_subpackage():
    hits = [str(p) for p in LIB.rglob("*.py") if p.relative_to(LIB).parts[0] != "llm"
            and re.search(r"dbpulse\.llm|corpus_pipeline", p.read_text())]
    assert not hits


def test_no_local_checkpoint_anywhere():
    assert not [str(p) for p in LIB.rglob("*.py") if "localCheckpoint" in p.read_text()]
