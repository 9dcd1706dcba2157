
import __spark_entry__ as E
from reasonloop.plans import catalog as C

SURVEY_IDS = (
    [f"S{i}" for i in range(1, 11)] + [f"P{i}" for i in range(1, 11)] + ["P6b"]
    + ["X1", "X2", "X2f", "X3", "X4", "X5"] + [f"N{i}" for i in range(1, 5)] + [f"M{i}" for i in range(1, 5)]
    + [f"R{i}" for i in range(1, 15)] + [f"A{i}" for i in range(1, 10)] + ["L1", "L2", "L3"]
    + ["T1", "T2", "T2b", "ST1"]
)


def test_every_operator_has_a_query_and_every_query_an_oracle():
    assert set(C.COVERAGE) == set(C.QUERIES) <= set(E.queries())
    assert set(C.COVERAGE) <= set(E.oracle_sql()) <= set(E.queries())
    covered = {i.strip() for v in C.COVERAGE.values() for i in v.split(",")}
    assert set(SURVEY_IDS) <= covered, sorted(set(SURVEY_IDS) - covered)
