import duckdb
import pytest
from llm_cases import ODD, clashing, docs
from pyspark.sql import functions as F

from galleyworks.llm import mixing
from galleyworks.llm.oracles import OP6


def test_mixing(spark):
    df = clashing(docs(spark, [*ODD[1:4], (5, "a b c d " * 40, None), *[(10 + i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(200)]]), "of", "of_", "whole", "threshold", "copy", "target")
    rows = mixing.mix(df).collect()
    assert len(rows) == 204 and all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1e-9 or target == 0
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.mix(df.filter("false")).isEmpty() and mixing.mixed(df.filter("false")).isEmpty()


@pytest.mark.parametrize("kind", ["hot", "many", "equal"])
def test_against_sql(spark, kind):
    """A source with a third of all rows; a source for every document; sources of one size and ties of all kinds."""
    source = {"hot": lambda i: "s0" if i % 3 == 0 else f"s{i % 17}", "many": lambda i: f"é{i}", "equal": lambda i: None if i % 4 == 0 else f"s{i % 4}"}[kind]
    rows = [(i, "w " * (i * i % 23 if kind != "equal" else 3), source(i)) for i in range(600)]
    documents = docs(spark, rows).toPandas()  # noqa: F841
    want = duckdb.sql(OP6).fetchall()
    got = [tuple(r) for r in mixing.mix(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
