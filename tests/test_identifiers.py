"""Categories of identifiers in columns: the cheap tests before a pattern let every match through."""

import pytest
from pyspark.sql import functions as F

from assay.operators import identifiers

SHORTEST = ["Mr. Ab", "1 Ab St", "2024-01-31", "234-567-8901", "Fax:234-567-8901", "a@b.cc", "123-45-6789", "MRN12345", "Member IDABC123", "1234567812345678", "License NoAB123",
            "VINABCDEFGH123456789", "00:11:22:33:44:55", "http://x", "1.2.3.4", None, "data:image/a;base64,", "01234567-89ab-cdef-0123-456789abcdef"]


@pytest.mark.parametrize("around", ["{}", "- {} -", "xyz {}"])
def test_the_shortest_match_of_every_category_is_found(spark, around):
    texts = [around.format(v) for v in SHORTEST if v]
    df = spark.createDataFrame([(v,) for v in [*texts, None, "", "no"]], "t string")
    hits = {r.identifier: (r.hits, r.filled) for r in identifiers.identifier_flags(df, "x").collect()}
    for name, r in identifiers.RULES.items():
        want = df.where(F.col("t").rlike(r.value)).count() if r.value else 0
        assert hits[name] == (want, len(texts) + 2) and (want > 0) == (r.value is not None)


def test_digits_are_looked_up_once_a_column(spark):
    df = spark.createDataFrame([("a", "b")], "t string, u string")
    plan = identifiers.identifier_flags(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", [0-9])") == 2
