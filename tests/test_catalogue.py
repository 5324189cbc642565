import pytest
from oracle import compare

from foliospark.plans import catalogue, documents, structure  # noqa: F401  (these add their queries to the catalogue)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    rows = compare(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name], SF)
    assert rows or name == "feature_coverage"
