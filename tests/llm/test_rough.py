import pytest

from tests.rough import rough
from tidemark.llm import plans

TABLES = ("documents", "mix_target")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    return rough(spark, data, tmp_path_factory.mktemp("rough"), TABLES)


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    return rough(spark, data, tmp_path_factory.mktemp("empty"), TABLES, ("documents",))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_nulls_repeats_and_extra_columns(spark, data, folder, name):
    df = plans.QUERIES[name](spark, folder)
    assert df.columns == plans.QUERIES[name](spark, data).columns
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_no_rows(spark, empty, name):
    assert plans.QUERIES[name](spark, empty).count() == (5 if name == "p7_shares" else 0)
