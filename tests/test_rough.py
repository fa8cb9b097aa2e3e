import pytest

from tests.rough import rough
from tidemark.plans import general

TABLES = ("v_site", "entity_node", "sample_text", "parser_config", "sample_line", "sample_reading", "trend_delivery")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    return rough(spark, data, tmp_path_factory.mktemp("rough"), TABLES)


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    return rough(spark, data, tmp_path_factory.mktemp("empty"), TABLES, TABLES)


@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_nulls_repeats_and_extra_columns(spark, data, folder, name):
    df = general.QUERIES[name](spark, folder)
    assert df.columns == general.QUERIES[name](spark, data).columns
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_no_rows(spark, empty, name):
    assert general.QUERIES[name](spark, empty).count() == 0
