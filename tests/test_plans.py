"""Physical plans: pruning, pushdown and no products of two tables."""

import re

import pytest

from conftest import SF
from gridloom.plans import registry

registry.load_all()


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_only_needed_columns_are_read(spark):
    text = plan_of(registry.QUERIES["annual_mean_from_daily"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_quantity", "l_shipdate", "l_suppkey"]


def test_filters_reach_the_scan(spark):
    text = plan_of(registry.QUERIES["click_heatmap"](spark, SF))
    assert "EqualTo(event_type,click)" in text


def test_annual_reducers_shuffle_once_per_level(spark):
    text = plan_of(registry.QUERIES["max_cdd_per_year"](spark, SF))
    # Adapter aggregation plus one exchange on (cell, year) for both windows and both groupings.
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) <= 3


# Joins without an equi key are allowed only against a one-row or literal side.
@pytest.mark.parametrize("name", ["region_mean", "nearest_place", "regrid_bilinear", "polygon_to_cells", "autocomplete", "resolve_name",
                                  "rank_of_point", "typed_entry_points", "mask_dilate", "point_series", "city_rankings_mean"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan_of(registry.QUERIES[name](spark, SF))
