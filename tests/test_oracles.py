"""Every query with an oracle gives the oracle's rows."""

import duckdb
import pytest
from conftest import same_rows

from tickplane.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_component_boxes_match_their_oracle_over_column_zero(spark, tmp_path):
    """A slope of 41 cells in a box of 640, whose fill is a tie in decimals only, and two cells that stand alone."""
    cells = [*((min(i, 15), i - 1) for i in range(40)), (0, 1), (20, -1), (21, 60)]
    rows = [(y, x * 100.0) for y, x in cells for _ in range(2)] + [(5, 7000.0), (9, None), (9, None)]
    spark.createDataFrame(rows, "c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    boxes = QUERIES["component_boxes"](spark, str(tmp_path))
    assert sorted((b["cells"], b["left"], b["fill"]) for b in boxes.collect()) == [(1, -1, 1.0), (1, 60, 1.0), (41, -1, 0.064062)]
    same_rows(boxes, con, ORACLES["component_boxes"])


@pytest.mark.parametrize("name", ["box_components", "component_boxes"])
def test_cells_far_apart_match_their_oracle(spark, tmp_path, name):
    """Columns 2^31 apart, where row-major codes of one row run into the next."""
    cells = [(0, 0), (0, 1 << 31), (1, 1), (4, -5), (4, (1 << 33) + 7), (5, (1 << 33) + 8), (9, 3), (8, (1 << 31) + 2)]
    rows = [(y, x * 100.0) for y, x in cells for _ in range(2)]
    spark.createDataFrame(rows, "c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
