"""Searches in cells give the rows of the full scan."""

import random

import pytest

from arandu.operators.vector_cells import APART, VectorCells
from arandu.operators.vectors import cosine_top


def unit(v):
    n = sum(x * x for x in v) ** 0.5
    return [round(x / n, 6) for x in v]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    data = [(i, unit([x + rng.gauss(0, 0.15) for x in rng.choice(centres)]), "a") for i in range(900)]
    data += [(900, None, "b"), (901, [], "b"), (902, [0.0] * 12, "b"), (903, [1.0] * 12, "b"), (904, [1.0, None] + [0.0] * 10, "b"), (905, [0.5] * 4, "b"), (906, data[3][1], "b"), (907, data[3][1], "b")]
    return spark.createDataFrame(data, "id long, vector array<double>, x string").repartition(4)


def test_cells_equal_the_scan_and_read_few(spark, rows, tmp_path):
    cells = VectorCells(spark, str(tmp_path)).build(rows, cells=30)
    assert cells.rows().count() == rows.count() and cells.rows().where(f"cell = {APART}").count() == 6
    rng, few = random.Random(10), []
    asked = [rows.where("id = 3").first()["vector"], unit([rng.gauss(0, 1) for _ in range(12)]), [0.0] * 12, [2.0] + [0.0] * 11, [1.0] * 5]
    for q in asked:
        for k in (1, 10):
            got = [(r["id"], r["score"]) for r in cells.search(q, k, "id").collect()]
            assert got == [(r["id"], r["score"]) for r in cosine_top(rows, q, k, "vector", "id").collect()]
        few.append(cells.scored(q, 10).count())
    assert few[0] < 450, "a query in a cell reads few of the others"
    plan = cells.scored(asked[0], 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_cells_of_few_and_no_rows(spark, rows, tmp_path):
    one = VectorCells(spark, str(tmp_path / "one")).build(rows.where("id = 5"))
    assert [r["id"] for r in one.search(rows.where("id = 3").first()["vector"], 5, "id").collect()] == [5]
    bad = VectorCells(spark, str(tmp_path / "bad")).build(rows.where("x = 'b' and id < 906"))
    assert bad.search([1.0] * 12, 9, "id").count() == 6
