"""Concordance of orders against all pairs: sparse, late, repeated and null ids, ties, and more than one block."""

from __future__ import annotations

import random

import pytest

from hushgrid.operators import evaluate as EV


def plain(rows):
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(x, y) for x in rows for y in rows if x[0] is not None and y[0] is not None and x[0] < y[0]]
    alike = sum(None not in x + y and sign(x[1] - y[1]) == sign(x[2] - y[2]) for x, y in pairs)
    return len(pairs), round(alike / len(pairs), 6) if pairs else 0.0, True


R = random.Random(5)
CASES = {
    "from 1": [(k, R.randrange(40), R.randrange(40)) for k in range(1, 1025)],
    "four apart": [(4 * k, R.randrange(9000), R.randrange(50)) for k in range(600)],
    "late": [(100_000 + k, k, -k if k % 3 else k) for k in range(300)],
    "many": [(k, R.randrange(5), R.randrange(5)) for k in range(900)],
    "odd": [(None, 1, 2), *[(k % 40, R.choice([None, 1, 2, 7]), R.choice([None, 1, 3, 5])) for k in range(200)]],
    "one": [(1, 2, 3)],
    "none": [],
}


@pytest.mark.parametrize("per_block", [EV.CELLS, 60])
@pytest.mark.parametrize("name", CASES)
def test_concordance_over_all_pairs(spark, name, per_block):
    df = spark.createDataFrame(CASES[name], "id bigint, before bigint, after bigint")
    assert tuple(EV.order_concordance(df, per_block).first()) == plain(CASES[name])


def test_more_rows_than_5000(spark):
    got = EV.order_concordance(spark.range(6000).selectExpr("id * 3 AS id", "id AS before", "CASE WHEN id < 3000 THEN id ELSE -id END AS after"), 1000).first()
    assert got.pairs == 6000 * 5999 // 2 and got.fidelity == round(3000 * 2999 / 2 / got.pairs, 6) and got.exact
