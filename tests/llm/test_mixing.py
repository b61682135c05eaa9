import random

import pytest

from pluvia.llm import mixing


def totals(spark, rows, targets=mixing.TARGETS):
    post = spark.createDataFrame([(i, "s", n, p) for i, (n, p) in enumerate(rows)], "doc_id long, source string, tokens long, p array<double>")
    got = mixing.rated(post, *mixing.solve(post, targets)).collect()
    n = sum(r.tokens for r in got)
    assert all(r.rate >= 0 for r in got)
    return [sum(r.rate * r.tokens * r.p[k] for r in got) / n for k in range(len(targets))], got[0]


@pytest.mark.parametrize("shares", [(76, 13, 11), (97, 1, 2)])
def test_totals_meet_targets(spark, shares):
    rows = [(n, [float(k == j) for j in range(3)]) for k, n in enumerate(shares)]
    m, r = totals(spark, rows)
    assert m == pytest.approx(mixing.TARGETS, abs=2e-6) and r.residual <= mixing.TOL and not r.infeasible


def test_soft_totals_and_infeasible(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        p = [r.random() ** 6 + 1e-4 for _ in range(3)]
        rows.append((r.randrange(1, 500), [v / sum(p) for v in p]))
    m, row = totals(spark, rows + [(0, [1.0, 0.0, 0.0])])
    assert m == pytest.approx(mixing.TARGETS, abs=2e-6) and not row.infeasible
    m, row = totals(spark, [(5, [1.0, 0.0, 0.0]), (5, [0.5, 0.0, 0.5])])   # no text of the second domain
    assert row.infeasible and row.residual >= 0.05 - 1e-6
