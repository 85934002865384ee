import pytest
from pyspark.sql import functions as F

from telar.llm.mixing import Mixture, demands


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, peso_objetivo double, max_repeticiones int")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(4000)] + [(5000 + i, "b", 5 + i % 11) for i in range(600)] + [(9000 + i, "c", 20) for i in range(30)]
    rows += [(9900, None, 50), (9901, "z", 50), (9902, "a", 0), (9903, "a", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("posicion", F.lit("otra")).repartition(5)


def test_demands_with_and_without_a_total():
    want = {"a": (1.0, 1), "b": (1.0, 2), "none": (2.0, 1)}
    total, shares = demands(want, {"a": 100, "b": 20}, None)
    assert total == 80 and {s.source: s.demand for s in shares} == {"a": 40, "b": 40, "none": 0}
    total, shares = demands(want, {"a": 100, "b": 20}, 120)
    assert {s.source: s.demand for s in shares} == {"a": 80, "b": 40, "none": 0}
    assert {s.source: s.demand for s in demands(want, {"a": 100, "b": 20}, 1000)[1]} == {"a": 100, "b": 40, "none": 0}


def test_shares_are_held_within_half_a_text(spark, texts):
    m = Mixture(texts, targets(spark, [("a", 5.0, 1), ("b", 3.0, 3), ("c", 2.0, 4), ("absent", 4.0, 2), (None, 1.0, 1), ("b", 3.0, 3)]))
    chosen = m.chosen()
    rows = chosen.collect()
    for s in m.shares:
        own = [r for r in rows if r.source == s.source]
        assert abs(sum(r.n_tokens for r in own) - s.demand) <= max([r.n_tokens for r in own], default=0) / 2 + 1e-6
        assert len({(r.doc_id, r.repeticion) for r in own}) == len(own) and all(1 <= r.repeticion <= s.repeats for r in own)
    assert {r.source for r in rows} == {"a", "b", "c"} and [r.posicion for r in rows] == sorted(r.posicion for r in rows)
    assert all(0 <= r.posicion <= 1 for r in rows)
    reached = {r.source: r for r in m.reached(chosen).collect()}
    assert reached["absent"].tokens == 0 and abs(reached["c"].cuota_alcanzada - 0.2) < 0.01 and reached["c"].repeticiones == 4


def test_epochs_are_taken_one_after_the_other(spark, texts):
    m = Mixture(texts, targets(spark, [("b", 1.0, 3)]), total=2.5 * sum(5 + i % 11 for i in range(600)))
    counts = {r["count"] for r in m.chosen().groupBy("doc_id").count().collect()}
    assert counts == {2, 3}


def test_positions_follow_the_integrated_schedule(spark, texts):
    """Tokens up to a time equal the integral of the weight, by brute force over small steps."""
    knots = {"a": [(0.0, 4.0), (0.25, 0.0), (0.5, 0.0), (1.0, 2.0)], "b": [(0.0, 1.0), (1.0, 1.0)]}
    m = Mixture(texts, targets(spark, [("a", 1.0, 1), ("b", 1.0, 9)]), schedule=knots)
    rows = m.chosen().collect()

    def factor(ks, t):
        (t0, w0), (t1, w1) = next((a, b) for a, b in zip(ks, ks[1:]) if a[0] <= t <= b[0])
        return w0 + (w1 - w0) * (t - t0) / (t1 - t0)

    for s in m.shares:
        grid = [factor(knots[s.source], (i + 0.5) / 2000) for i in range(2000)]
        for stop in (200, 500, 800, 1300, 1999):
            want = s.demand * sum(grid[:stop]) / sum(grid)
            got = sum(r.n_tokens for r in rows if r.source == s.source and r.posicion <= stop / 2000)
            assert abs(got - want) <= 0.004 * s.demand + 20, (s.source, stop)


def test_default_ramp_keeps_each_moment_full(spark, texts):
    m = Mixture(texts, targets(spark, [("a", 5.0, 1), ("b", 3.0, 3), ("c", 2.0, 4)]))
    for end in (0, 1):
        assert abs(sum(s.demand * m.schedule[s.source][end][1] for s in m.shares) - m.total) < 1e-6 * m.total
    assert m.schedule["c"][1][1] > 1 > m.schedule["a"][1][1]


def test_empty_tables(spark, texts):
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    assert Mixture(none, targets(spark, [("a", 1.0, 1)])).chosen().count() == 0
    m = Mixture(texts, targets(spark, []))
    assert m.chosen().count() == 0 and m.reached(m.chosen()).count() == 0


def test_bad_schedules_are_refused(spark, texts):
    for knots in ([(0.0, 1.0)], [(0.0, -1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.1, 1.0), (1.0, 1.0)]):
        with pytest.raises(ValueError):
            Mixture(texts, targets(spark, [("a", 1.0, 1)]), schedule={"a": knots}).chosen()
