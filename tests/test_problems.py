"""The general problem operators against brute force, with small partitions so that groups cross them."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telar.operators.asof import known_at_event
from telar.operators.copies import diff_copies, symmetric_difference
from telar.operators.coverage import covering
from telar.operators.orphans import orphan_references
from telar.operators.periods import periods_and_gaps
from telar.operators.ranking import numbered
from telar.operators.skew import skew_safe_join
from telar.operators.spikes import Field, Limits, flag_measurements

D0 = dt.date(2024, 1, 1)
day = lambda n: None if n is None else D0 + dt.timedelta(days=n)


@pytest.fixture(params=[None, 3])
def batch(spark, request):
    """Rows of a batch: the default, and so few that groups end and go on within a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if request.param:
        spark.conf.set(name, request.param)
    yield request.param
    spark.conf.unset(name)


def brute_periods(rows):
    out = set()
    groups = {}
    for m, c, a, b in rows:
        if a is not None and (b is None or b >= a):
            groups.setdefault((m, c), set()).add((a, 10**6 if b is None else b))
    for k, intervals in groups.items():
        islands = []
        for a, b in sorted(intervals):
            if islands and a <= islands[-1][1] + 1:
                islands[-1][1] = max(islands[-1][1], b)
                islands[-1][2] += 1
            else:
                islands.append([a, b, 1])
        for a, b, n in islands:
            out.add((*k, "continuo", a, b, n))
        out |= {(*k, "hueco", x[1] + 1, y[0] - 1, 2) for x, y in zip(islands, islands[1:])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_periods_and_gaps(spark, seed, batch):
    r = random.Random(seed)
    rows = []
    for _ in range(600):  # entity (1, 1) holds more than a third of all rows
        m, c = (1, 1) if r.random() < 0.5 else (r.choice([None, 2, 3, 4]), r.choice([1, 2, None]))
        a = r.choice([None, *range(0, 4000)]) if r.random() < 0.9 else 5
        b = None if r.random() < 0.002 else (a or 0) + r.randint(-2, 12)
        rows.append((m, c, a, b))
    df = spark.createDataFrame([(m, c, day(a), day(b), "x", 1) for m, c, a, b in rows + rows[:50]], "id_medico int, id_clinica int, a date, b date, k1 string, s int").repartition(7)
    got = {(x.id_medico, x.id_clinica, x.clase, (x.desde - D0).days, 10**6 if x.hasta is None else (x.hasta - D0).days, x.intervalos) for x in periods_and_gaps(df, ("id_medico", "id_clinica"), "a", "b").collect()}
    assert got == brute_periods(rows)


def test_periods_of_an_empty_table(spark):
    assert periods_and_gaps(spark.createDataFrame([], "m int, c int, a date, b date"), ("m", "c"), "a", "b").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_known_at_event(spark, seed, batch):
    r = random.Random(seed)
    key = lambda: 1 if r.random() < 0.5 else r.choice([2, 3, None])
    changes = [(key(), r.randint(0, 60), r.randint(0, 60), r.randint(0, 5), i % 40, r.choice([None, 7, 8, 9])) for i in range(300)]
    events = [(i, key(), r.choice([None, *range(70)]), r.choice([None, 7, 8])) for i in range(300)]
    want = {}
    for i, k, t, own in events:
        ok = [(a, b, c, v) for k2, t2, a, b, c, v in changes if k is not None and k == k2 and t is not None and t2 <= t]
        if ok:
            top = max(x[:3] for x in ok)
            want[i] = ({x[3] for x in ok if x[:3] == top}, own)
    ev = spark.createDataFrame(events + events[:20], "id long, k long, t int, propio long").withColumn("v", F.lit("x"))
    ch = spark.createDataFrame(changes, "k long, t int, a long, b long, c long, v long")
    got = {x.id: (x.vigente, x.propio) for x in known_at_event(ev.repartition(5), ch).collect()}
    assert set(got) == set(want) and all(got[i][0] in want[i][0] and got[i][1] == want[i][1] for i in got)
    assert known_at_event(ev.limit(0), ch).count() == 0 and known_at_event(ev, ch.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_orphans(spark, seed, batch):
    r = random.Random(seed)
    key = lambda: 1 if r.random() < 0.4 else r.choice([2, 3, 4, 5, 6, None])
    parents = [(r.choice([0, 1]), k, r.choice([None, r.randint(0, 90)]), r.choice([None, r.randint(0, 99)])) for k in [key() for _ in range(40)] if k != 6]
    refs = [(r.choice([0, 1]), i, r.choice([0, 1]), key(), r.choice([None, *range(100)])) for i in range(500)]
    want = {}
    for tab, i, dest, k, t in refs:
        own = [(a, b) for d2, k2, a, b in parents if d2 == dest and k is not None and k2 == k]
        if k is None or t is None or any(a is not None and a <= t and (b is None or t < b) for a, b in own):
            continue
        want[tab, i] = "ausente" if not own else "eliminada" if any(a is not None and a <= t for a, _ in own) else "tardia"
    rdf = spark.createDataFrame(refs + refs[:30], "tabla int, id long, destino int, k long, t long").withColumn("vivas", F.lit("x"))
    pdf = spark.createDataFrame(parents + parents[:5], "destino int, k long, desde long, hasta long")
    got = {(x.tabla, x.id): x.clase for x in orphan_references(rdf.repartition(6), pdf).collect()}
    assert got == want
    assert orphan_references(rdf.limit(0), pdf).count() == 0
    assert {x.clase for x in orphan_references(rdf, pdf.limit(0)).collect()} == {"ausente"}


@pytest.mark.parametrize("seed", range(3))
def test_covering(spark, seed, batch):
    r = random.Random(seed)
    key = lambda: 1 if r.random() < 0.5 else r.choice([2, 3, None])
    periods = [(key(), r.choice([None, r.randint(0, 200)]), r.choice([None, r.randint(0, 230)]), r.choice([None, *range(1, 10)])) for _ in range(60)]
    events = [(i, key(), r.choice([None, *range(240)])) for i in range(400)]
    want = {}
    for i, k, t in events:
        v = [x for k2, a, b, x in periods if k is not None and k == k2 and t is not None and a is not None and a <= t and (b is None or t <= b) and (b is None or b >= a)]
        want[i] = (len(v), v[0] if len(v) == 1 else None)
    edf = spark.createDataFrame([(i, k, day(t)) for i, k, t in events], "id long, k long, dia date")
    pdf = spark.createDataFrame([(k, day(a), day(b), v) for k, a, b, v in periods], "k long, desde date, hasta date, valor long")
    assert {x.id: (x.cubren, x.valor) for x in covering(edf.repartition(5), pdf).collect()} == want


@pytest.mark.parametrize("every", [1, 4, 16])
def test_copies(spark, every, batch):
    r = random.Random(every)
    rows = [(i, f"n{i % 7}", r.choice([None, 1, 2])) for i in range(400)] + [(None, "nulo", 1)]
    copy = [x for x in rows if x[0] is None or x[0] % 41]
    copy = [(i, n if not i or i % 29 else "otro", v if not i or i % 31 else 3) for i, n, v in copy] + [(1000 + i, "z", None) for i in range(3)]
    a = spark.createDataFrame([(*x, 5) for x in rows] + [(7, "viejo", 9, 1), (7, "viejo", 9, None)] + [(*rows[3], 5)], "id int, n string, v int, ts int").withColumn("h1", F.lit("x"))
    b = spark.createDataFrame([(*x, 2) for x in copy], "id int, n string, v int, cargado int")
    old = dict((x[0], x) for x in copy)
    want = set()
    for i, n, v in rows:
        if i not in old:
            want.add((i, "fila_solo_en_origen"))
        else:
            want |= {(i, c) for c, x, y in (("n", n, old[i][1]), ("v", v, old[i][2])) if x != y}
    want |= {(1000 + i, "fila_solo_en_copia") for i in range(3)}
    got = [tuple(x) for x in diff_copies(a.repartition(5), b, "id", ["n", "v"], "ts", "cargado", every=every).collect()]
    assert set(got) == want and len(got) == len(want)
    assert diff_copies(a, b.limit(0), "id", ["n", "v"], "ts", "cargado").count() == 401
    assert diff_copies(a, a, "id", ["n", "v"], "ts", "ts").count() == 0


def test_equal_copies_compare_no_rows(spark):
    """One changed row leaves one chunk to compare."""
    from telar.operators import copies

    a = spark.range(3000).select("id", F.lit("x").alias("n"))
    b = a.withColumn("n", F.when(F.col("id") == 1500, "y").otherwise(F.col("n"))).filter("id <> 2500")
    rows = copies.chunked(a.withColumn("_lado", F.lit(0)).unionByName(b.withColumn("_lado", F.lit(1))), "id", ["n"], 16).collect()
    rows = spark.createDataFrame(rows)
    sides = [rows.filter(F.col("_lado") == i) for i in (0, 1)]
    prints = [x.groupBy("_trozo").agg(F.count("*").alias("n"), F.expr("bit_xor(_h1)").alias("x")) for x in sides]
    left = sides[0].join(prints[0].join(prints[1], ["_trozo", "n", "x"], "left_anti"), "_trozo", "left_semi").count()
    assert prints[0].count() > 100 and 0 < left < 300


@pytest.mark.parametrize("key", ["x", "a", "b", "n", "k"])
def test_copies_whatever_their_columns_are_called(spark, key):
    others = [c for c in ("a", "b", "x", "n", "x1") if c != key]
    left = spark.range(60).select(F.col("id").alias(key), *[(F.col("id") % 7).alias(c) for c in others])
    right = left.filter(F.col(key) != 9).withColumn(others[0], F.when(F.col(key) == 30, None).otherwise(F.col(others[0])))
    assert {tuple(r) for r in diff_copies(left, right, key, others).collect()} == {(9, "fila_solo_en_origen"), (30, others[0])}


def test_copies_of_other_types(spark):
    """97 equals 97.00 in a wider decimal, an integer equals a double, and a text equals only the same text."""
    a = spark.createDataFrame([(1, "97.00", 5, "7"), (2, "1.50", 6, "8"), (3, None, 7, None)], "id int, x string, y int, z string").withColumn("x", F.col("x").cast("decimal(5,2)"))
    b = spark.createDataFrame([(1, "97.0", 5.0, 7), (2, "1.6", 6.5, 9), (3, None, 7.0, None)], "id long, x string, y double, z int").withColumn("x", F.col("x").cast("decimal(6,1)"))
    assert {tuple(r) for r in diff_copies(a, b, "id", ["x", "y", "z"]).collect()} == {(2, "x"), (2, "y"), (2, "z")}


def test_symmetric_difference(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (3, "x")], "a int, b string")
    assert symmetric_difference(a, b).first().discrepancias == 2


FIELDS = [Field("hr", 20, 300, 0.35, 6.0), Field("mov", 0, 1000, 0.7, 4.0)]


def readings(seed=0, n=900):
    r = random.Random(seed)
    rows, cases = [], set()
    for d in (1, 2, None):
        level, i0 = 80.0, len(rows)
        for k in range(n if d == 1 else n // 4):
            i = len(rows)
            if k == n // 8:
                level += 25  # a lasting change
            level += 0.02  # and a drift
            rows.append([i, d, k * 40, round(level + r.gauss(0, 1.5), 2), r.choice([0, 9, 10, 11, 12, 10, 9])])
        own = [x[0] for x in rows[i0:]]
        for j in (20, 60, 61, 150):
            rows[own[j]][3] = round(rows[own[j]][3] + 40, 2)
            cases.add((own[j], "hr"))
        rows[own[90]][3], rows[own[91]][4] = -3.0, 5000
        cases |= {(own[90], "hr"), (own[91], "mov")}
        for j in range(170, 195):
            rows[own[j]][3] = 104.5
            cases.add((own[j], "hr"))
    return rows, cases


def test_flagged_measurements(spark):
    rows, cases = readings()
    twice = rows + rows[:200] + [[10**6, 1, None, None, None], [None, 1, 50, 90.0, None]]
    df = spark.createDataFrame([(i, d, None if t is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), h, m, "x", 3) for i, d, t, h, m in twice], "id int, disp int, en timestamp, hr double, mov int, d string, f int").repartition(9)
    found = flag_measurements(df, "id", "disp", "en", FIELDS)
    got = {(x.id, x.campo) for x in found.collect()}
    assert got == cases
    assert flag_measurements(df.limit(0), "id", "disp", "en", FIELDS).count() == 0


def _flagged(spark, rows, limits=Limits()):
    df = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), v, None) for i, t, v in rows], "id long, disp long, en timestamp, hr double, mov int")
    return {r.id for r in flag_measurements(df, "id", "disp", "en", FIELDS, limits).collect()}


def test_a_noisy_part_of_the_day_has_its_own_fences(spark):
    """The same departure is a case in quiet hours and none in noisy ones."""
    r = random.Random(1)
    noisy = lambda t: t // 21_600 % 4 == 1
    rows = [(i, t, round(90 + r.gauss(0, 9 if noisy(t) else 1), 2)) for i, t in enumerate(range(0, 40 * 86_400, 1_200))]
    spikes = {i for i, t, _ in rows if i % 251 == 100 and not noisy(t)}
    rows = [(i, t, v + 14 if i in spikes else v) for i, t, v in rows]
    assert len(spikes) > 5 and _flagged(spark, rows) == spikes
    assert _flagged(spark, rows, Limits(context_weight=1e12)) != spikes


def test_a_fast_change_is_a_case_where_levels_vary(spark):
    """Far from what a minute changes, though within what days do."""
    r = random.Random(2)
    rows, cases = [], set()
    for s in range(400):
        level = r.uniform(60, 130)
        for k in range(5):
            rows.append((len(rows), s * 20_000 + 60 * k, round(level + r.gauss(0, 0.5), 2)))
        if s % 40 == 7:
            i, t, v = rows[-3]
            rows[-3] = (i, t, v + 25)
            cases.add(i)
    assert _flagged(spark, rows) == cases
    assert _flagged(spark, rows, Limits(near_minutes=0.0)) == set()


def test_few_values_are_judged_by_the_usual_range(spark):
    assert _flagged(spark, [(i, 60 * i, v) for i, v in enumerate([80.0, 81.0, 80.0, 250.0, 82.0])]) == {3}
    assert _flagged(spark, [(0, 0, 80.0), (1, 60, 95.0)]) == set()


def test_sketches():
    from telar.operators.sketch import Sketch, ranked

    r = np.random.default_rng(0)
    values = [r.integers(0, 10**6, n) for n in (0, 3, 5_000, 70_000, 1)]
    whole = np.sort(np.concatenate(values))
    one = Sketch.of(values[0], 200)
    for x in values[1:]:
        one = one.merge(Sketch.of(x, 200), 200)
    assert len(one.values) <= 400 and one.n == pytest.approx(len(whole)) and np.isnan(Sketch.of(values[0], 5).quantile(0.5))
    for p in (0.1, 0.25, 0.5, 0.9):
        assert abs(np.searchsorted(whole, one.quantile(p)) / len(whole) - p) < 0.01
    assert Sketch.of(np.array([5, 1, 3, 4]), 9).quantile(0.25) == 1 and Sketch.of(np.array([5, 1, 3, 4]), 9).quantile(0.26) == 3
    group = r.integers(0, 40, 3_000)
    x = r.integers(0, 50, 3_000)
    n, q = ranked(group, x, 41, (0.75,))
    assert n[40] == 0 and np.isnan(q[40]) and all(q[i] == Sketch.of(x[group == i], 9_999).quantile(0.75) for i in range(40))


def test_a_source_that_does_not_vary_is_stuck(spark):
    at = dt.datetime(2024, 1, 1)
    values = {1: [72.0] * 8, 2: [72.0] * 66, 3: [72.0] * 40 + [80.0] * 30, 4: [72.0] * 7, 5: [72.0] * 9 + [70.0 + i % 7 for i in range(60)]}
    rows = [(1000 * d + i, d, at + dt.timedelta(minutes=i), v, None) for d, own in values.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "id long, disp long, en timestamp, hr double, mov int")
    found = flag_measurements(df, "id", "disp", "en", FIELDS).filter("atascado").groupBy("disp").count().collect()
    assert {r.disp: r["count"] for r in found} == {1: 8, 2: 66, 3: 70, 5: 9}


def test_flags_do_not_depend_on_the_partitions(spark):
    rows, cases = readings(5)
    df = spark.createDataFrame([(i, d, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), h, m) for i, d, t, h, m in rows], "id int, disp int, en timestamp, hr double, mov int")
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert {(x.id, x.campo) for x in flag_measurements(df, "id", "disp", "en", FIELDS, Limits(sketch_k=800)).collect()} == cases
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_numbered(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, 2, None]), dt.datetime(2024, 1, r.randint(1, 9), r.randint(0, 23)) if i % 50 else None) for i in range(500)]
    got = {x.id: x.n for x in numbered(spark.createDataFrame(rows, "id long, k int, t timestamp").repartition(4), ["k"], "t", ["id"]).collect()}
    for k in (1, 2, None):
        own = sorted((x for x in rows if x[1] == k), key=lambda x: (x[2] is not None, x[2] or dt.datetime.min, x[0]))
        assert [got[x[0]] for x in own] == list(range(1, len(own) + 1))


def test_skew_safe_join(spark):
    big = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50 + 100).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = skew_safe_join(big, small, ["k"], "n")
    assert got.count() == big.filter("k is not null").count() and got.filter("id > m").count() == 0
