import pytest
from pyspark.sql import functions as F

from telar.functions import axis, delivery, levels, text, timeutil
from telar.operators import merging


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


HR = [("54", "E"), ("54.99", "E"), ("55", "W"), ("57", "W"), ("59", "W"), ("59.99", "W"), ("60", "O"), ("99", "O"), ("99.99", "O"), ("100", "W"), ("110", "W"), ("110.01", "E"), ("111", "E"), ("0.01", "E"), ("999.99", "E"), (None, None)]
SPO2 = [("0", "E"), ("91", "E"), ("91.99", "E"), ("92", "W"), ("94", "W"), ("94.5", "W"), ("94.99", "W"), ("95", "O"), ("99", "O"), ("100", "O"), (None, None)]
FULL = {"E": "ERROR", "W": "WARNING", "O": "OK", None: None}


@pytest.mark.parametrize("table,level", [(HR, levels.hr_level), (SPO2, levels.spo2_level)])
def test_level_bounds(spark, table, level):
    df = spark.createDataFrame([(v,) for v, _ in table], "v string").select(level(F.col("v").cast("decimal(5,2)")).alias("x"))
    assert [r.x for r in df.collect()] == [FULL[w] for _, w in table]


def test_movement_levels(spark):
    rows = [(m, w, t) for m in (0, 4, 5, 9, 10, 14, 40) for w, t in ((20, 2), (27, 2), (28, 3), (40, 3))] + [(-1, 20, 2), (10, 19, 2), (10, 30, 1), (None, 30, 3)]
    got = values(spark, rows, "m int, w int, t int", levels.mov_level(F.col("m"), F.col("w"), F.col("t")))
    assert got == [w for w in ("ERROR", "ERROR", "WARNING", "WARNING", "OK", "OK", "OK") for _ in range(4)] + [None] * 4


def test_severest_and_catalogue(spark):
    rows = [("OK", None, "ERROR"), (None, None, None), ("OK", "WARNING", None), ("OK", None, None)]
    assert values(spark, rows, "a string, b string, c string", levels.severest(F.col("a"), F.col("b"), F.col("c"))) == ["ERROR", None, "WARNING", "OK"]
    good = [("OK", 1, "SIM-1.0"), ("WARNING", 2, "SIM-1.0"), ("ERROR", 3, "SIM-1.0")]
    assert levels.catalogue_faults(good) == [] and len(levels.catalogue_faults([("OK", 2, "SIM-2.0"), ("X", 1, "SIM-1.0")])) == 5
    with pytest.raises(ValueError):
        levels.rules("SIM-9")


def test_weeks_and_ages(spark):
    rows = [(280, 40), (0, 0), (7, 1), (8, None), (-7, None)]
    start = F.lit("2025-01-01").cast("date")
    assert values(spark, rows, "n int, w int", timeutil.exact_weeks(F.date_add(start, F.col("n")), start)) == [w for _, w in rows]
    assert values(spark, [(0,), (6,), (7,), (-1,), (-3,), (-8,)], "n int", timeutil.gestational_week(F.date_add(start, F.col("n")), start)) == [1, 1, 2, 0, 0, -1]
    ages = [("2023-02-28", "2000-02-29", 20), ("2025-03-01", "2000-02-29", 25), ("2025-02-27", "2000-02-28", 20), (None, "2000-01-01", None)]
    assert values(spark, [x[:2] for x in ages], "a string, b string", timeutil.age_band(F.to_date("a"), F.to_date("b"))) == [x[2] for x in ages]
    assert values(spark, [(13,), (14,), (27,), (28,), (None,)], "w int", timeutil.trimester(F.col("w"))) == [1, 2, 2, 3, None]
    assert values(spark, [(1,), (4,), (5,), (36,), (40,)], "w int", timeutil.gestational_month(F.col("w"))) == [1, 1, 2, 9, 9]


def test_clinical_day_in_any_session_zone(spark):
    for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = spark.sql("select explode(array(timestamp'2025-01-01 04:59:59Z', timestamp'2025-01-01 05:00:00Z', timestamp'2025-07-01 04:30:00Z')) t").select(timeutil.clinical_day("t").cast("string").alias("d"), text.utc_instant(F.col("t")).alias("u")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r.d for r in got] == ["2024-12-31", "2025-01-01", "2025-06-30"] and got[0].u == "2025-01-01T04:59:59+00:00"


def test_texts(spark):
    assert values(spark, [("a", "", None), ("", None, None), (" a", "b ", "c")], "a string, b string, c string", text.full_name(F.col("a"), F.col("b"), F.col("c"))) == ["a", None, " a b  c"]
    assert values(spark, [("\t A@B.c \n",), (None,)], "e string", text.canonical_email(F.col("e"))) == ["a@b.c", None]
    assert values(spark, [("1.5",), ("0",), ("NaN",), ("",), (None,), ("x",), ("Infinity",)], "v string", text.finite(F.col("v"))) == [1.5, 0.0, None, None, None, None, None]
    assert values(spark, [("2025-02-28",), ("2025-02-30",), ("2025-2-3",), (None,)], "v string", text.valid_date(F.col("v")).cast("string")) == ["2025-02-28", None, None, None]
    assert values(spark, [("97",), ("-0.00",), (None,)], "v string", text.hundredths(F.col("v").cast("decimal(5,2)"))) == ["97.00", "0.00", "null"]
    assert values(spark, [("no: postgresql://u:p@h:5/d x",)], "v string", text.redact_urls(F.col("v"))) == ["no: <url> x"]
    draws = values(spark, [(i,) for i in range(500)], "i int", text.draw(1, F.col("i")))
    assert 0 <= min(draws) < max(draws) < 1 and abs(sum(draws) / 500 - 0.5) < 0.06


def test_axes(spark):
    for span, want in ((8.0, 2.0), (9.0, 2.5), (3.0, 1.0), (41.0, 20.0), (0.0, 1.0), (0.03, 0.01)):
        assert values(spark, [(span,)], "s double", axis.nice_step(F.col("s"))) == pytest.approx([want])
    assert values(spark, [(71.0, 88.0)], "a double, b double", axis.marks(F.col("a"), F.col("b"), F.lit(5.0))) == [[65.0, 70.0, 75.0, 80.0, 85.0, 90.0]]
    assert values(spark, [(0.0, 14.0)], "a double, b double", axis.marks(F.col("a"), F.col("b"), F.lit(5.0), True)) == [[0.0, 5.0, 10.0, 15.0]]
    for low, high, bars, want in ((5.0, 9.0, False, [5.0, 9.0]), (5.0, 9.0, True, [0.0, 9.0]), (8.0, 8.0, False, [7.6, 8.4]), (0.0, 0.0, True, [0.0, 1.0]), (0.0, 0.0, False, [-1.0, 1.0]), (-4.0, -4.0, False, [-4.2, -3.8])):
        assert values(spark, [(low, high)], "a double, b double", F.array(*axis.bounds(F.col("a"), F.col("b"), bars)))[0] == pytest.approx(want)
    assert values(spark, [(5.0,), (10.0,)], "v double", axis.scaled(F.col("v"), F.lit(0.0), F.lit(10.0), 200.0, 0.0)) == [100.0, 0.0]


def test_delivery(spark):
    rows = [(201, True, "ENTREGADO"), (201, False, "RECHAZO"), (409, True, "RECHAZO"), (503, True, "REINTENTO"), (401, True, "REINTENTO_Y_ALTO"), (422, True, "RECHAZO"), (302, True, "RECHAZO"), (599, True, "REINTENTO"), (600, True, "RECHAZO"), (999, True, "RECHAZO"), (None, True, "REINTENTO")]
    assert values(spark, [x[:2] for x in rows], "c int, k boolean", delivery.outcome(F.col("c"), F.col("k"))) == [x[2] for x in rows]
    assert values(spark, [(k,) for k in (1, 2, 3, 4, 7, 2000)], "k int", delivery.backoff(F.col("k"))) == [1, 2, 4, 8, 60, 60]
    assert delivery.lease_seconds() == 70
    body = '{"id_sesion":1,"lecturas_creadas":2,"ids_lectura":[7,8]}'
    answers = [("true", body, 2, True), ("false", body, 2, True), (None, body, 2, False), ("si", body, 2, False), ("true", body, 3, False), ("true", body.replace(",8", ""), 2, False), ("true", "{", 2, False), ("true", None, 2, False), ("true", body.replace('"id_sesion":1,', ""), 2, False)]
    assert values(spark, [x[:3] for x in answers], "r string, b string, n int", delivery.coherent_201(F.col("r"), F.col("b"), F.col("n"))) == [x[3] for x in answers]
    queue = [("PENDIENTE", None, 1, 10, None, True), ("FALLIDO", True, 1, 5, False, True), ("FALLIDO", False, 1, 5, False, False), ("PENDIENTE", None, 5, 5, False, False), ("PENDIENTE", None, 1, 5, True, False), ("ENVIADO", None, 1, 5, False, False), ("PENDIENTE", None, 1, 99, False, False)]
    ok = delivery.eligible(F.col("s"), F.col("r"), F.col("n"), F.lit(5), F.col("t"), F.lit(10), F.col("a"))
    assert values(spark, [x[:5] for x in queue], "s string, r boolean, n int, t int, a boolean", ok) == [x[5] for x in queue]


def test_merges(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (None, "m")], "k int, v string")
    got = {(r.k, r.v): r.accion for r in merging.type1_merge(t, s, ["k"], ["v"]).collect()}
    assert got == {(1, "a"): "igual", (2, "b"): "actualizada", (3, "c"): "conservada", (4, "d"): "insertada", (None, "m"): "actualizada"}
    new = spark.createDataFrame([(1, "x"), (5, "x"), (5, "x"), (None, "x")], "k int, v string")
    assert {(r.k, r.motivo) for r in merging.append_anomalies(t, new, "k").collect()} == {(1, "existe"), (5, "repetida"), (None, "nula")}
    minted = merging.mint_pseudonyms(t, new, "k").collect()
    assert [r.k for r in minted] == [5] and len(minted[0].seudonimo) == 36
    c = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "x"), (4, None, "x"), (5, None, None)], "id int, k string, h string")
    assert {r.id: r.resultado for r in merging.claim_outcomes(c, ["k"], "h", ["id"]).collect()} == {1: "nueva", 2: "colision", 3: "repeticion", 4: "nueva", 5: "colision"}
    c = c.withColumn("listo", F.col("id") != 1)
    assert {r.id: r.resultado for r in merging.claim_outcomes(c, ["k"], "h", ["id"], "listo").collect()} == {1: "nueva", 2: "incompleta", 3: "incompleta", 4: "nueva", 5: "colision"}
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "a").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 2).cast("string").alias("h"))
    assert {r.resultado: r["count"] for r in merging.claim_outcomes(hot, ["k"], "h", ["id"]).groupBy("resultado").count().collect()} == {"nueva": 1001, "repeticion": 999, "colision": 1000}


def test_own_day_and_keys(spark):
    rows = [("2025-01-01T23:30:00-05:00", "2025-01-01"), ("2025-01-02T04:30:00Z", "2025-01-02"), ("2025-01-01", "2025-01-01"), ("ayer", None), (None, None)]
    assert values(spark, rows, "t string, d string", timeutil.own_day(F.col("t")).cast("string")) == [d for _, d in rows]
    assert values(spark, [("abcd_-12",), ("corta",), ("x" * 129,), ("con espacio",), (None,), ("abcdefgh\n",)], "k string", text.valid_key(F.col("k"))) == [True, False, False, False, False, False]


def test_registrations_and_accounts(spark):
    from telar.operators.validation import incoherent_accounts, registration_faults

    rows = [(1, "A", "B", "8-1", " Paciente31@Example.com ", "1990-01-01", True), (2, " ", None, "8", "x@y", "2999-01-01", None), (3, "A", "B", "8", None, "1990-02-30", True)]
    got = {}
    for r in registration_faults(spark.createDataFrame(rows, "id int, nombre string, apellido string, cedula string, correo string, fecha_nac string, acepta boolean"), "id", F.lit("2025-01-01").cast("date")).collect():
        got.setdefault(r.id, set()).add(r.regla)
    assert got == {2: {"falta_nombre", "falta_apellido", "correo", "fecha_futura", "aceptacion"}, 3: {"correo", "fecha"}}
    accounts = spark.createDataFrame([(1, "PACIENTE"), (2, "PACIENTE"), (3, "MEDICO"), (4, "ADMIN"), (5, None), (6, "OTRO")], "id_usuario int, rol string")
    p = spark.createDataFrame([(1, 1), (3, 2)], "id_usuario int, id_paciente int")
    m = spark.createDataFrame([(3, 1)], "id_usuario int, id_medico int")
    assert sorted(r.id_usuario for r in incoherent_accounts(accounts, p, m).collect()) == [2, 3, 5, 6]


def test_package_references(spark):
    from telar.operators.validation import package_reference_faults

    day = lambda c: F.col(c).cast("date").alias(c)
    sessions = spark.createDataFrame([(1, 1, 1, "2025-06-01", "2025-06-01"), (2, 9, 1, "2025-06-01", None), (3, 1, 1, "2025-06-30", "2025-07-02")], "id_sesion int, id_embarazo int, id_dispositivo int, desde string, hasta string").select("id_sesion", "id_embarazo", "id_dispositivo", day("desde"), day("hasta"))
    pregnancies = spark.createDataFrame([(1, "2025-01-06")], "id_embarazo int, fecha_inicio string").select("id_embarazo", day("fecha_inicio"))
    assigned = spark.createDataFrame([(1, 1, "2025-01-06", "2025-06-30"), (1, 1, "2025-07-01", None)], "id_dispositivo int, id_embarazo int, fecha_inicio string, fecha_fin string").select("id_dispositivo", "id_embarazo", day("fecha_inicio"), day("fecha_fin"))
    weeks = spark.range(1, 43).select((F.col("id") + 99).cast("int").alias("id_tiempo_gest"), F.col("id").cast("int").alias("semana_gestacion"))
    readings = spark.createDataFrame([(1, 120, "2025-06-01", 4), (3, 110, "2025-06-30", 4), (3, 500, "2025-06-30", None)], "id_sesion int, id_tiempo_gest int, dia string, mov_valor int").select("id_sesion", F.when(F.col("id_tiempo_gest") == 500, 1).otherwise(0).alias("indice"), "id_tiempo_gest", day("dia"), "mov_valor")
    got = {(r.id_sesion, r.regla, r.indice) for r in package_reference_faults(readings, sessions, pregnancies, weeks, assigned).collect()}
    assert got == {(2, "embarazo_inexistente", None), (2, "dispositivo_sin_asignacion", None), (3, "dispositivo_sin_asignacion", None), (3, "semana_inexistente", 1), (3, "semana_distinta", 0), (3, "movimiento_antes_de_semana_20", 0)}
