"""Published views, clinical reads and the ingestion of packages over the canonical data set."""

import json

import pytest
from canonical import build
from pyspark.sql import functions as F

from telar.plans import clinical, etl, ingest, views
from telar.plans.clinical import Identity
from telar.session import checkpoint
from telar.sources import dataset

@pytest.fixture(scope="module")
def today(spark):
    return F.lit("2025-12-01").cast("date")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("d") / "doc.json"
    path.write_text(json.dumps(build()))
    return {n: checkpoint(df) for n, df in dataset.read_dataset(spark, str(path)).items()}


@pytest.fixture(scope="module")
def star(spark, tables):
    new = checkpoint(etl.facts_of(etl.new_readings(tables, None)))
    dims = etl.dimensions(tables)
    name = lambda df, key: df.select(key, F.concat(F.lit(key), F.col(key).cast("string")).alias("seudonimo"))
    return {n: checkpoint(df) for n, df in (dims | {"hechos": new, "seudonimos": name(dims["dim_embarazo"], "id_embarazo"), "seudonimos_paciente": name(dims["dim_paciente"], "id_paciente")}).items()}


def test_views(tables, star, today):
    v = views.published(star, tables, today)
    assert len(v) == 11
    n = {name: df.count() for name, df in v.items()}
    assert n == {"v_embarazo": 30, "v_lectura": 1180, "v_resumen_administrativo": n["v_resumen_administrativo"], "v_tiempo_gestacional": 40, "v_semaforo": 3, "v_factor_riesgo": 3, "v_entitlement_medico": 30, "v_entitlement_paciente_medico": 30, "v_paciente_medico": 30, "v_embarazo_medico": 30, "v_embarazo_factor_riesgo": 23}
    h = star["hechos"].toPandas()
    cells = {}
    for clinic, at, level, pregnancy, hr in zip(h.id_clinica, h.fecha_hora, h.id_semaforo, h.id_embarazo, h.hr_valor):
        cells.setdefault((f"P{clinic - 100}", f"{at:%Y-%m}-01", ("OK", "WARNING", "ERROR")[level - 100]), []).append((pregnancy, hr))
    for least in (1, 2, 3):
        got = {(r.provincia, str(r.mes), r.codigo_semaforo): (r.lecturas, r.embarazos) for r in views.v_resumen_administrativo(star, least).collect()}
        assert got and got == {k: (len(x), len({p for p, _ in x})) for k, x in cells.items() if len({p for p, _ in x}) >= least}
    assert n["v_resumen_administrativo"] == sum(len({p for p, _ in x}) >= 5 for x in cells.values())
    for name, df in v.items():
        assert not [c for c in df.columns if c.startswith("id_")], name
    assert v["v_embarazo"].columns == views.CONTRACT and set(views.CONTRACT) < set(v["v_embarazo_medico"].columns)
    one = v["v_embarazo"].filter("seudonimo_embarazo = 'id_embarazo101'").first()
    assert (str(one.mes_inicio), str(one.mes_probable_parto), one.cerrado, one.edad_tramo_inicio, one.provincia) == ("2025-01-01", "2025-10-01", False, 25, "P1")
    exact = v["v_embarazo_medico"].filter("seudonimo_embarazo = 'id_embarazo101'").first()
    assert (str(exact.fecha_inicio), exact.nombre_clinica, exact.distrito) == ("2025-01-15", "Clinica 1", "d")
    assert v["v_paciente_medico"].filter("seudonimo_paciente = 'id_paciente105'").first().paciente_display == "Ana A105 — 8-105"
    seq = v["v_lectura"].select("seudonimo_embarazo", "secuencia_sesion").distinct().groupBy("seudonimo_embarazo").agg(F.min("secuencia_sesion").alias("a"), F.max("secuencia_sesion").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == 1 and r.b == r.n for r in seq) and sum(r.n for r in seq) == 732


def test_means_are_rounded_away_from_zero(spark):
    df = spark.createDataFrame([(1, "80.05"), (1, "80.05"), (2, "-80.05"), (2, None), (3, None), (4, "80.04"), (4, "80.05")], "k int, v string").withColumn("v", F.col("v").cast("decimal(5,2)"))
    assert {r.k: r.m for r in df.groupBy("k").agg(views.mean_to_tenths("v").alias("m")).collect()} == {1: 80.1, 2: -80.1, 3: None, 4: 80.0}


def test_only_follow_up_in_force_grants(spark, tables, star, today):
    follow = tables["seguimiento_clinico"]
    changed = follow.withColumn("activo", F.col("id_embarazo") != 100).withColumn("fecha_fin", F.when(F.col("id_embarazo") == 101, F.date_sub(today, 1)).when(F.col("id_embarazo") == 102, today)).withColumn("fecha_asignacion", F.when(F.col("id_embarazo") == 103, F.date_add(today, 1)).otherwise(F.col("fecha_asignacion")))
    twice = changed.unionByName(changed.withColumn("rol_seguimiento", F.lit("APOYO")))
    source = tables | {"seguimiento_clinico": twice, "usuarios": tables["usuarios"].withColumn("activo", F.col("id_usuario") != 106).withColumn("email", F.upper("email"))}
    got = {(r.upn_medico, r.seudonimo_embarazo) for r in views.v_entitlement_medico(star, source, today).collect()}
    assert got == {(f"u{2 + (i - 100) % 5}@x.invalid", f"id_embarazo{i}") for i in range(102, 130) if i != 103 and (i - 100) % 5 != 4}
    assert views.v_embarazo_medico(star, source, today).count() == len(got)
    assert views.v_embarazo_factor_riesgo(star, source | {"roles": tables["roles"].withColumn("nombre_rol", F.lit("ADMIN"))}, today).count() == 0


def test_clinical_reads(spark, tables, today):
    patient, physician, admin = Identity("PACIENTE", 105), Identity("MEDICO", 102), Identity("ADMIN", 1)
    assert [r.id_embarazo for r in clinical.episodes(tables, patient, today).collect()] == [105]
    seen = [r.id_embarazo for r in clinical.episodes(tables, physician, today).collect()]
    assert seen == [127, 122, 117, 112, 107, 102] and clinical.episodes(tables, admin, today).count() == 0
    s = clinical.sessions(tables, physician, today, 107).collect()
    assert len(s) > 10 and s == sorted(s, key=lambda r: (r.fecha_inicio, r.id_sesion), reverse=True)
    assert clinical.sessions(tables, physician, today, 108).count() == 0 == clinical.sessions(tables, physician, today, 9999).count()
    r = clinical.readings(tables, physician, today, s[-1].id_sesion).collect()
    assert r and r == sorted(r, key=lambda x: (x.fecha_hora_captura, x.id_lectura)) and clinical.readings(tables, patient, today, s[-1].id_sesion).count() == 0
    answer = clinical.monitoring(tables, physician, today, 107)
    rows = clinical.scoped_readings(tables, physician, today).filter("id_embarazo = 107").collect()
    newest = max(rows, key=lambda x: (x.fecha_hora_captura, x.id_lectura))
    assert answer["ultima"].first().id_lectura == newest.id_lectura
    for x in answer["valores"].collect():
        own = max((y for y in rows if y[x.metrica] is not None), key=lambda y: (y.fecha_hora_captura, y.id_lectura))
        assert x.valor == float(own[x.metrica])
    assert answer["series"].count() == sum(y[m] is not None for y in rows for m in clinical.METRICS)
    text = clinical.summary(tables, physician, today, 107, days=10, most=4)
    got = text["lecturas"].collect()
    assert 0 < len(got) <= 4 and got[0].id_lectura == newest.id_lectura and all((newest.fecha_hora_captura - x.fecha_hora_captura).days <= 10 for x in got)
    assert text["clasificacion"].first().codigo_nivel == newest.codigo_nivel
    assert clinical.summary(tables, physician, today, 107, days=None, most=None)["lecturas"].count() == len(rows)
    assert clinical.summary(tables, patient, today, 107)["lecturas"].count() == 0


def package(**changes):
    reading = {"id_tiempo_gest": 119, "id_semaforo": 100, "fecha_hora_captura": "2025-05-20T09:01:00-05:00", "fecha_hora_sincronizacion": None, "hr_valor": 80, "spo2_valor": 97.5, "mov_valor": None}
    p = {"id_embarazo": 100, "id_dispositivo": 100, "tipo_sesion": "SIGNOS_MATERNOS", "fecha_inicio": "2025-05-20T09:00:00-05:00", "fecha_fin": "2025-05-20T09:30:00-05:00", "lecturas": [reading]}
    return p | changes


def test_ingestion_end_to_end(spark, tables):
    good = package()
    late = package(lecturas=[good["lecturas"][0], {**good["lecturas"][0], "id_tiempo_gest": 118}])
    rows = [
        ("r", "clave-001", json.dumps(good), 1), ("r", "clave-001", json.dumps(good), 2), ("r", "clave-001", json.dumps(package(fecha_fin="2025-05-20T09:31:00-05:00")), 3), ("otro", "clave-001", json.dumps(good), 4),
        ("r", "corta", json.dumps(good), 5), ("r", "clave-002", "{", 6), ("r", "clave-002", json.dumps(good), 7), ("r", "clave-003", json.dumps(package(id_embarazo=999)), 8), ("r", "clave-004", json.dumps(late), 9),
        ("r", "clave-005", json.dumps(good), 10), ("r", "clave-006", json.dumps(good), 11), (None, "clave-007", json.dumps(good), 12), ("r", None, None, 13),
    ]
    arrived = spark.createDataFrame(rows, "recurso string, clave string, payload string, llegada long")
    held = spark.createDataFrame([("r", "clave-005", "x", None, 0), ("r", "clave-006", "x", 77, 0)], "recurso string, clave string, huella string, id_sesion long, llegada long")
    out = ingest.process(arrived.repartition(5), tables, held)
    got = {r.llegada: r for r in out["respuestas"].collect()}
    assert {i: r.resultado for i, r in got.items()} == {1: "nueva", 2: "repeticion", 3: "colision", 4: "nueva", 5: "invalida", 6: "invalida", 7: "nueva", 8: "invalida", 9: "invalida", 10: "incompleta", 11: "colision", 12: "invalida", 13: "invalida"}
    assert got[1].id_sesion == got[2].id_sesion != got[4].id_sesion and got[3].id_sesion is None and got[10].id_sesion is None
    faults = {(r.llegada, r.regla, r.indice) for r in out["faltas"].collect()}
    assert {(5, "clave_invalida", None), (6, "ilegible", None), (8, "embarazo_inexistente", None), (8, "dispositivo_sin_asignacion", None), (9, "semana_distinta", 1), (12, "sin_recurso", None), (13, "clave_invalida", None)} <= faults
    assert {x[0] for x in faults} == {5, 6, 8, 9, 12, 13}
    sessions, readings = out["sesiones"].collect(), out["lecturas"].collect()
    assert {r.id_sesion for r in sessions} == {got[i].id_sesion for i in (1, 4, 7)} == {r.id_sesion for r in readings} and len(readings) == 3 == len({r.id_lectura for r in readings})
    assert sessions[0].estado_sesion == "PENDIENTE" and out["reclamos"].count() == 3
    # what was taken is held from then on
    again = ingest.process(arrived.filter("llegada = 1"), tables, out["reclamos"])
    assert [(r.resultado, r.id_sesion) for r in again["respuestas"].collect()] == [("repeticion", got[1].id_sesion)] and again["sesiones"].count() == 0
    assert all(df.count() == 0 for df in ingest.process(arrived.limit(0), tables).values())
