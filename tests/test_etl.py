import copy
import json

import pytest
from canonical import build
from pyspark.sql import functions as F

from telar.plans import etl
from telar.plans.dataset_load import load_dataset
from telar.session import checkpoint
from telar.sources import dataset
from telar.sources.sinks import LockBusy, Published, append_audit, write_csv, write_json


def written(doc, path):
    path.write_text(json.dumps(doc))
    return str(path)


@pytest.fixture(scope="module")
def doc():
    return build()


@pytest.fixture(scope="module")
def tables(spark, doc, tmp_path_factory):
    return dataset.read_dataset(spark, written(doc, tmp_path_factory.mktemp("d") / "doc.json"))


def test_document_checks(spark, doc, tables, tmp_path):
    path = written(doc, tmp_path / "a.json")
    assert dataset.metadata_faults(spark, path, {"semilla": 20260810, "uso": "real"}) == ["metadata uso: 'ficticio'"]
    assert dataset.dataset_violations(tables).count() == 0
    assert dataset.declared_totals_differ(tables, {"sesiones_monitoreo": 732, "lecturas_biometricas": 1}) == {"lecturas_biometricas": (1, 1180)}
    with pytest.raises(dataset.DatasetMissing):
        dataset.read_dataset(spark, str(tmp_path / "none.json"))
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(dataset.DatasetUnreadable):
        dataset.read_dataset(spark, str(tmp_path / "list.json"))
    bad = copy.deepcopy(doc)
    bad["roles"][0]["extra"] = 1
    del bad["clinicas"][1]["ruc"]
    with pytest.raises(dataset.DatasetError, match="clinicas: missing \\['ruc'\\].*roles: missing \\[\\], unexpected \\['extra'\\]"):
        dataset.read_dataset(spark, written(bad, tmp_path / "b.json"))
    bad = copy.deepcopy(doc)
    bad["roles"].append(bad["roles"][0])
    bad["medicos"][0]["id_especialidad"] = 7
    found = {(r.seccion, r.regla): r.filas for r in dataset.dataset_violations(dataset.read_dataset(spark, written(bad, tmp_path / "c.json"))).collect()}
    assert found == {("roles", "clave_repetida"): 1, ("medicos", "id_especialidad -> especialidades"): 1}


def test_a_document_is_loaded_whole_or_not_at_all(spark, doc, tmp_path):
    store = Published(spark, str(tmp_path / "store"))
    load = lambda d, **k: load_dataset(spark, written(d, tmp_path / "d.json"), store, **k)
    first = load(doc, metadata={"semilla": 20260810}, declared={"sesiones_monitoreo": 732})
    assert first["lecturas_biometricas"] == 1180 and first["medico_clinica"] == 5
    assert not any(load(doc).values())
    more = copy.deepcopy(doc)
    more["roles"].append({"id_rol": 999, "nombre_rol": "X"})
    more["medico_clinica"].append({**doc["medico_clinica"][0], "fecha_inicio": "2025-02-01"})
    assert {s: n for s, n in load(more).items() if n} == {"roles": 1, "medico_clinica": 1} and store.read("roles").count() == 4
    version = store.current()
    other = copy.deepcopy(more)
    other["clinicas"][0] |= {"provincia": "otra", "ruc": "9"}
    with pytest.raises(dataset.DatasetError, match="^clinicas: 1 rows differ in ruc,provincia$"):
        load(other)
    with pytest.raises(dataset.DatasetError, match="metadata semilla: 20260810"):
        load(doc, metadata={"semilla": 1})
    with pytest.raises(dataset.DatasetError, match="roles: 3 rows of 4 declared"):
        load(doc, declared={"roles": 4})
    naive = copy.deepcopy(doc)
    naive["dispositivos"][3]["fecha_registro"] = "2025-01-01T00:00:00"
    with pytest.raises(dataset.DatasetError, match="^dispositivos.fecha_registro: instants without a zone$"):
        load(naive)
    assert store.current() == version


def test_canonical_load_gives_the_published_counts(spark, doc, tables, tmp_path):
    star = Published(spark, str(tmp_path / "star"))
    counters = etl.run(tables, star)
    assert counters["hechos.nuevos"] == 1180 and counters["seudonimos.nuevos"] == 30
    assert {n: counters[f"{n}.insertada"] for n in etl.DIMENSIONS} == {"dim_clinica": 3, "dim_semaforo": 3, "dim_tiempo_gestacional": 40, "dim_factor_riesgo": 3, "dim_medico": 5, "dim_paciente": 30, "dim_embarazo": 30, "puente_embarazo_factor": 23}
    h = star.read("hechos")
    count = lambda c: {r[c]: r["count"] for r in h.filter(f"{c} is not null").groupBy(c).count().collect()}
    assert count("estado_hr") == {"OK": 472, "WARNING": 76, "ERROR": 12}
    assert count("estado_spo2") == {"OK": 478, "WARNING": 64, "ERROR": 18}
    assert count("estado_mov") == {"OK": 436, "WARNING": 155, "ERROR": 29}
    assert count("id_semaforo") == {100: 826, 101: 295, 102: 59}
    assert h.select("id_sesion").distinct().count() == 732
    checks = etl.reconcile(tables, {n: star.read(n) for n in (*etl.DIMENSIONS, "hechos")}).collect()
    assert len(checks) == 28 and sum(not r.bloqueante for r in checks) == 3 and not [r for r in checks if r.bloqueante and r.discrepancias]
    assert {r.control: r.discrepancias for r in checks if not r.bloqueante} == {"clasificacion_embarazo_pendiente": 30, "semana_recalculada_distinta": 0, "sesiones_sin_lecturas": 0}
    factors = star.read("dim_embarazo").join(star.read("puente_embarazo_factor").groupBy("id_embarazo").count(), "id_embarazo", "left").groupBy(F.coalesce("count", F.lit(0)).alias("n")).count()
    assert {r.n: r["count"] for r in factors.collect()} == {0: 14, 1: 9, 2: 7}

    # again: nothing new, pseudonyms stay
    before = {r.id_embarazo: r.seudonimo for r in star.read("seudonimos").collect()}
    again = etl.run(tables, star)
    assert again["hechos.nuevos"] == 0 and not [k for k in again if k.endswith(("insertada", "actualizada"))]
    assert {r.id_embarazo: r.seudonimo for r in star.read("seudonimos").collect()} == before

    # late and lower ids are loaded by difference; changed loaded readings stop the run and change nothing
    late = dict(tables)
    one = tables["lecturas_biometricas"].limit(1)
    late["lecturas_biometricas"] = tables["lecturas_biometricas"].unionByName(one.withColumn("id_lectura", F.lit(7)))
    version = star.current()
    changed = dict(tables)
    changed["lecturas_biometricas"] = tables["lecturas_biometricas"].withColumn("hr_valor", (F.col("hr_valor") + F.when(F.col("id_lectura") == 100, 1).otherwise(0)).cast("decimal(5,2)"))
    with pytest.raises(ValueError, match="contenido_divergente: 1"):
        etl.run(changed, star)
    assert star.current() == version
    assert etl.run(late, star)["hechos.nuevos"] == 1


def test_faults_are_rows_and_stop_the_run(spark, doc, tables, tmp_path):
    bad = dict(tables)
    follow = tables["seguimiento_clinico"]
    bad["seguimiento_clinico"] = follow.filter("id_embarazo <> 100").unionByName(follow.filter("id_embarazo = 101").withColumn("id_seguimiento", F.lit(999)))
    bad["medico_clinica"] = tables["medico_clinica"].withColumn("id_clinica", F.when(F.col("id_medico") == 102, 100).otherwise(F.col("id_clinica")))
    bad["lecturas_biometricas"] = tables["lecturas_biometricas"].withColumn("id_semaforo", F.when(F.col("id_lectura") == 400, 102).otherwise(F.col("id_semaforo")))
    new = etl.new_readings(bad, None)
    rules = {r.regla: r["count"] for r in etl.violations(new).groupBy("regla").count().collect()}
    assert set(rules) == {"medico_ausente", "medico_ambiguo", "afiliacion_ajena", "semaforo_distinto"} and rules["semaforo_distinto"] == 1
    seen = etl.preview(new, tables["embarazos"].filter("id_embarazo < 110"))
    assert seen.count() == 1180 and "hr_valor" not in seen.columns and seen.filter("embarazo_en_dimension").select("id_embarazo").distinct().count() == 10
    star = Published(spark, str(tmp_path / "star"))
    with pytest.raises(etl.LoadRefused, match="medico_ambiguo"):
        etl.run(bad, star)
    assert star.current() is None
    two = dict(tables)
    two["telefonos_medico"] = tables["telefonos_medico"].withColumn("principal", F.lit(True)).withColumn("tipo_contacto", F.lit("CELULAR"))
    two["embarazos"] = tables["embarazos"].withColumn("fecha_probable_parto", F.date_add("fecha_probable_parto", 1))
    assert {r.regla for r in etl.dimension_faults(two).collect()} == {"telefono_ambiguo_medico", "duracion_no_exacta"}


def test_orphans_of_a_written_star(spark, tables):
    star = etl.dimensions(tables) | {"hechos": etl.facts_of(etl.new_readings(tables, None))}
    star = {n: checkpoint(df) for n, df in star.items()}
    one = lambda n, key, value, to: star[n].withColumn(key, F.when(F.col(value[0]) == value[1], to).otherwise(F.col(key)))
    h = star["hechos"].toPandas()
    reading, patient, week = int(h.id_lectura[0]), int(h.id_paciente[0]), int(h.id_tiempo_gestacional[0])
    physician, pregnancy = star["dim_medico"].first().id_medico, star["dim_embarazo"].first().id_embarazo
    link = star["puente_embarazo_factor"].first()
    links = {c: star["puente_embarazo_factor"].filter(F.col(c) == link[c]).count() for c in ("id_embarazo", "id_factor_riesgo")}
    own = star["dim_embarazo"].filter(F.col("id_paciente") == patient).count()
    cases = [
        ({}, 0, 0),
        ({"dim_paciente": star["dim_paciente"].filter(F.col("id_paciente") != patient)}, int((h.id_paciente == patient).sum()), own),
        ({"dim_tiempo_gestacional": star["dim_tiempo_gestacional"].filter(F.col("id_tiempo_gestacional") != week)}, int((h.id_tiempo_gestacional == week).sum()), 0),
        *[({"hechos": one("hechos", key, ("id_lectura", reading), None)}, 1, 0) for key in ("id_paciente", "id_medico", "id_clinica", "id_tiempo_gestacional", "id_embarazo", "id_semaforo")],
        ({"dim_medico": one("dim_medico", "id_clinica", ("id_medico", physician), 999)}, 0, 1),
        ({"dim_medico": one("dim_medico", "id_clinica", ("id_medico", physician), None)}, 0, 0),
        ({"dim_paciente": one("dim_paciente", "id_clinica", ("id_paciente", patient), 999)}, 0, 1),
        ({"dim_embarazo": one("dim_embarazo", "id_paciente", ("id_embarazo", pregnancy), None)}, 0, 1),
        ({"puente_embarazo_factor": one("puente_embarazo_factor", "id_embarazo", ("id_embarazo", link.id_embarazo), 999)}, 0, links["id_embarazo"]),
        ({"puente_embarazo_factor": star["puente_embarazo_factor"].withColumn("id_embarazo", F.lit(999)).withColumn("id_factor_riesgo", F.lit(999))}, 0, 23),
        ({"dim_factor_riesgo": star["dim_factor_riesgo"].filter(F.col("id_factor_riesgo") != link.id_factor_riesgo)}, 0, links["id_factor_riesgo"]),
    ]
    for changed, facts, dimensions in cases:
        found = etl.reconcile(tables, star | changed).filter("control in ('huerfanos_del_hecho', 'huerfanos_de_dimensiones')").collect()
        assert {r.control: r.discrepancias for r in found} == {"huerfanos_del_hecho": facts, "huerfanos_de_dimensiones": dimensions}, changed


def test_publication_is_all_or_nothing(spark, tmp_path):
    p = Published(spark, str(tmp_path / "p"))
    one, two = spark.range(3), spark.range(5)
    p.publish({"t": one})
    held = p.read("t")
    with pytest.raises(ValueError):
        p.publish({"t": two}, lambda t: ["no"])
    assert p.read("t").count() == 3
    p.publish({"t": two})
    assert p.read("t").count() == 5 and held.count() == 3
    with p.writing():
        with pytest.raises(LockBusy):
            p.publish({"t": one})
    assert p.read("t").count() == 5


def test_overlapping_runs(spark, tables, tmp_path):
    """The second of two runs is refused at once; a lock of a run that died can be taken over, and not used by it any more."""
    star = Published(spark, str(tmp_path / "star"))
    with star.writing() as write:
        with pytest.raises(LockBusy):
            etl.run(tables, star)
        write.publish({"a": spark.range(2)})
    assert star.read("a").count() == 2
    dead = star.writing()
    lost = dead.__enter__()
    with pytest.raises(LockBusy), star.writing(stale_after_s=600):
        pass
    with star.writing(stale_after_s=-1) as write:
        write.publish({}, {"a": spark.range(3)})
        with pytest.raises(LockBusy):
            lost.publish({"a": spark.range(9)})
    dead.__exit__(None, None, None)
    assert star.read("a").count() == 5
    with star.writing() as write:
        old = write.base
        write.compact("a", 1)
    assert star.read("a").count() == 5 and len(star.folders(star.current())["a"]) == 1 and star.read("a", old).count() == 5


def test_a_load_writes_only_what_is_new(spark, tables, tmp_path):
    star = Published(spark, str(tmp_path / "star"))
    first = dict(tables)
    first["lecturas_biometricas"] = tables["lecturas_biometricas"].filter("id_lectura < 1000")
    assert etl.run(first, star)["hechos.nuevos"] == 900
    held = star.folders(star.current())["hechos"]
    assert etl.run(tables, star, declared={"lecturas_biometricas": 1180})["hechos.nuevos"] == 280
    now = star.folders(star.current())["hechos"]
    assert now[:1] == held and len(now) == 2 and spark.read.parquet(f"{star.path}/{now[1]}").count() == 280
    with pytest.raises(etl.LoadRefused, match="lecturas_biometricas: 1180 rows of 1181"):
        etl.run(tables, star, declared={"lecturas_biometricas": 1181})


def test_the_catalogue_must_be_that_of_the_rules(spark, tables, tmp_path):
    star = Published(spark, str(tmp_path / "star"))
    other = dict(tables)
    other["semaforos"] = tables["semaforos"].withColumn("version_referencia", F.lit("SIM-2.0"))
    with pytest.raises(etl.LoadRefused, match="version of ERROR is SIM-2.0"):
        etl.run(other, star)
    other["semaforos"] = tables["semaforos"].withColumn("prioridad", F.lit(1).cast("short"))
    with pytest.raises(etl.LoadRefused, match="priority of WARNING is 1"):
        etl.run(other, star)
    with pytest.raises(ValueError, match="no rules of version SIM-9"):
        etl.run(tables, star, version="SIM-9")
    assert star.current() is None


def test_refusals_name_ten_ids(spark):
    rows = spark.range(40).select((F.col("id") % 25).alias("clave"), F.lit("regla_a").alias("regla"))
    with pytest.raises(etl.LoadRefused, match="regla_a: 40 rows, ids 0, 1, 2, 3, 4, 5, 6, 7, 8, 9$"):
        etl._refuse(rows, "clave")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ñ"), (2, None)], "id long, t string").coalesce(1)
    write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text.startswith("﻿id,t\n".encode())
    write_json({"a": df}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/a")).count() == 2
    for _ in range(2):
        append_audit(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
