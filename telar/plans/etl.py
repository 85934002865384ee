"""The incremental load: dimensions, new facts, violations, preview, publication.

``tables`` are the sections of the dataset document (``telar.schemas.SECTIONS``).
Nothing is raised inside a plan: what breaks a rule comes out as rows (id_lectura, regla),
and a run with such rows is refused as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions import levels, text, timeutil
from telar.operators.copies import symmetric_difference
from telar.operators.coverage import covering
from telar.operators.merging import append_anomalies, mint_pseudonyms, type1_merge
from telar.operators.ranking import single_or_null, top_n
from telar.operators.reconcile import as_rows, report
from telar.session import checkpoint
from telar.sources.dataset import declared_totals_differ
from telar.sources.sinks import Published, Write

Tables = dict[str, DataFrame]

#: Key columns of each dimension.
DIMENSIONS = {"dim_clinica": ["id_clinica"], "dim_semaforo": ["id_semaforo"], "dim_tiempo_gestacional": ["id_tiempo_gestacional"], "dim_factor_riesgo": ["id_factor_riesgo"], "dim_medico": ["id_medico"], "dim_paciente": ["id_paciente"], "dim_embarazo": ["id_embarazo"], "puente_embarazo_factor": ["id_embarazo", "id_factor_riesgo"]}


#: Ids that a refusal names for each rule.
IDS_NAMED = 10


class LoadRefused(ValueError):
    """The rules that were broken and the first ids of each; never a measured or personal value."""


def _principal_phone(t: DataFrame, key: str) -> DataFrame:
    mobile = F.col("principal") & (F.col("tipo_contacto") == "CELULAR")
    return t.groupBy(key).agg(single_or_null(F.col("valor_contacto"), mobile).alias("telefono"), F.countDistinct(F.when(mobile, F.col("valor_contacto"))).alias("_telefonos"))


def _name() -> Column:
    return text.full_name(*[F.col(c) for c in ("primer_nombre", "segundo_nombre", "apellido_paterno", "apellido_materno")])


def dimensions(t: Tables) -> Tables:
    clinic_of = lambda df, key: df.groupBy(key).agg(single_or_null(F.col("id_clinica")).alias("id_clinica"))
    physician = t["medicos"].join(t["especialidades"], "id_especialidad").join(_principal_phone(t["telefonos_medico"], "id_medico"), "id_medico", "left").join(clinic_of(t["medico_clinica"], "id_medico"), "id_medico", "left")
    patient = t["pacientes"].join(_principal_phone(t["telefonos_paciente"], "id_paciente"), "id_paciente", "left").join(clinic_of(t["embarazos"], "id_paciente"), "id_paciente", "left")
    return {
        "dim_clinica": t["clinicas"],
        "dim_semaforo": t["semaforos"],
        "dim_tiempo_gestacional": t["tiempo_gestacional"].withColumnRenamed("id_tiempo_gest", "id_tiempo_gestacional"),
        "dim_factor_riesgo": t["factores_riesgo"],
        "dim_medico": physician.select("id_medico", "id_clinica", _name().alias("nombre_completo"), F.col("nombre_especialidad").alias("especialidad"), "email_med", F.col("telefono").alias("telefono_med")),
        "dim_paciente": patient.select("id_paciente", "id_clinica", _name().alias("nombre_completo"), "cedula", "email_pac", F.col("telefono").alias("telefono_pac"), "fecha_nac"),
        "dim_embarazo": t["embarazos"].select("*", timeutil.exact_weeks(F.col("fecha_probable_parto"), F.col("fecha_inicio")).alias("duracion_est_semanas"), F.lit(None).cast("string").alias("clasificacion_embarazo")),
        "puente_embarazo_factor": t["embarazo_factor_riesgo"].select("id_embarazo", "id_factor_riesgo", "fecha_diagnostico", "fecha_fin", "activo"),
    }


def dimension_faults(t: Tables) -> DataFrame:
    """regla, clave: names without parts, several principal phones or clinics, durations of no whole weeks."""
    many = lambda df, key, rule: df.filter("_telefonos > 1").select(F.lit(rule).alias("regla"), F.col(key).alias("clave"))
    d = dimensions(t)
    parts = [
        many(_principal_phone(t["telefonos_medico"], "id_medico"), "id_medico", "telefono_ambiguo_medico"),
        many(_principal_phone(t["telefonos_paciente"], "id_paciente"), "id_paciente", "telefono_ambiguo_paciente"),
        t["embarazos"].groupBy("id_paciente").agg(F.countDistinct("id_clinica").alias("n")).filter("n > 1").select(F.lit("clinica_ambigua_paciente").alias("regla"), F.col("id_paciente").alias("clave")),
        d["dim_medico"].filter("nombre_completo is null").select(F.lit("medico_sin_nombre").alias("regla"), F.col("id_medico").alias("clave")),
        d["dim_paciente"].filter("nombre_completo is null").select(F.lit("paciente_sin_nombre").alias("regla"), F.col("id_paciente").alias("clave")),
        d["dim_embarazo"].filter("duracion_est_semanas is null").select(F.lit("duracion_no_exacta").alias("regla"), F.col("id_embarazo").alias("clave")),
    ]
    return reduce(DataFrame.unionByName, parts)


def new_readings(t: Tables, facts: DataFrame | None, r: levels.Rules = levels.Rules()) -> DataFrame:
    """Readings that the facts lack, classified by the rules, with the day, the physician and the clinic they fall to.

    ``reglas`` lists what keeps a reading from being loaded.
    """
    own = t["lecturas_biometricas"] if facts is None else t["lecturas_biometricas"].join(facts.select("id_lectura"), "id_lectura", "left_anti")
    ctx = (
        own.join(t["sesiones_monitoreo"].select("id_sesion", "id_embarazo").join(t["embarazos"].select("id_embarazo", "id_paciente", "id_clinica"), "id_embarazo"), "id_sesion")
        .join(t["tiempo_gestacional"].select("id_tiempo_gest", "semana_gestacion", "trimestre"), "id_tiempo_gest")
        .join(t["semaforos"].select("id_semaforo", "codigo_nivel"), "id_semaforo")
        .withColumn("fecha_clinica", timeutil.clinical_day("fecha_hora_captura"))
        .withColumn("estado_hr", levels.hr_level(F.col("hr_valor"), r))
        .withColumn("estado_spo2", levels.spo2_level(F.col("spo2_valor"), r))
        .withColumn("estado_mov", levels.mov_level(F.col("mov_valor"), F.col("semana_gestacion"), F.col("trimestre"), r))
    )
    ctx = checkpoint(ctx.withColumn("semaforo_derivado", levels.severest(F.col("estado_hr"), F.col("estado_spo2"), F.col("estado_mov"))))
    follow = t["seguimiento_clinico"].filter("rol_seguimiento = 'PRINCIPAL'").join(ctx.select("id_embarazo"), "id_embarazo", "left_semi")
    who = covering(ctx.select(F.col("id_lectura").alias("id"), F.col("id_embarazo").alias("k"), F.col("fecha_clinica").alias("dia")), follow.select(F.col("id_embarazo").alias("k"), F.col("fecha_asignacion").alias("desde"), F.col("fecha_fin").alias("hasta"), F.col("id_medico").alias("valor")))
    ctx = checkpoint(ctx.join(who.select(F.col("id").alias("id_lectura"), F.col("cubren").alias("_medicos"), F.col("valor").alias("id_medico")), "id_lectura"))
    where = covering(ctx.select(F.col("id_lectura").alias("id"), F.col("id_medico").alias("k"), F.col("fecha_clinica").alias("dia")), t["medico_clinica"].select(F.col("id_medico").alias("k"), F.col("fecha_inicio").alias("desde"), F.col("fecha_final").alias("hasta"), F.col("id_clinica").alias("valor")))
    ctx = ctx.join(where.select(F.col("id").alias("id_lectura"), F.col("cubren").alias("_clinicas"), F.col("valor").alias("_clinica")), "id_lectura")
    shape = levels.vitals_shape(F.col("hr_valor"), F.col("spo2_valor"), F.col("mov_valor")) | levels.movement_shape(F.col("hr_valor"), F.col("spo2_valor"), F.col("mov_valor"))
    rules = {
        "forma_invalida": ~shape,
        "regla_no_definida": shape & F.col("semaforo_derivado").isNull(),
        "semaforo_distinto": F.col("semaforo_derivado") != F.col("codigo_nivel"),
        "medico_ausente": F.col("_medicos") == 0,
        "medico_ambiguo": F.col("_medicos") > 1,
        "afiliacion_ausente": (F.col("_medicos") == 1) & (F.col("_clinicas") == 0),
        "afiliacion_ambigua": F.col("_clinicas") > 1,
        "afiliacion_ajena": (F.col("_clinicas") == 1) & (F.col("_clinica") != F.col("id_clinica")),
    }
    return ctx.withColumn("reglas", F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))).withColumn("id_medico", F.col("id_medico").cast("int"))


def facts_of(new: DataFrame) -> DataFrame:
    return new.filter(F.size("reglas") == 0).select(
        F.col("id_lectura").cast("long").alias("id_lectura"), "id_sesion", "id_paciente", "id_medico", "id_clinica", F.col("id_tiempo_gest").alias("id_tiempo_gestacional"), "id_embarazo", "id_semaforo",
        "hr_valor", "spo2_valor", F.col("mov_valor").cast("int").alias("mov_valor"), "estado_hr", "estado_spo2", "estado_mov", F.col("fecha_hora_captura").alias("fecha_hora"),
    )


def violations(new: DataFrame) -> DataFrame:
    return new.select("id_lectura", F.explode("reglas").alias("regla"))


def preview(new: DataFrame, held_pregnancies: DataFrame | None) -> DataFrame:
    """A candidate per new reading, without measured values; nothing is written."""
    held = new.select("id_embarazo").limit(0) if held_pregnancies is None else held_pregnancies.select("id_embarazo").distinct()
    return new.join(held.withColumn("_hay", F.lit(True)), "id_embarazo", "left").select("id_lectura", "id_sesion", "id_embarazo", "id_clinica", "id_medico", "semana_gestacion", "trimestre", F.col("fecha_clinica").cast("string").alias("fecha_clinica"), "estado_hr", "estado_spo2", "estado_mov", "semaforo_derivado", F.col("codigo_nivel").alias("semaforo_origen"), F.coalesce("_hay", F.lit(False)).alias("embarazo_en_dimension"), "reglas")


def reconcile(t: Tables, written: Tables) -> DataFrame:
    """control, bloqueante, discrepancias of the written star against its source; nothing is changed.

    Rows of dimensions that the source no longer has count as discrepancies: they are kept
    by the merge and reported here.
    """
    c = F.col
    facts = written["hechos"]
    context = t["sesiones_monitoreo"].select("id_sesion", "id_embarazo").join(t["embarazos"].select("id_embarazo", "id_paciente", "id_clinica"), "id_embarazo", "left")
    readings = t["lecturas_biometricas"].join(t["semaforos"].select("id_semaforo", c("codigo_nivel").alias("codigo_semaforo")), "id_semaforo", "left").join(context, "id_sesion", "left")
    readings = readings.withColumnsRenamed({"id_tiempo_gest": "id_tiempo_gestacional", "fecha_hora_captura": "fecha_hora"}).withColumns({"id_lectura": c("id_lectura").cast("long"), "mov_valor": c("mov_valor").cast("int")})
    clinic = ["id_clinica", "nombre_clinica", "provincia", "distrito"]
    common = report(
        readings=readings, facts=facts, raw_facts=facts, sessions=t["sesiones_monitoreo"], pregnancies=written["dim_embarazo"], raw_pregnancies=written["dim_embarazo"], physicians=written["dim_medico"], affiliations=t["medico_clinica"],
        clinics=written["dim_clinica"].select(*clinic), source_clinics=t["clinicas"].select(*clinic), levels=written["dim_semaforo"], raw_levels=written["dim_semaforo"], source_levels=t["semaforos"],
        star=written,
    )
    source = dimensions(t)
    other = ["dim_tiempo_gestacional", "dim_factor_riesgo", "dim_medico", "dim_paciente", "dim_embarazo", "puente_embarazo_factor"]
    dims = [symmetric_difference(source[n], written[n].select(*source[n].columns)).withColumnRenamed("discrepancias", f"{n}_distinta_del_origen") for n in other]
    day = timeutil.clinical_day("fecha_hora")
    follow = t["seguimiento_clinico"].filter("rol_seguimiento = 'PRINCIPAL'").select("id_embarazo", "id_medico", c("fecha_asignacion").alias("desde"), c("fecha_fin").alias("hasta"), F.lit(None).cast("long").alias("valor"))
    pair = F.xxhash64("id_embarazo", "id_medico")
    any_ = covering(facts.select(c("id_lectura").alias("id"), c("id_embarazo").alias("k"), day.alias("dia")), follow.withColumn("k", c("id_embarazo")))
    own = covering(facts.select(c("id_lectura").alias("id"), pair.alias("k"), day.alias("dia")), follow.withColumn("k", pair))
    who = [any_.agg(F.count_if(c("cubren") != 1).alias("medico_no_resoluble")), own.agg(F.count_if(c("cubren") == 0).alias("medico_distinto_del_responsable"))]
    return reduce(DataFrame.unionByName, [as_rows(x) for x in (*who, *dims)], common)


def _refuse(rows: DataFrame, key: str) -> None:
    """Raises with the rules broken, their numbers of rows and their ten least ids, which is all that reaches the driver."""
    counts = rows.groupBy("regla").agg(F.count("*").alias("n"))
    ids = top_n(rows.select("regla", F.col(key).alias("k")).distinct(), ["regla"], [F.col("k")], IDS_NAMED).groupBy("regla").agg(F.sort_array(F.collect_list("k")).alias("ids"))
    found = counts.join(ids, "regla", "left").orderBy("regla").collect()
    if found:
        raise LoadRefused("; ".join(f"{r.regla}: {r.n} rows, ids {', '.join(map(str, r.ids or []))}" for r in found))


def _refuse_catalogue(levels_: DataFrame, version: str) -> None:
    """The catalogue has one row per level, so a few more than that show any fault."""
    held = levels_.select("codigo_nivel", F.col("prioridad").cast("int").alias("p"), "version_referencia").orderBy("codigo_nivel").limit(10 * len(levels.RANKS)).collect()
    if faults := levels.catalogue_faults([tuple(r) for r in held], levels.rules(version)):
        raise LoadRefused("catalogo_semaforo: " + "; ".join(faults))


def run(t: Tables, star: Published, version: str = "SIM-1.0", declared: dict[str, int] | None = None, stale_after_s: float | None = None) -> dict[str, int]:
    """Loads all new readings and the dimensions, or nothing; returns counters.

    The lock is held from before anything is read: of two runs at a time the second is
    refused at once (``LockBusy``), and takes over only a lock not renewed for
    ``stale_after_s``. Facts and pseudonyms are appended; dimensions, which are small
    beside them, are written whole. version is that of the thresholds, which the catalogue
    must have. declared: rows that sections of the source must have, so that one read in
    part is refused.
    """
    with star.writing(stale_after_s) as write:
        return _load(t, write, version, declared or {})


def _load(t: Tables, write: Write, version: str, declared: dict[str, int]) -> dict[str, int]:
    _refuse_catalogue(t["semaforos"], version)
    if differ := declared_totals_differ(t, declared):
        raise LoadRefused("; ".join(f"{s}: {have} rows of {want} declared" for s, (want, have) in sorted(differ.items())))
    _refuse(dimension_faults(t), "clave")
    counters: dict[str, int] = {}
    replaced: Tables = {}
    for name, new in dimensions(t).items():
        key, held = DIMENSIONS[name], write.read(name)
        merged = checkpoint(type1_merge(new.limit(0) if held is None else held, new, key, [c for c in new.columns if c not in key]))
        for r in merged.groupBy("accion").count().collect():
            counters[f"{name}.{r.accion}"] = r["count"]
        replaced[name] = merged.drop("accion")
        write.renew()
    facts = write.read("hechos")
    seen = checkpoint(new_readings(t, facts, levels.rules(version)))
    _refuse(violations(seen), "id_lectura")
    new = facts_of(seen)
    _refuse(append_anomalies(new.limit(0) if facts is None else facts, new, "id_lectura").withColumnRenamed("motivo", "regla"), "id_lectura")
    selected, counters["hechos.nuevos"] = seen.count(), new.count()
    if counters["hechos.nuevos"] != selected:
        raise LoadRefused(f"{selected} readings selected, {counters['hechos.nuevos']} to be loaded")
    appended = {"hechos": new}
    for name, dim, key in (("seudonimos", "dim_embarazo", "id_embarazo"), ("seudonimos_paciente", "dim_paciente", "id_paciente")):
        held = write.read(name)
        held = replaced[dim].select(key).limit(0) if held is None else held
        appended[name] = checkpoint(mint_pseudonyms(held, replaced[dim], key))  # uuid() must not be evaluated twice
        counters[f"{name}.nuevos"] = appended[name].count()

    def check(written: Tables) -> list[str]:
        """The blocking checks that found something in what was written."""
        found = reconcile(t, written).filter("bloqueante and discrepancias > 0").orderBy("control").collect()
        return [f"{r.control}: {r.discrepancias}" for r in found]

    write.publish(replaced, appended, check)
    return counters
