"""The published views over a star, and who may see what.

star: the dimensions, ``hechos`` and the two maps of pseudonyms as ``telar.plans.etl`` writes
them. source: seguimiento_clinico, usuario_medico, usuarios and roles of the data set. today:
the clinical day of the publication. No view shows an operational id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions import timeutil
from telar.operators.ranking import numbered

Tables = dict[str, DataFrame]

#: Cells with fewer pregnancies than this are not published.
LEAST_CELL = 5


def current_follow_up(source: Tables, today: Column) -> DataFrame:
    """Follow-ups in force on a day, of whatever role; a clinic in common grants nothing."""
    s = source["seguimiento_clinico"]
    return s.filter(F.col("activo") & timeutil.day_at_least(today, F.col("fecha_asignacion"), F.col("fecha_fin")))


def _episode(star: Tables) -> DataFrame:
    return star["seudonimos"].select("id_embarazo", F.col("seudonimo").alias("seudonimo_embarazo"))


def _patient(star: Tables) -> DataFrame:
    return star["seudonimos_paciente"].select("id_paciente", F.col("seudonimo").alias("seudonimo_paciente"))


def v_entitlement_medico(star: Tables, source: Tables, today: Column) -> DataFrame:
    """upn_medico, seudonimo_embarazo: active physicians' accounts and the pregnancies they follow that day, each pair once."""
    accounts = source["usuario_medico"].join(source["usuarios"].filter("activo").select("id_usuario", "id_rol", "email"), "id_usuario").join(source["roles"].filter("nombre_rol = 'MEDICO'").select("id_rol"), "id_rol")
    follow = current_follow_up(source, today).select("id_medico", "id_embarazo").distinct()
    return follow.join(accounts.select("id_medico", F.lower("email").alias("upn_medico")), "id_medico").join(_episode(star), "id_embarazo").select("upn_medico", "seudonimo_embarazo").distinct()


def v_entitlement_paciente_medico(star: Tables, source: Tables, today: Column) -> DataFrame:
    of_patient = _episode(star).join(star["dim_embarazo"].select("id_embarazo", "id_paciente"), "id_embarazo").join(_patient(star), "id_paciente")
    return v_entitlement_medico(star, source, today).join(of_patient, "seudonimo_embarazo").select("upn_medico", "seudonimo_paciente").distinct()


def _contract(star: Tables) -> DataFrame:
    """The twelve columns of v_embarazo but for the province, with what the views add to them."""
    month = lambda c: F.trunc(c, "MM")
    own = star["dim_embarazo"].withColumnRenamed("id_clinica", "_clinica_embarazo").join(_episode(star), "id_embarazo")
    own = own.join(star["dim_paciente"].select("id_paciente", "fecha_nac", F.col("id_clinica").alias("_clinica_paciente")), "id_paciente").join(_patient(star), "id_paciente")
    return own.select(
        "seudonimo_embarazo", "seudonimo_paciente", "estado_embarazo", "clasificacion_embarazo", "duracion_est_semanas", "numero_gestas", "numero_partos",
        month("fecha_inicio").alias("mes_inicio"), month("fecha_probable_parto").alias("mes_probable_parto"), F.col("fecha_cierre").isNotNull().alias("cerrado"),
        timeutil.age_band(F.col("fecha_inicio"), F.col("fecha_nac")).alias("edad_tramo_inicio"), "fecha_inicio", "fecha_probable_parto", "fecha_cierre", "_clinica_embarazo", "_clinica_paciente",
    )


CONTRACT = ["seudonimo_embarazo", "seudonimo_paciente", "estado_embarazo", "clasificacion_embarazo", "duracion_est_semanas", "numero_gestas", "numero_partos", "mes_inicio", "mes_probable_parto", "cerrado", "edad_tramo_inicio", "provincia"]


def v_embarazo(star: Tables) -> DataFrame:
    """Pregnancies with months instead of days, a band instead of an age, and the province of the patient's clinic."""
    clinic = star["dim_clinica"].select(F.col("id_clinica").alias("_clinica_paciente"), "provincia")
    return _contract(star).join(clinic, "_clinica_paciente", "left").select(*CONTRACT)


def v_embarazo_medico(star: Tables, source: Tables, today: Column) -> DataFrame:
    """The pregnancies that someone is entitled to, with exact dates and the clinic of the pregnancy; one row each."""
    clinic = star["dim_clinica"].select(F.col("id_clinica").alias("_clinica_embarazo"), "nombre_clinica", "provincia", "distrito")
    allowed = v_entitlement_medico(star, source, today).select("seudonimo_embarazo")
    return _contract(star).join(allowed, "seudonimo_embarazo", "left_semi").join(clinic, "_clinica_embarazo").select(*CONTRACT[:-1], "fecha_inicio", "fecha_probable_parto", "fecha_cierre", "nombre_clinica", "provincia", "distrito")


def v_paciente_medico(star: Tables, source: Tables, today: Column) -> DataFrame:
    """The patients that someone is entitled to, by name; one row each."""
    allowed = v_entitlement_paciente_medico(star, source, today).select("seudonimo_paciente")
    shown = F.concat("nombre_completo", F.lit(" — "), "cedula").alias("paciente_display")
    return star["dim_paciente"].join(_patient(star), "id_paciente").join(allowed, "seudonimo_paciente", "left_semi").select("seudonimo_paciente", shown, "nombre_completo", "cedula", "telefono_pac", "email_pac", "fecha_nac")


def v_embarazo_factor_riesgo(star: Tables, source: Tables, today: Column) -> DataFrame:
    allowed = v_entitlement_medico(star, source, today).select("seudonimo_embarazo")
    linked = star["puente_embarazo_factor"].join(_episode(star), "id_embarazo").join(star["dim_factor_riesgo"].select("id_factor_riesgo", "clave_factor"), "id_factor_riesgo")
    return linked.join(allowed, "seudonimo_embarazo", "left_semi").select("seudonimo_embarazo", "clave_factor", "fecha_diagnostico", "activo")


def v_lectura(star: Tables) -> DataFrame:
    """Readings with levels, clinical day and the number of their session in the pregnancy, by first instant.

    What depends on pregnancy and patient is joined to the sessions, of which there are
    fewer, and then by session to the readings: so a pregnancy with a third of all readings
    does not come together in the join.
    """
    f = star["hechos"].filter("id_sesion is not null")
    first = f.groupBy("id_embarazo", "id_sesion").agg(F.min("fecha_hora").alias("_en"))
    order = numbered(first, ["id_embarazo"], "_en", ["id_sesion"], "secuencia_sesion").join(_episode(star), "id_embarazo").select("id_embarazo", "id_sesion", "secuencia_sesion", "seudonimo_embarazo")
    patients = f.select("id_sesion", "id_paciente").distinct().join(_patient(star), "id_paciente")
    catalogues = f.join(star["dim_tiempo_gestacional"].select("id_tiempo_gestacional", "semana_gestacion", "trimestre"), "id_tiempo_gestacional").join(
        star["dim_semaforo"].select("id_semaforo", F.col("codigo_nivel").alias("codigo_semaforo"), F.col("prioridad").alias("prioridad_semaforo")), "id_semaforo"
    ).join(star["dim_clinica"].select("id_clinica", "provincia"), "id_clinica", "left")
    return catalogues.join(order, ["id_embarazo", "id_sesion"]).join(patients, ["id_sesion", "id_paciente"]).select(
        "seudonimo_embarazo", "seudonimo_paciente", "semana_gestacion", "trimestre", "codigo_semaforo", "prioridad_semaforo", "hr_valor", "spo2_valor", "mov_valor",
        "estado_hr", "estado_spo2", "estado_mov", timeutil.clinical_day("fecha_hora").alias("fecha_captura"), "secuencia_sesion", "provincia",
    )


def mean_to_tenths(value: str) -> Column:
    """The mean of two-decimal values rounded to one decimal, halves away from zero, in whole numbers; null of none."""
    s, n = F.sum((F.col(value) * 100).cast("long")), F.count(value)
    return F.when(n > 0, F.signum(s.cast("double")) * F.floor((2 * F.abs(s) + 10 * n) / (20 * n)) / 10)


def v_resumen_administrativo(star: Tables, least: int = LEAST_CELL) -> DataFrame:
    """Province, month and level with at least so many pregnancies."""
    h = star["hechos"].join(star["dim_semaforo"].select("id_semaforo", F.col("codigo_nivel").alias("codigo_semaforo")), "id_semaforo").join(star["dim_clinica"].select("id_clinica", "provincia"), "id_clinica", "left")
    cells = h.groupBy("provincia", timeutil.clinical_month("fecha_hora").alias("mes"), "codigo_semaforo").agg(
        F.count("*").alias("lecturas"), F.countDistinct("id_embarazo").alias("embarazos"), mean_to_tenths("hr_valor").alias("hr_promedio"), mean_to_tenths("spo2_valor").alias("spo2_promedio")
    )
    return cells.filter(F.col("embarazos") >= least)


def v_tiempo_gestacional(star: Tables) -> DataFrame:
    return star["dim_tiempo_gestacional"].select("semana_gestacion", "mes_gestacion", "trimestre")


def v_semaforo(star: Tables) -> DataFrame:
    return star["dim_semaforo"].select("codigo_nivel", "etiqueta_visual", "color_hex", "prioridad", "mensaje_app", "version_referencia")


def v_factor_riesgo(star: Tables) -> DataFrame:
    return star["dim_factor_riesgo"].select("clave_factor", "nombre_factor", "activo")


def published(star: Tables, source: Tables, today: Column) -> Tables:
    """All eleven views by name."""
    of_star = (v_embarazo, v_lectura, v_resumen_administrativo, v_tiempo_gestacional, v_semaforo, v_factor_riesgo)
    entitled = (v_entitlement_medico, v_entitlement_paciente_medico, v_paciente_medico, v_embarazo_medico, v_embarazo_factor_riesgo)
    return {v.__name__: v(star) for v in of_star} | {v.__name__: v(star, source, today) for v in entitled}
