"""The relations that queries start from: one row per reading, session, pregnancy and fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.operators.ranking import latest_by
from telar.session import table

READING = ["id_lectura", "id_sesion", "id_dispositivo", "fecha_hora_captura", "codigo_semaforo", "semana_gestacion", "hr_valor", "spo2_valor", "mov_valor"]
SESSION = ["id_embarazo", "id_dispositivo", "tipo_sesion", "fecha_inicio", "fecha_fin", "estado_sesion"]
PREGNANCY = ["id_paciente", "id_clinica", "numero_gestas", "numero_partos", "estado_embarazo", "fecha_inicio", "fecha_probable_parto", "fecha_cierre", "duracion_est_semanas"]
PHYSICIAN = ["registrado_en", "id_version", "id_clinica", "nombre_completo", "especialidad", "email_med", "telefono_med"]
CLINIC = ["nombre_clinica", "provincia", "distrito"]
LEVEL = ["codigo_nivel", "etiqueta_visual", "prioridad", "version_referencia", "color_hex", "mensaje_app"]


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings, however often they were delivered, with their first synchronisation."""
    return table(spark, d, "lectura_resumen").groupBy(*READING).agg(F.min("fecha_hora_sincronizacion").alias("fecha_hora_sincronizacion"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """The last registration of each session."""
    return latest_by(table(spark, d, "sesion_monitoreo"), ["id_sesion"], ["registrada_en"], SESSION)


def pregnancies(spark: SparkSession, d: str) -> DataFrame:
    """The last load of each pregnancy."""
    return latest_by(table(spark, d, "dim_embarazo"), ["id_embarazo"], ["cargado_en"], PREGNANCY)


def physicians(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each physician."""
    return latest_by(table(spark, d, "dim_medico_version"), ["id_medico"], ["vigente_desde"], PHYSICIAN)


def clinics(spark: SparkSession, d: str, copy: bool = True) -> DataFrame:
    return latest_by(table(spark, d, "dim_clinica" if copy else "clinica"), ["id_clinica"], ["cargado_en" if copy else "actualizado_en"], CLINIC)


def facts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Loaded readings, or their id and the columns asked for; repeated rows once.

    Naming the columns keeps the others out of the scan and of the shuffle.
    """
    rows = table(spark, d, "fact_lectura_biometrica")
    return (rows.select("id_lectura", *columns) if columns else rows).distinct()


def levels(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(table(spark, d, "dim_semaforo"), ["id_semaforo"], [], LEVEL)


def _latest(name: str, table: str, key: str, order: list[str], values: list[str]) -> str:
    by = ", ".join(f"{c} desc nulls last" for c in (*order, *values))
    return f"{name} as (select {key}, {', '.join((*order, *values))} from {table} qualify row_number() over (partition by {key} order by {by}) = 1)"


#: The same relations as common table expressions.
CTE = {
    "lecturas": f"lecturas as (select {', '.join(READING)}, min(fecha_hora_sincronizacion) fecha_hora_sincronizacion from lectura_resumen group by all)",
    "sesiones": _latest("sesiones", "sesion_monitoreo", "id_sesion", ["registrada_en"], SESSION),
    "embarazos": _latest("embarazos", "dim_embarazo", "id_embarazo", ["cargado_en"], PREGNANCY),
    "medicos": _latest("medicos", "dim_medico_version", "id_medico", ["vigente_desde"], PHYSICIAN),
    "clinicas": _latest("clinicas", "dim_clinica", "id_clinica", ["cargado_en"], CLINIC),
    "hechos": "hechos as (select distinct * from fact_lectura_biometrica)",
    "niveles": _latest("niveles", "dim_semaforo", "id_semaforo", [], LEVEL),
}


def with_(*names: str) -> str:
    return "with " + ", ".join(CTE[n] for n in names) + " "
