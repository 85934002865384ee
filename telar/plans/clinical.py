"""What a person may read: episodes, their sessions and readings, and one monitoring answer.

tables: the data set's sections. Whoever asks is a role and the patient's or physician's id;
what is out of scope and what does not exist are both an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.operators.ranking import latest_by
from telar.plans.views import Tables, current_follow_up

METRICS = ["hr_valor", "spo2_valor", "mov_valor"]


@dataclass(frozen=True)
class Identity:
    role: str  # PACIENTE, MEDICO or ADMIN
    id: int


def scope(t: Tables, who: Identity, today: Column) -> DataFrame:
    """Pregnancies that one may see: a patient's own, those a physician follows that day, none for others."""
    e = t["embarazos"]
    if who.role == "PACIENTE":
        return e.filter(F.col("id_paciente") == who.id)
    if who.role == "MEDICO":
        return e.join(current_follow_up(t, today).filter(F.col("id_medico") == who.id).select("id_embarazo"), "id_embarazo", "left_semi")
    return e.limit(0)


def scoped_sessions(t: Tables, who: Identity, today: Column) -> DataFrame:
    return t["sesiones_monitoreo"].join(scope(t, who, today).select("id_embarazo"), "id_embarazo", "left_semi")


def scoped_readings(t: Tables, who: Identity, today: Column) -> DataFrame:
    """Readings of visible sessions with level and week; readings without either are left out on purpose."""
    s = scoped_sessions(t, who, today).select("id_sesion", "id_embarazo")
    levels, weeks = t["semaforos"].select("id_semaforo", "codigo_nivel", "prioridad"), t["tiempo_gestacional"].select("id_tiempo_gest", "semana_gestacion")
    return t["lecturas_biometricas"].join(s, "id_sesion").join(levels, "id_semaforo").join(weeks, "id_tiempo_gest")


def episodes(t: Tables, who: Identity, today: Column) -> DataFrame:
    """Newest first."""
    return scope(t, who, today).orderBy(F.desc("fecha_inicio"), F.desc("id_embarazo"))


def sessions(t: Tables, who: Identity, today: Column, pregnancy: int) -> DataFrame:
    """A pregnancy's sessions, newest first."""
    return scoped_sessions(t, who, today).filter(F.col("id_embarazo") == pregnancy).orderBy(F.desc("fecha_inicio"), F.desc("id_sesion"))


def readings(t: Tables, who: Identity, today: Column, session: int) -> DataFrame:
    """A session's readings, oldest first."""
    return scoped_readings(t, who, today).filter(F.col("id_sesion") == session).orderBy("fecha_hora_captura", "id_lectura")


def latest_values(rows: DataFrame) -> DataFrame:
    """id_embarazo, metrica, valor, fecha_hora_captura, id_lectura: the last value there is of each metric; zero is a value."""
    long = rows.select("id_embarazo", "id_lectura", "fecha_hora_captura", F.explode(F.array(*[F.struct(F.lit(m).alias("metrica"), F.col(m).cast("double").alias("valor")) for m in METRICS])).alias("x"))
    long = long.select("id_embarazo", "x.metrica", "fecha_hora_captura", "id_lectura", "x.valor").filter("valor is not null")
    return latest_by(long, ["id_embarazo", "metrica"], ["fecha_hora_captura", "id_lectura"], ["valor"])


def monitoring(t: Tables, who: Identity, today: Column, pregnancy: int) -> dict[str, DataFrame]:
    """``ultima`` (the latest reading of all sessions), ``valores`` (the last value of each metric), ``series`` (all points, in order)."""
    rows = scoped_readings(t, who, today).filter(F.col("id_embarazo") == pregnancy)
    last = latest_by(rows, ["id_embarazo"], ["fecha_hora_captura", "id_lectura"], ["id_sesion", "codigo_nivel", *METRICS])
    points = rows.select("id_lectura", "fecha_hora_captura", F.explode(F.array(*[F.struct(F.lit(m).alias("metrica"), F.col(m).cast("double").alias("valor")) for m in METRICS])).alias("x"))
    series = points.select("x.metrica", "fecha_hora_captura", "id_lectura", "x.valor").filter("valor is not null").orderBy("metrica", "fecha_hora_captura", "id_lectura")
    return {"ultima": last, "valores": latest_values(rows), "series": series}


def summary(t: Tables, who: Identity, today: Column, pregnancy: int, days: int | None = 30, most: int | None = 10) -> dict[str, DataFrame]:
    """The summary document: ``valores``, ``lecturas`` of the last days before the last reading (newest first, ``most`` of them or all), ``clasificacion`` of the last reading.

    days: counted back from the last reading, not from today; None for all.
    """
    rows = scoped_readings(t, who, today).filter(F.col("id_embarazo") == pregnancy)
    if days is not None:
        end = rows.agg(F.max("fecha_hora_captura").alias("_fin"))  # one row
        rows = rows.join(F.broadcast(end), F.col("fecha_hora_captura") >= F.col("_fin") - F.make_dt_interval(F.lit(days))).drop("_fin")
    newest = rows.orderBy(F.desc("fecha_hora_captura"), F.desc("id_lectura"))
    last = latest_by(rows, ["id_embarazo"], ["fecha_hora_captura", "id_lectura"], ["codigo_nivel"])
    return {"valores": latest_values(rows), "lecturas": newest if most is None else newest.limit(most), "clasificacion": last.select("id_lectura", "codigo_nivel")}
