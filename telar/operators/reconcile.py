"""Reconciliation of the loaded star with its source: one row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions.levels import movement_shape, severest, vitals_shape
from telar.functions.timeutil import clinical_day
from telar.operators.copies import symmetric_difference
from telar.operators.coverage import covering
from telar.session import together

_c = F.col
_CLINIC = ["id_clinica", "nombre_clinica", "provincia", "distrito"]

#: Checks that inform only; all others block a publication.
INFORMATIVE = ("clasificacion_embarazo_pendiente", "semana_recalculada_distinta", "sesiones_sin_lecturas")
#: What a fact copies from its reading, session and pregnancy.
COPIED = ["id_sesion", "id_tiempo_gestacional", "hr_valor", "spo2_valor", "mov_valor", "fecha_hora", "id_embarazo", "id_paciente", "id_clinica"]


def as_rows(counts: DataFrame) -> DataFrame:
    """control, bloqueante, discrepancias from one row with a count for each check."""
    pairs = [F.struct(F.lit(n).alias("control"), F.lit(n not in INFORMATIVE).alias("bloqueante"), F.coalesce(_c(n), F.lit(0)).cast("long").alias("discrepancias")) for n in counts.columns]
    return counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def _known(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.select(key).distinct().withColumn(flag, F.lit(True))


def _shape(x: str = "valor") -> tuple[Column, Column]:
    """That the values (or states) are those of vitals, and of movement."""
    hr, spo2, mov = (_c(n) for n in (("hr_valor", "spo2_valor", "mov_valor") if x == "valor" else ("estado_hr", "estado_spo2", "estado_mov")))
    return vitals_shape(hr, spo2, mov), movement_shape(hr, spo2, mov)


def _keys(readings: DataFrame, facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sets of ids on both sides: one aggregation tells for each id where it is."""
    part = lambda df, kind, key, bit: df.select(F.lit(kind).alias("clase"), _c(key).cast("long").alias("k"), F.lit(bit).alias("lado"))
    parts = [part(readings, 0, "id_lectura", 1), part(facts, 0, "id_lectura", 2), part(readings, 1, "id_sesion", 1), part(facts, 1, "id_sesion", 2), part(sessions, 1, "id_sesion", 4)]
    sides = reduce(DataFrame.unionByName, parts).groupBy("clase", "k").agg(F.bit_or("lado").alias("lado"))
    reading, both = _c("clase") == 0, _c("lado").bitwiseAND(3)
    return sides.agg(
        F.count_if(reading & (both == 1)).alias("lecturas_sin_hecho"),
        F.count_if(reading & (both == 2)).alias("hechos_sin_lectura_origen"),
        F.count_if(~reading & both.isin(1, 2)).alias("sesiones_distintas"),
        F.count_if(~reading & (_c("lado").bitwiseAND(5) == 4)).alias("sesiones_sin_lecturas"),
    )


def _of_facts(facts: DataFrame, dims: dict[str, DataFrame], pregnancies: DataFrame, levels: DataFrame, weeks: DataFrame | None, null_is_orphan: bool) -> DataFrame:
    """All that a fact and the dimensions it points to tell: each dimension is joined once, and one scan is aggregated."""
    (vital, moving), (vital_states, moving_states) = _shape(), _shape("estado")
    # what the fact alone tells is told before the joins, so that they move keys and flags only
    f = facts.select(
        *dims, "id_embarazo", "id_semaforo", "id_tiempo_gestacional", clinical_day("fecha_hora").alias("_dia"), ((vital & vital_states) | (moving & moving_states)).alias("_forma"),
        _c("mov_valor").isNotNull().alias("_mueve"), F.coalesce(severest(_c("estado_hr"), _c("estado_spo2"), _c("estado_mov")), F.lit("OK")).alias("_severo"),
    )
    for key, df in dims.items():
        f = f.join(_known(df, key, f"_con_{key}"), key, "left")
    f = f.join(pregnancies.select("id_embarazo", F.lit(True).alias("_con_id_embarazo"), _c("fecha_inicio").alias("_inicio"), _c("fecha_cierre").alias("_cierre")), "id_embarazo", "left")
    f = f.join(levels.select("id_semaforo", F.lit(True).alias("_con_id_semaforo"), _c("codigo_nivel").alias("_nivel")), "id_semaforo", "left")
    week = _c("id_tiempo_gestacional") - 99
    if weeks is not None:
        f = f.join(weeks.select("id_tiempo_gestacional", F.lit(True).alias("_con_id_tiempo_gestacional"), _c("semana_gestacion").alias("_semana")), "id_tiempo_gestacional", "left")
        week = _c("_semana")
    absent = [_c(f"_con_{k}").isNull() if null_is_orphan and k != "id_sesion" else _c(f"_con_{k}").isNull() & _c(k).isNotNull() for k in (*dims, "id_embarazo", "id_semaforo", *(["id_tiempo_gestacional"] if weeks is not None else []))]
    days = F.datediff("_dia", "_inicio")
    weeks_begun = F.signum(days.cast("double")) * F.floor(F.abs(days) / 7) + 1  # towards zero, as integer division
    return f.agg(
        F.count_if(_c("_nivel") != _c("_severo")).alias("semaforo_distinto_de_la_mayor_severidad"),
        F.count_if(~_c("_forma")).alias("forma_invalida"),
        F.count_if(_c("_mueve") & (week < 20)).alias("movimiento_antes_de_semana_20"),
        F.count_if((_c("_dia") < _c("_inicio")) | F.coalesce(_c("_dia") > _c("_cierre"), F.lit(False))).alias("fecha_fuera_del_embarazo"),
        F.count_if(reduce(Column.__or__, absent)).alias("huerfanos_del_hecho"),
        F.count_if(week != weeks_begun).alias("semana_recalculada_distinta"),
    )


def _against_source(facts: DataFrame, readings: DataFrame, levels: DataFrame) -> DataFrame:
    copied = [c for c in COPIED if c in readings.columns]
    own = facts.join(levels.select("id_semaforo", "codigo_nivel"), "id_semaforo", "left").select("id_lectura", "codigo_nivel", F.struct(*copied).alias("_h"))
    both = own.join(readings.select("id_lectura", "codigo_semaforo", F.struct(*copied).alias("_l")), "id_lectura")
    equal = reduce(Column.__and__, [_c(f"_h.{c}").eqNullSafe(_c(f"_l.{c}")) for c in copied])
    return both.agg(F.count_if(~equal).alias("contenido_divergente"), F.count_if(_c("codigo_nivel") != _c("codigo_semaforo")).alias("semaforo_distinto_del_origen"))


def _affiliations(facts: DataFrame, affiliations: DataFrame) -> DataFrame:
    held = covering(
        facts.select(_c("id_lectura").alias("id"), _c("id_medico").alias("k"), clinical_day("fecha_hora").alias("dia")),
        affiliations.select(_c("id_medico").alias("k"), _c("fecha_inicio").alias("desde"), _c("fecha_final").alias("hasta"), _c("id_clinica").alias("valor")),
    ).join(facts.select(_c("id_lectura").alias("id"), "id_clinica"), "id")
    return held.agg(F.count_if((_c("cubren") != 1) | ~_c("valor").eqNullSafe(_c("id_clinica"))).alias("afiliacion_no_aplicable"))


def report(*, readings: DataFrame, facts: DataFrame, raw_facts: DataFrame, sessions: DataFrame, pregnancies: DataFrame, raw_pregnancies: DataFrame, physicians: DataFrame, affiliations: DataFrame, clinics: DataFrame, source_clinics: DataFrame, levels: DataFrame, raw_levels: DataFrame, source_levels: DataFrame, raw_readings: DataFrame | None = None, star: dict[str, DataFrame] | None = None) -> DataFrame:
    """control, bloqueante, discrepancias. A load may be published if every blocking check has none.

    All checks are one plan of few passes: the ids of both sides in one aggregation, the
    facts with their dimensions in one, the facts with their readings in one. Comparisons
    are set differences in which nulls are equal, and periods are swept (see ``covering``)
    instead of joined by ranges. pregnancies and levels have one row per key. readings have
    those of the columns ``COPIED`` that can be compared. raw_readings, raw_facts: with
    repeated rows, where only ids are asked for and nothing need be told apart.

    star: dim_paciente, dim_tiempo_gestacional, dim_factor_riesgo and puente_embarazo_factor of
    a written star. With them orphans are looked for in all of it: facts in all six
    dimensions, where a null key is an orphan, physicians and patients without their clinic
    (null is none), pregnancies without patient, and bridge rows without pregnancy or factor.
    """
    dims = {"id_sesion": sessions, "id_clinica": clinics, "id_medico": physicians}
    parents = [(pregnancies, "id_clinica", clinics, False)]
    repeated = [raw_facts.agg((F.count("*") - F.countDistinct("id_lectura")).alias("n"))]
    if star is not None:
        dims["id_paciente"] = star["dim_paciente"]
        linked = star["puente_embarazo_factor"]
        parents = [(physicians, "id_clinica", clinics, False), (star["dim_paciente"], "id_clinica", clinics, False), (pregnancies, "id_paciente", star["dim_paciente"], True)]
        repeated.append(linked.agg((F.count("*") - F.countDistinct(F.struct("id_embarazo", "id_factor_riesgo"))).alias("n")))
    loose = [(df if null_too else df.filter(_c(key).isNotNull())).join(other.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n")) for df, key, other, null_too in parents]
    if star is not None:
        both = linked.join(_known(pregnancies, "id_embarazo", "_e"), "id_embarazo", "left").join(_known(star["dim_factor_riesgo"], "id_factor_riesgo", "_r"), "id_factor_riesgo", "left")
        loose.append(both.agg(F.count_if(_c("_e").isNull() | _c("_r").isNull()).alias("n")))
    total = lambda parts, name: reduce(DataFrame.unionByName, parts).agg(F.sum("n").alias(name))
    weeks = None if star is None else star["dim_tiempo_gestacional"]
    counts = together(
        facts.sparkSession,
        lambda: _affiliations(facts, affiliations),
        lambda: _keys(readings if raw_readings is None else raw_readings, raw_facts, sessions),
        lambda: _against_source(facts, readings, levels),
        lambda: _of_facts(facts, dims, pregnancies, levels, weeks, star is not None),
        lambda: total(repeated, "claves_duplicadas"),
        lambda: total(loose, "huerfanos_de_dimensiones"),
        lambda: symmetric_difference(source_clinics.select(*_CLINIC), clinics.select(*_CLINIC)).withColumnRenamed("discrepancias", "dim_clinica_distinta_del_origen"),
        lambda: symmetric_difference(source_levels, raw_levels.select(*source_levels.columns)).withColumnRenamed("discrepancias", "dim_semaforo_distinta_del_origen"),
        lambda: levels.agg(F.count_if(~F.expr("(codigo_nivel, cast(prioridad as int)) IN (('OK', 1), ('WARNING', 2), ('ERROR', 3))")).alias("catalogo_semaforo_incoherente")),
        lambda: pregnancies.agg(F.count_if(F.datediff("fecha_probable_parto", "fecha_inicio") != 7 * _c("duracion_est_semanas")).alias("dim_embarazo_duracion")),
        lambda: raw_pregnancies.agg(F.count_if(_c("clasificacion_embarazo").isNull()).alias("clasificacion_embarazo_pendiente")),
    )
    return reduce(DataFrame.unionByName, [as_rows(x) for x in counts])
