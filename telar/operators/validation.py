"""Record rules whose violations come out as rows (key, regla), never as task failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions.levels import movement_shape, vitals_shape
from telar.functions.text import REGISTRATION_EMAIL_FORM, canonical_email, valid_date
from telar.functions.timeutil import gestational_week
from telar.operators.coverage import covered_whole

_c = F.col


def reading_rules() -> dict[str, Column]:
    shape = vitals_shape(_c("hr_valor"), _c("spo2_valor"), _c("mov_valor")) | movement_shape(_c("hr_valor"), _c("spo2_valor"), _c("mov_valor"))
    return {
        "forma": shape,
        "hr_positivo": _c("hr_valor") > 0,
        "spo2_en_rango": _c("spo2_valor").between(0, 100),
        "mov_no_negativo": _c("mov_valor") >= 0,
        "orden_de_sincronizacion": _c("fecha_hora_sincronizacion") >= _c("fecha_hora_captura"),
        "movimiento_desde_semana_20": _c("mov_valor").isNull() | (_c("semana_gestacion") >= 20),
    }


def pregnancy_rules() -> dict[str, Column]:
    return {
        "gestas": _c("numero_gestas") >= 1,
        "partos": (_c("numero_partos") >= 0) & (_c("numero_partos") < _c("numero_gestas")),
        "parto_tras_inicio": _c("fecha_probable_parto") >= _c("fecha_inicio"),
        "cierre_tras_inicio": _c("fecha_cierre") >= _c("fecha_inicio"),
        "estado": _c("estado_embarazo").isin("ACTIVO", "FINALIZADO", "SUSPENDIDO"),
    }


READING_RULES, PREGNANCY_RULES = reading_rules, pregnancy_rules


def violations(df: DataFrame, key: str, rules) -> DataFrame:
    """One row per record and rule that it breaks; a rule that is null for a record (nothing to check) holds."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules().items()]))
    return df.select(key, F.explode(broken).alias("regla"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def package_violations(sessions: DataFrame, readings: DataFrame) -> DataFrame:
    """id_sesion, regla: sessions without readings, with readings of another type, outside of their time, or out of order.

    The session's bounds are joined to its readings by a shuffle on the session; a session's
    faults are then counted by an aggregation that combines before it shuffles.
    """
    own = sessions.select("id_sesion", "tipo_sesion", "fecha_inicio", "fecha_fin", "estado_sesion")
    r = readings.select("id_sesion", "id_lectura", "hr_valor", "spo2_valor", "mov_valor", "fecha_hora_captura", "fecha_hora_sincronizacion")
    vitals, movement = _c("tipo_sesion") == "SIGNOS_MATERNOS", _c("tipo_sesion") == "MOVIMIENTOS_FETALES"
    alien = (vitals & _c("mov_valor").isNotNull()) | (movement & (_c("hr_valor").isNotNull() | _c("spo2_valor").isNotNull()))
    outside = (_c("fecha_hora_captura") < _c("fecha_inicio")) | (_c("fecha_hora_captura") > _c("fecha_fin"))
    p = own.join(r, "id_sesion", "left").groupBy(*own.columns).agg(
        F.count("id_lectura").alias("n"),
        F.count_if(alien).alias("ajenas"),
        F.count_if(outside).alias("fuera"),
        F.count_if(_c("fecha_hora_sincronizacion") < _c("fecha_hora_captura")).alias("antes"),
    )
    rules = {
        "sin_lecturas": _c("n") > 0,
        "tipo": _c("ajenas") == 0,
        "fuera_de_sesion": _c("fuera") == 0,
        "sincronizacion": _c("antes") == 0,
        "fin_antes_de_inicio": _c("fecha_fin") >= _c("fecha_inicio"),
        "completa_sin_fin": (_c("estado_sesion") != "COMPLETADA") | _c("fecha_fin").isNotNull(),
    }
    return violations(p, "id_sesion", lambda: rules)


#: Characters of a registered text.
LONGEST = 100


def registration_faults(df: DataFrame, key: str, today: Column) -> DataFrame:
    """key, regla of registrations: required texts, a real day of birth that isn't in the future, a mail address of the registered form, acceptance.

    Columns: nombre, apellido, cedula, correo, fecha_nac (text), acepta, and of optional texts
    (segundo_nombre, apellido_materno, telefono) those there are. White space around texts
    doesn't count; blanks are missing. Texts have at most ``LONGEST`` characters.
    """
    there = lambda c: F.length(F.trim(F.coalesce(_c(c), F.lit("")))) > 0
    born = valid_date(F.trim(_c("fecha_nac")))
    rules = {
        **{f"falta_{c}": there(c) for c in ("nombre", "apellido", "cedula")},
        **{f"largo_{c}": F.length(F.trim(_c(c))) <= LONGEST for c in ("nombre", "apellido", "cedula", "segundo_nombre", "apellido_materno", "telefono") if c in df.columns},
        "correo": F.coalesce(canonical_email(_c("correo")).rlike(REGISTRATION_EMAIL_FORM), F.lit(False)),
        "fecha": born.isNotNull(),
        "fecha_futura": born <= today,
        "aceptacion": F.coalesce(_c("acepta"), F.lit(False)),
    }
    return violations(df, key, lambda: rules)


# Links to patients and physicians that an account of each role has.
LINKS = {"PACIENTE": (1, 0), "MEDICO": (0, 1), "ADMIN": (0, 0)}


def incoherent_accounts(accounts: DataFrame, patients: DataFrame, physicians: DataFrame) -> DataFrame:
    """Accounts (id_usuario, rol) whose numbers of links don't fit their role, or whose role is unknown."""
    n = lambda df, a: df.groupBy("id_usuario").agg(F.count("*").alias(a))
    both = accounts.join(n(patients, "pacientes"), "id_usuario", "left").join(n(physicians, "medicos"), "id_usuario", "left").fillna(0, ["pacientes", "medicos"])
    ok = F.lit(False)
    for role, (p, m) in LINKS.items():
        ok = ok | (F.coalesce(_c("rol") == role, F.lit(False)) & (_c("pacientes") == p) & (_c("medicos") == m))
    return both.filter(~ok).select("id_usuario", "rol", "pacientes", "medicos")


def package_reference_faults(readings: DataFrame, sessions: DataFrame, pregnancies: DataFrame, weeks: DataFrame, assignments: DataFrame) -> DataFrame:
    """id_sesion, regla, indice: a pregnancy that doesn't exist, a device not assigned throughout, a week that isn't the computed one, movement before week 20.

    readings: id_sesion, indice, id_tiempo_gest, dia (of the capture, in its own zone), mov_valor.
    sessions: id_sesion, id_embarazo, id_dispositivo, desde, hasta (days). weeks:
    id_tiempo_gest, semana_gestacion. assignments: id_dispositivo, id_embarazo,
    fecha_inicio, fecha_fin. Pairs of device and pregnancy are told apart by a hash of 64
    bits. indice is that of the first reading that breaks the rule, null for a rule of the session.
    """
    pair = lambda: F.xxhash64("id_dispositivo", "id_embarazo").alias("k")
    of_session = lambda df, name: df.select("id_sesion", F.lit(name).alias("regla"), F.lit(None).cast("int").alias("indice")).distinct()
    of_reading = lambda df, name: df.groupBy("id_sesion").agg(F.min("indice").alias("indice")).select("id_sesion", F.lit(name).alias("regla"), F.col("indice").cast("int").alias("indice"))
    absent = sessions.join(pregnancies.select("id_embarazo"), "id_embarazo", "left_anti")
    held = covered_whole(sessions.select(_c("id_sesion").alias("id"), pair(), "desde", "hasta"), assignments.select(pair(), _c("fecha_inicio").alias("desde"), _c("fecha_fin").alias("hasta")))
    dated = readings.join(weeks.select("id_tiempo_gest", "semana_gestacion"), "id_tiempo_gest").join(sessions.select("id_sesion", "id_embarazo"), "id_sesion").join(pregnancies.select("id_embarazo", "fecha_inicio"), "id_embarazo")
    computed = gestational_week(_c("dia"), _c("fecha_inicio"))
    return (
        of_session(absent, "embarazo_inexistente")
        .unionByName(of_session(held.filter("not cubierto").withColumnRenamed("id", "id_sesion"), "dispositivo_sin_asignacion"))
        .unionByName(of_reading(readings.join(weeks.select("id_tiempo_gest"), "id_tiempo_gest", "left_anti"), "semana_inexistente"))
        .unionByName(of_reading(dated.filter((_c("semana_gestacion") != computed) | ~computed.between(1, 42)), "semana_distinta"))
        .unionByName(of_reading(dated.filter(_c("mov_valor").isNotNull() & (_c("semana_gestacion") < 20)), "movimiento_antes_de_semana_20"))
    )
