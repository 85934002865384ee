"""A package from its arrival to the rows it becomes: keys, shape, references, claim, sessions and readings.

Nothing is raised: each package comes out with one ``resultado``, and what is wrong with it
as rows (recurso, clave, llegada, regla, indice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions import text, timeutil
from telar.operators.merging import claim_outcomes
from telar.operators.validation import package_reference_faults
from telar.session import checkpoint
from telar.sources import packages

Tables = dict[str, DataFrame]

NEW, REPLAY, COLLISION, INCOMPLETE, INVALID = "nueva", "repeticion", "colision", "incompleta", "invalida"


def _id(*parts: Column | str) -> Column:
    """An id of 63 bits that depends on the package alone, so that a task run again gives it again."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


def process(arrived: DataFrame, t: Tables, claims: DataFrame | None = None) -> Tables:
    """What becomes of arrived packages: ``respuestas``, ``faltas``, ``reclamos``, ``sesiones``, ``lecturas``.

    arrived: recurso, clave, payload string, llegada long (tells the packages of a key
    apart). t: embarazos, tiempo_gestacional, asignacion_dispositivo. claims: those held
    from before (recurso, clave, huella, id_sesion, llegada); one without id_sesion never
    came to an answer. Packages with faults leave no claim. Of several valid ones with one
    key the first is ``nueva`` and becomes rows; the same content again is a ``repeticion``
    with the first one's id_sesion, other content a ``colision``; a key whose claim is not
    complete is ``incompleta``, before its content is looked at. A null payload, key or
    resource is a fault. Empty input gives empty tables.

    Method: shape rules are expressions over the parsed package, references are joined, and
    claims are resolved by an aggregation per key (see ``claim_outcomes``).
    """
    own = packages.parse(arrived.select("recurso", "clave", "payload", "llegada")).withColumn("id_sesion", _id("recurso", "clave", "llegada"))
    own = checkpoint(own.withColumn("huella", text.fingerprint(packages.canonical())))
    keyed = own.withColumn("regla", F.when(~text.valid_key(F.col("clave")), F.lit("clave_invalida")).when(F.col("recurso").isNull(), F.lit("sin_recurso")))
    none = F.lit(None).cast("int").alias("indice")
    of_key = keyed.filter("regla is not null").select("id_sesion", "regla", none)
    of_shape = packages.faults(own, "id_sesion").select("id_sesion", "regla", none)
    readable = own.filter(F.col("paquete.id_embarazo").isNotNull() & (F.size("paquete.lecturas") > 0))
    at = lambda c: F.try_to_timestamp(F.col(f"paquete.{c}"))
    day = lambda c: timeutil.clinical_day(at(c))
    sessions = readable.select("id_sesion", F.col("paquete.id_embarazo").alias("id_embarazo"), F.col("paquete.id_dispositivo").alias("id_dispositivo"), day("fecha_inicio").alias("desde"), F.coalesce(day("fecha_fin"), day("fecha_inicio")).alias("hasta"))
    rows = packages.readings_of(readable, "id_sesion")
    readings = rows.select("id_sesion", "indice", "id_tiempo_gest", timeutil.own_day(F.col("fecha_hora_captura")).alias("dia"), "mov_valor")
    of_references = package_reference_faults(readings, sessions, t["embarazos"], t["tiempo_gestacional"], t["asignacion_dispositivo"])
    broken = checkpoint(of_key.unionByName(of_shape).unionByName(of_references))
    who = ["recurso", "clave", "llegada"]
    faults = own.select("id_sesion", *who).join(broken, "id_sesion").select(*who, "regla", "indice")
    valid = own.join(broken.select("id_sesion"), "id_sesion", "left_anti")
    # held claims come before all that arrive; an arrived one is answered once it is taken
    arriving = valid.select(*who, "huella", "id_sesion", F.lit(1).alias("_turno"), F.lit(True).alias("_contestada"))
    if claims is not None:
        held = claims.select("recurso", "clave", F.col("llegada").cast("long").alias("llegada"), "huella", F.col("id_sesion").cast("long").alias("id_sesion"), F.lit(0).alias("_turno"), F.col("id_sesion").isNotNull().alias("_contestada"))
        arriving = held.unionByName(arriving)
    settled = checkpoint(claim_outcomes(arriving, ["recurso", "clave"], "huella", ["_turno", "llegada", "id_sesion"], "_contestada"))
    answered = settled.filter("_turno = 1")
    first = settled.filter((F.col("resultado") == NEW) & F.col("_contestada")).select("recurso", "clave", F.col("id_sesion").alias("_primera"))
    session_of = F.when(F.col("resultado").isin(NEW, REPLAY), F.col("_primera")).alias("id_sesion")
    answers = answered.join(first, ["recurso", "clave"], "left").select(*who, "resultado", session_of)
    refused = own.join(broken.select("id_sesion").distinct(), "id_sesion", "left_semi").select(*who, F.lit(INVALID).alias("resultado"), F.lit(None).cast("long").alias("id_sesion"))
    new = answered.filter(F.col("resultado") == NEW).select("id_sesion")
    taken = valid.join(new, "id_sesion", "left_semi")
    p = lambda c: F.col(f"paquete.{c}").alias(c)
    default = lambda c, value: F.coalesce(F.col(f"paquete.{c}"), F.lit(value)).alias(c)
    return {
        "respuestas": answers.unionByName(refused),
        "faltas": faults,
        "reclamos": valid.join(new, "id_sesion", "left_semi").select("recurso", "clave", "huella", "id_sesion", "llegada"),
        "sesiones": taken.select("id_sesion", p("id_embarazo"), p("id_dispositivo"), p("tipo_sesion"), at("fecha_inicio").alias("fecha_inicio"), at("fecha_fin").alias("fecha_fin"), default("estado_sesion", "PENDIENTE"), default("origen_dato", "DISPOSITIVO")),
        "lecturas": rows.join(new, "id_sesion", "left_semi").select(
            _id("id_sesion", "indice").alias("id_lectura"), "id_sesion", "id_tiempo_gest", "id_semaforo", F.try_to_timestamp("fecha_hora_captura").alias("fecha_hora_captura"), F.try_to_timestamp("fecha_hora_sincronizacion").alias("fecha_hora_sincronizacion"), "hr_valor", "spo2_valor", "mov_valor"
        ),
    }
