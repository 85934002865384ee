"""Monitoring packages: JSON text with a session and its readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions import text
from telar.functions.levels import movement_shape, vitals_shape
from telar.schemas import PACKAGE


def parse(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns of df and ``paquete``, null where the text is no package; the text itself is kept as it came."""
    return df.withColumn("paquete", F.from_json(payload, PACKAGE, {"mode": "PERMISSIVE"}))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files, each {clave, payload, llegada}, as a stream."""
    return spark.readStream.schema("clave string, payload string, llegada long").json(path)


def readings_of(df: DataFrame, key: str) -> DataFrame:
    """One row per reading of a package, with its place; packages without readings give none."""
    return df.select(key, F.posexplode("paquete.lecturas").alias("indice", "x")).select(key, "indice", "x.*")



def canonical(p: str = "paquete") -> Column:
    """The package's canonical text: sorted keys, no spaces, instants in UTC, two decimals, defaults filled in, readings in order."""
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    instant = lambda c: F.when(F.try_to_timestamp(c).isNull(), "null").otherwise(F.concat(F.lit('"'), text.utc_instant(F.try_to_timestamp(c)), F.lit('"')))
    decimal = lambda c: F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), text.hundredths(c), F.lit('"')))

    def reading(x: Column) -> Column:
        return text.canonical_object(
            {
                "id_tiempo_gest": plain(x["id_tiempo_gest"]),
                "id_semaforo": plain(x["id_semaforo"]),
                "fecha_hora_captura": instant(x["fecha_hora_captura"]),
                "fecha_hora_sincronizacion": instant(x["fecha_hora_sincronizacion"]),
                "hr_valor": decimal(x["hr_valor"]),
                "spo2_valor": decimal(x["spo2_valor"]),
                "mov_valor": plain(x["mov_valor"]),
            }
        )

    c = lambda n: F.col(f"{p}.{n}")
    return text.canonical_object(
        {
            "id_embarazo": plain(c("id_embarazo")),
            "id_dispositivo": plain(c("id_dispositivo")),
            "tipo_sesion": quoted(c("tipo_sesion")),
            "fecha_inicio": instant(c("fecha_inicio")),
            "fecha_fin": instant(c("fecha_fin")),
            "estado_sesion": quoted(F.coalesce(c("estado_sesion"), F.lit("PENDIENTE"))),
            "origen_dato": quoted(F.coalesce(c("origen_dato"), F.lit("DISPOSITIVO"))),
            "lecturas": F.concat(F.lit("["), F.concat_ws(",", F.transform(c("lecturas"), reading)), F.lit("]")),
        }
    )


def faults(df: DataFrame, key: str, p: str = "paquete") -> DataFrame:
    """key, regla of packages that can't be taken: shape, order, type and times of their readings."""
    c = lambda n: F.col(f"{p}.{n}")
    at = lambda x: F.try_to_timestamp(x)
    start, end = at(c("fecha_inicio")), at(c("fecha_fin"))
    all_ = lambda f: F.forall(c("lecturas"), f)
    vit = lambda x: vitals_shape(x["hr_valor"], x["spo2_valor"], x["mov_valor"])
    mov = lambda x: movement_shape(x["hr_valor"], x["spo2_valor"], x["mov_valor"])
    rules = {
        "ilegible": F.col(p).isNotNull() & c("id_embarazo").isNotNull() & c("tipo_sesion").isNotNull() & start.isNotNull(),
        "sin_lecturas": F.size(c("lecturas")) > 0,
        "forma": all_(lambda x: vit(x) | mov(x)),
        "tipo": F.when(c("tipo_sesion") == "SIGNOS_MATERNOS", all_(vit)).when(c("tipo_sesion") == "MOVIMIENTOS_FETALES", all_(mov)).otherwise(False),
        "orden_de_lectura": all_(lambda x: F.coalesce(at(x["fecha_hora_sincronizacion"]) >= at(x["fecha_hora_captura"]), F.lit(True))),
        "fuera_de_sesion": all_(lambda x: F.coalesce((at(x["fecha_hora_captura"]) >= start) & F.coalesce(at(x["fecha_hora_captura"]) <= end, F.lit(True)), F.lit(False))),
        "fin_antes_de_inicio": F.coalesce(end >= start, F.lit(True)),
        "completa_sin_fin": (F.coalesce(c("estado_sesion"), F.lit("PENDIENTE")) != "COMPLETADA") | end.isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("regla"))
