"""Validation and reconciliation: violations as rows, discrepancies as counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators import reconcile, validation
from telar.plans import relations as R
from telar.queries.registry import Registry
from telar.session import checkpoint, table

query = Registry()


@query(R.with_("lecturas") + """select id_lectura, 'forma' regla from lecturas where not ((hr_valor is not null and spo2_valor is not null and mov_valor is null) or (hr_valor is null and spo2_valor is null and mov_valor is not null))
union all select id_lectura, 'hr_positivo' from lecturas where hr_valor <= 0 union all select id_lectura, 'spo2_en_rango' from lecturas where spo2_valor < 0 or spo2_valor > 100 union all select id_lectura, 'mov_no_negativo' from lecturas where mov_valor < 0
union all select id_lectura, 'orden_de_sincronizacion' from lecturas where fecha_hora_sincronizacion < fecha_hora_captura union all select id_lectura, 'movimiento_desde_semana_20' from lecturas where mov_valor is not null and semana_gestacion < 20""")
def shape_violations(spark, d):
    """Rules that readings break, all checked in one scan."""
    return validation.violations(R.readings(spark, d), "id_lectura", validation.READING_RULES)


@query("""select id_medico, id_clinica, count(*) n from medico_clinica where fecha_final < fecha_inicio group by 1, 2""")
def inverted_periods(spark, d):
    return table(spark, d, "medico_clinica").filter("fecha_final < fecha_inicio").groupBy("id_medico", "id_clinica").agg(F.count("*").alias("n"))


@query("select id_version, count(*) n from dim_medico_version group by 1 having count(*) > 1")
def pk_uniqueness(spark, d):
    return validation.repeated_keys(table(spark, d, "dim_medico_version"), ["id_version"])


_CONSTRAINTS = {
    "dim_embarazo": {"gestas": "numero_gestas >= 1", "partos": "numero_partos >= 0 and numero_partos < numero_gestas", "parto_tras_inicio": "fecha_probable_parto >= fecha_inicio", "cierre_tras_inicio": "fecha_cierre >= fecha_inicio", "estado": "estado_embarazo in ('ACTIVO', 'FINALIZADO', 'SUSPENDIDO')"},
    "sesion_monitoreo": {"fin_tras_inicio": "fecha_fin >= fecha_inicio", "tipo": "tipo_sesion in ('SIGNOS_MATERNOS', 'MOVIMIENTOS_FETALES')", "borrado_tras_registro": "eliminada_en >= registrada_en"},
    "medico_clinica": {"fin_tras_inicio": "fecha_final >= fecha_inicio", "inicio": "fecha_inicio is not null"},
    "lectura_resumen": {"spo2": "spo2_valor between 0 and 100", "hr": "hr_valor > 0", "mov": "mov_valor >= 0", "algo_medido": "hr_valor is not null or spo2_valor is not null or mov_valor is not null"},
}


@query(" union all ".join(f"select '{t}' tabla, '{rule}' regla, count(*) filter (({ok}) is not null) revisadas, count(*) filter (not ({ok})) incumplidas from {t}" for t, rules in _CONSTRAINTS.items() for rule, ok in rules.items()))
def row_constraints(spark, d):
    """For each constraint of a table how many rows it applies to and how many break it; a table is read once for all of its constraints."""
    parts = []
    for t, rules in _CONSTRAINTS.items():
        counts = table(spark, d, t).agg(*[x for rule, ok in rules.items() for x in (F.count(F.expr(ok)).alias(f"r_{rule}"), F.count_if(~F.expr(ok)).alias(f"i_{rule}"))])
        rows = [F.struct(F.lit(t).alias("tabla"), F.lit(rule).alias("regla"), F.col(f"r_{rule}").alias("revisadas"), F.col(f"i_{rule}").alias("incumplidas")) for rule in rules]
        parts.append(counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


@query("""select id_embarazo, 'gestas' regla from dim_embarazo where numero_gestas < 2 union all select id_embarazo, 'partos' from dim_embarazo where numero_partos < 0 or numero_partos >= numero_gestas""")
def pregnancy_violations(spark, d):
    """Rules of pregnancies as violations, with a bound for first pregnancies that the test tables break."""
    return validation.violations(table(spark, d, "dim_embarazo"), "id_embarazo", lambda: {"gestas": F.col("numero_gestas") >= 2, "partos": validation.PREGNANCY_RULES()["partos"]})


_PAQUETES = R.with_("sesiones", "lecturas") + """, p as (select s.id_sesion, s.tipo_sesion, s.fecha_inicio, s.fecha_fin, s.estado_sesion, count(l.id_lectura) n,
 count(*) filter (s.tipo_sesion = 'SIGNOS_MATERNOS' and l.mov_valor is not null or s.tipo_sesion = 'MOVIMIENTOS_FETALES' and (l.hr_valor is not null or l.spo2_valor is not null)) ajenas,
 count(*) filter (l.fecha_hora_captura < s.fecha_inicio or l.fecha_hora_captura > s.fecha_fin) fuera, count(*) filter (l.fecha_hora_sincronizacion < l.fecha_hora_captura) antes from sesiones s left join lecturas l using (id_sesion) group by all) """


@query(_PAQUETES + """select id_sesion, 'sin_lecturas' regla from p where n = 0 union all select id_sesion, 'tipo' from p where ajenas > 0 union all select id_sesion, 'fuera_de_sesion' from p where fuera > 0
union all select id_sesion, 'sincronizacion' from p where antes > 0 union all select id_sesion, 'fin_antes_de_inicio' from p where fecha_fin < fecha_inicio union all select id_sesion, 'completa_sin_fin' from p where estado_sesion = 'COMPLETADA' and fecha_fin is null""")
def package_validation(spark, d):
    """Sessions whose readings don't fit them; faults are counted per session before the rules are applied."""
    s, r = R.sessions(spark, d), R.readings(spark, d)
    return validation.package_violations(s, r)


@query(R.with_("hechos", "lecturas", "niveles", "embarazos", "clinicas") + ", " + R._latest("origen", "clinica", "id_clinica", ["actualizado_en"], R.CLINIC) + f"""
select 'lecturas_sin_hecho' control, true bloqueante, count(*) discrepancias from (select id_lectura from lecturas except select id_lectura from hechos)
union all select 'hechos_sin_lectura_origen', true, count(*) from (select id_lectura from hechos except select id_lectura from lecturas)
union all select 'sesiones_distintas', true, (select count(*) from (select id_sesion from lecturas except select id_sesion from hechos)) + (select count(*) from (select id_sesion from hechos except select id_sesion from lecturas))
union all select 'contenido_divergente', true, count(*) from hechos h join lecturas l using (id_lectura) where (h.id_sesion, h.hr_valor, h.spo2_valor, h.mov_valor, h.fecha_hora) is distinct from (l.id_sesion, l.hr_valor, l.spo2_valor, l.mov_valor, l.fecha_hora_captura)
union all select 'semaforo_distinto_del_origen', true, count(*) from hechos h join niveles n using (id_semaforo) join lecturas l on h.id_lectura = l.id_lectura where n.codigo_nivel <> l.codigo_semaforo
union all select 'semaforo_distinto_de_la_mayor_severidad', true, count(*) from hechos h join niveles n using (id_semaforo) where n.codigo_nivel <> case when 'ERROR' in (estado_hr, estado_spo2, estado_mov) then 'ERROR' when 'WARNING' in (estado_hr, estado_spo2, estado_mov) then 'WARNING' else 'OK' end
union all select 'forma_invalida', true, count(*) from hechos where not ((hr_valor is not null and spo2_valor is not null and mov_valor is null and estado_hr is not null and estado_spo2 is not null and estado_mov is null) or (hr_valor is null and spo2_valor is null and mov_valor is not null and estado_hr is null and estado_spo2 is null and estado_mov is not null))
union all select 'movimiento_antes_de_semana_20', true, count(*) from hechos where mov_valor is not null and id_tiempo_gestacional - 99 < 20
union all select 'fecha_fuera_del_embarazo', true, count(*) from hechos h join embarazos e using (id_embarazo) where cast(h.fecha_hora at time zone 'America/Panama' as date) < e.fecha_inicio or cast(h.fecha_hora at time zone 'America/Panama' as date) > e.fecha_cierre
union all select 'claves_duplicadas', true, count(*) - count(distinct id_lectura) from fact_lectura_biometrica
union all select 'huerfanos_del_hecho', true, count(*) from hechos where id_sesion not in (select id_sesion from sesion_monitoreo) or id_embarazo not in (select id_embarazo from embarazos) or id_clinica not in (select id_clinica from clinicas) or id_medico not in (select id_medico from dim_medico_version) or id_semaforo not in (select id_semaforo from niveles)
union all select 'huerfanos_de_dimensiones', true, count(*) from embarazos where id_clinica not in (select id_clinica from clinicas)
union all select 'afiliacion_no_aplicable', true, count(*) from (select h.id_lectura, h.id_clinica, count(a.id_medico) k, max(a.id_clinica) v from hechos h left join medico_clinica a on a.id_medico = h.id_medico and a.fecha_inicio <= cast(h.fecha_hora at time zone 'America/Panama' as date) and (a.fecha_final is null or a.fecha_final >= cast(h.fecha_hora at time zone 'America/Panama' as date)) group by 1, 2) where k <> 1 or v is distinct from id_clinica
union all select 'dim_clinica_distinta_del_origen', true, (select count(*) from (select {", ".join(["id_clinica", *R.CLINIC])} from origen except select {", ".join(["id_clinica", *R.CLINIC])} from clinicas)) + (select count(*) from (select {", ".join(["id_clinica", *R.CLINIC])} from clinicas except select {", ".join(["id_clinica", *R.CLINIC])} from origen))
union all select 'dim_semaforo_distinta_del_origen', true, (select count(*) from (select * from semaforo except select * from dim_semaforo)) + (select count(*) from (select * from dim_semaforo except select * from semaforo))
union all select 'catalogo_semaforo_incoherente', true, count(*) from niveles where (codigo_nivel, prioridad) not in (('OK', 1), ('WARNING', 2), ('ERROR', 3))
union all select 'dim_embarazo_duracion', true, count(*) from embarazos where datediff('day', fecha_inicio, fecha_probable_parto) <> 7 * duracion_est_semanas
union all select 'clasificacion_embarazo_pendiente', false, count(*) from dim_embarazo where clasificacion_embarazo is null
union all select 'semana_recalculada_distinta', false, count(*) from hechos h join embarazos e using (id_embarazo) where h.id_tiempo_gestacional - 99 <> trunc(datediff('day', e.fecha_inicio, cast(h.fecha_hora at time zone 'America/Panama' as date)) / 7.0) + 1
union all select 'sesiones_sin_lecturas', false, count(*) from (select distinct id_sesion from sesion_monitoreo) s where not exists (select 1 from lectura_resumen l where l.id_sesion = s.id_sesion)""")
def reconcile_report(spark, d):
    """Every check's discrepancies in one report."""
    return reconcile.report(
        readings=R.readings(spark, d).withColumnRenamed("fecha_hora_captura", "fecha_hora"),
        facts=checkpoint(R.facts(spark, d)),  # each pass would tell repeated rows apart anew
        raw_readings=table(spark, d, "lectura_resumen"),
        raw_facts=table(spark, d, "fact_lectura_biometrica"),
        sessions=table(spark, d, "sesion_monitoreo"),
        pregnancies=R.pregnancies(spark, d),
        raw_pregnancies=table(spark, d, "dim_embarazo"),
        physicians=table(spark, d, "dim_medico_version"),
        affiliations=table(spark, d, "medico_clinica"),
        clinics=R.clinics(spark, d),
        source_clinics=R.clinics(spark, d, copy=False),
        levels=R.levels(spark, d),
        raw_levels=table(spark, d, "dim_semaforo"),
        source_levels=table(spark, d, "semaforo"),
    )


QUERIES, SQL = query.QUERIES, query.SQL
