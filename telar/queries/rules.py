"""Record rules, scopes and follow-up over the test tables and their stand-ins (see ``published``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions import delivery, text, timeutil
from telar.operators import validation
from telar.operators.copies import symmetric_difference
from telar.operators.coverage import covering
from telar.operators.ranking import single_or_null
from telar.plans import clinical
from telar.plans import relations as R
from telar.queries.published import _CTE, _DAY, TODAY, stand_ins
from telar.queries.registry import Registry
from telar.session import table, together
from telar.sources import packages

query = Registry()


@query(_CTE + """select id_embarazo, id_medico, strftime(desde, '%Y-%m-%d') desde from seguimiento where id_medico % 4 > 0 and id_embarazo in (select id_embarazo from embarazos where estado_embarazo = 'FINALIZADO')""")
def principal_follow_up(spark, d):
    """Principal follow-ups of a set of pregnancies, by a semi-join and not a list of ids."""
    star, source = stand_ins(spark, d)
    principal = source["seguimiento_clinico"].filter(F.col("id_medico") % 4 > 0)
    return principal.join(star["dim_embarazo"].filter("estado_embarazo = 'FINALIZADO'").select("id_embarazo"), "id_embarazo", "left_semi").select("id_embarazo", "id_medico", F.col("fecha_asignacion").cast("string").alias("desde"))


@query(_CTE + f""", c as (select h.id_lectura, h.id_medico, count(s.id_medico) n, count(*) filter (s.id_medico = h.id_medico) propios from hechos h left join seguimiento s on s.id_embarazo = h.id_embarazo and s.id_medico % 4 > 0 and s.desde <= {_DAY.replace("fecha_hora", "h.fecha_hora")} and (s.hasta is null or s.hasta >= {_DAY.replace("fecha_hora", "h.fecha_hora")}) group by 1, 2)
select count(*) filter (n <> 1) medico_no_resoluble, count(*) filter (propios = 0) medico_distinto_del_responsable from c""")
def follow_up_checks(spark, d):
    """Facts without exactly one principal follow-up on their day, and those not followed by their own physician."""
    star, source = stand_ins(spark, d)
    c = F.col
    facts = star["hechos"].select("id_lectura", "id_embarazo", "id_medico", timeutil.clinical_day("fecha_hora").alias("dia"))
    follow = source["seguimiento_clinico"].filter(c("id_medico") % 4 > 0).select("id_embarazo", "id_medico", c("fecha_asignacion").alias("desde"), c("fecha_fin").alias("hasta"), F.lit(None).cast("long").alias("valor"))
    pair = F.xxhash64("id_embarazo", "id_medico")
    on = lambda k: covering(facts.select(c("id_lectura").alias("id"), k.alias("k"), "dia"), follow.withColumn("k", k))
    any_, own = together(spark, lambda: on(c("id_embarazo")), lambda: on(pair))
    counts = [any_.agg(F.count_if(c("cubren") != 1).alias("a"), F.lit(0).alias("b")), own.agg(F.lit(0).alias("a"), F.count_if(c("cubren") == 0).alias("b"))]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("a").alias("medico_no_resoluble"), F.sum("b").alias("medico_distinto_del_responsable"))


_FOLLOWED = f"select distinct id_embarazo from seguimiento where id_medico % 10 = 5 and activo and desde <= date '{TODAY}' and (hasta is null or hasta >= date '{TODAY}')"


@query(_CTE + f"""select 'PACIENTE' rol, id_embarazo from embarazos where id_paciente % 50 = 7
union all select 'MEDICO', id_embarazo from embarazos where id_embarazo in ({_FOLLOWED})""")
def scoped_episodes(spark, d):
    """What patients and physicians see through ``clinical.scope``: several identities at once, and an administrator, who sees nothing."""
    star, source = stand_ins(spark, d)
    today = F.lit(TODAY).cast("date")
    # the scope of one identity, for the identities that share a remainder
    t = {"embarazos": star["dim_embarazo"].withColumn("id_paciente", F.col("id_paciente") % 50), "seguimiento_clinico": source["seguimiento_clinico"].withColumn("id_medico", F.col("id_medico") % 10)}
    seen = lambda role, id_: clinical.scope(t, clinical.Identity(role, id_), today).select(F.lit(role).alias("rol"), "id_embarazo")
    return seen("PACIENTE", 7).unionByName(seen("MEDICO", 5)).unionByName(seen("ADMIN", 1))


_PHONES = "select id_medico, case when id_version % 3 = 0 then 'TELEFONO_DOMICILIO' else 'CELULAR' end tipo, telefono_med valor, id_version % 2 = 0 principal from dim_medico_version"


@query(f"""with t as ({_PHONES}) select id_medico, count(distinct valor) filter (principal and tipo = 'CELULAR') telefonos, case when count(distinct valor) filter (principal and tipo = 'CELULAR') = 1 then max(valor) filter (principal and tipo = 'CELULAR') end telefono from t group by 1""")
def principal_phone(spark, d):
    """The principal mobile number of a physician: none for none or several."""
    v = table(spark, d, "dim_medico_version")
    mobile = (F.col("id_version") % 2 == 0) & (F.col("id_version") % 3 != 0)
    return v.groupBy("id_medico").agg(F.countDistinct(F.when(mobile, F.col("telefono_med"))).alias("telefonos"), single_or_null(F.col("telefono_med"), mobile).alias("telefono"))


@query("""select event_id, regexp_replace('fallo de ' || event_type || ' en postgresql://u' || user_id || ':clave@host:5432/db tras ' || event_id, '[A-Za-z][A-Za-z0-9+.-]*://[^\\s''"]+', '<url>', 'g') mensaje, cast(4 * (event_id % 20) + 30 as double) arriendo_s from events""")
def redacted_messages(spark, d):
    """Messages without URLs, and how long attempts with various time-outs may stay open."""
    e = table(spark, d, "events")
    raw = F.concat(F.lit("fallo de "), "event_type", F.lit(" en postgresql://u"), F.col("user_id").cast("string"), F.lit(":clave@host:5432/db tras "), F.col("event_id").cast("string"))
    return e.select("event_id", text.redact_urls(raw).alias("mensaje"), delivery.lease_seconds(F.col("event_id") % 20).cast("double").alias("arriendo_s"))


_REGISTERED = """select event_id id, case when event_id % 5 = 0 then '  ' else 'N' || user_id end nombre, case when event_id % 7 = 0 then null else 'A' end apellido, '8-' || event_id cedula, ' Paciente' || case when event_id % 11 = 0 then '1' else cast(10 + event_id % 90 as varchar) end || '@Example.com ' correo,
 case when event_id % 13 = 0 then '1990-02-30' when event_id % 17 = 0 then '2999-01-01' else '1990-02-2' || event_id % 9 end fecha_nac, case when event_id % 3 = 0 then null else event_id % 19 > 0 end acepta from events"""


@query(f"""with r as ({_REGISTERED}) select id, 'falta_nombre' regla from r where trim(coalesce(nombre, '')) = '' union all select id, 'falta_apellido' from r where trim(coalesce(apellido, '')) = ''
union all select id, 'correo' from r where not regexp_full_match(lower(trim(correo)), 'paciente[0-9]{{2,}}@example\\.com') union all select id, 'fecha' from r where try_cast(fecha_nac as date) is null
union all select id, 'fecha_futura' from r where try_cast(fecha_nac as date) > date '2025-01-01' union all select id, 'aceptacion' from r where not coalesce(acepta, false)""")
def registration_rules(spark, d):
    """Rules that registrations break."""
    e, i = table(spark, d, "events"), F.col("event_id")
    s = lambda x: x.cast("string")
    own = e.select(
        i.alias("id"), F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit("N"), s(F.col("user_id")))).alias("nombre"), F.when(i % 7 != 0, "A").alias("apellido"), F.concat(F.lit("8-"), s(i)).alias("cedula"),
        F.concat(F.lit(" Paciente"), F.when(i % 11 == 0, "1").otherwise(s(10 + i % 90)), F.lit("@Example.com ")).alias("correo"),
        F.when(i % 13 == 0, "1990-02-30").when(i % 17 == 0, "2999-01-01").otherwise(F.concat(F.lit("1990-02-2"), s(i % 9))).alias("fecha_nac"), F.when(i % 3 != 0, i % 19 > 0).alias("acepta"),
    )
    return validation.registration_faults(own, "id", F.lit("2025-01-01").cast("date"))


@query("""with u as (select distinct user_id id_usuario, case user_id % 5 when 0 then 'ADMIN' when 1 then 'MEDICO' when 4 then null else 'PACIENTE' end rol from events), p as (select distinct user_id id_usuario from events where user_id % 5 in (2, 3) and user_id % 7 > 0),
m as (select distinct user_id id_usuario from events where user_id % 5 = 1 or user_id % 11 = 0), n as (select u.*, case when p.id_usuario is null then 0 else 1 end pacientes, case when m.id_usuario is null then 0 else 1 end medicos from u left join p using (id_usuario) left join m using (id_usuario))
select id_usuario, rol, cast(pacientes as bigint) pacientes, cast(medicos as bigint) medicos from n where not coalesce((rol = 'PACIENTE' and pacientes = 1 and medicos = 0) or (rol = 'MEDICO' and pacientes = 0 and medicos = 1) or (rol = 'ADMIN' and pacientes = 0 and medicos = 0), false)""")
def account_coherence(spark, d):
    """Accounts whose links don't fit their role."""
    u = table(spark, d, "events").select(F.col("user_id").alias("id_usuario")).distinct()
    i = F.col("id_usuario")
    role = F.when(i % 5 == 0, "ADMIN").when(i % 5 == 1, "MEDICO").when(i % 5 != 4, "PACIENTE")
    return validation.incoherent_accounts(u.withColumn("rol", role), u.filter((i % 5).isin(2, 3) & (i % 7 > 0)), u.filter((i % 5 == 1) | (i % 11 == 0)))


_WEEK = "cast(floor(datediff('day', e.fecha_inicio, cast(l.fecha_hora_captura at time zone 'America/Panama' as date)) / 7.0) as integer) + 1"


@query(R.with_("lecturas", "sesiones", "embarazos") + f""", s as (select *, cast(fecha_inicio at time zone 'America/Panama' as date) a, coalesce(cast(fecha_fin at time zone 'America/Panama' as date), cast(fecha_inicio at time zone 'America/Panama' as date)) b from sesiones),
asignacion as (select id_dispositivo, id_embarazo, min(a) desde, case when id_embarazo % 3 > 0 then max(a) end hasta from s where id_embarazo % 4 > 0 group by 1, 2),
l as (select *, 99 + semana_gestacion id_tiempo from lecturas where id_sesion in (select id_sesion from s)),
c as (select l.*, e.fecha_inicio, {_WEEK} calculada from l join s using (id_sesion) join embarazos e on e.id_embarazo = s.id_embarazo where semana_gestacion between 1 and 42)
select id_sesion, 'embarazo_inexistente' regla, cast(null as bigint) indice from s where id_embarazo is null or id_embarazo not in (select id_embarazo from embarazos)
union all select id_sesion, 'dispositivo_sin_asignacion', null from s where not exists (select 1 from asignacion x where x.id_dispositivo = s.id_dispositivo and x.id_embarazo = s.id_embarazo and x.desde <= s.a and (x.hasta is null or x.hasta >= s.b))
union all select id_sesion, 'semana_inexistente', min(id_lectura) from l where semana_gestacion is null or semana_gestacion not between 1 and 42 group by 1
union all select id_sesion, 'semana_distinta', min(id_lectura) from c where semana_gestacion <> calculada or calculada not between 1 and 42 group by 1
union all select id_sesion, 'movimiento_antes_de_semana_20', min(id_lectura) from c where mov_valor is not null and semana_gestacion < 20 group by 1""")
def package_references(spark, d):
    """Sessions whose pregnancy, device or weeks don't fit, with the first reading that breaks the rule."""
    c, day = F.col, timeutil.clinical_day
    s = R.sessions(spark, d).select("id_sesion", "id_embarazo", "id_dispositivo", day("fecha_inicio").alias("desde"), F.coalesce(day("fecha_fin"), day("fecha_inicio")).alias("hasta"))
    assigned = s.filter(c("id_embarazo") % 4 > 0).groupBy("id_dispositivo", "id_embarazo").agg(F.min("desde").alias("fecha_inicio"), F.max("desde").alias("_b")).select("id_dispositivo", "id_embarazo", "fecha_inicio", F.when(c("id_embarazo") % 3 > 0, c("_b")).alias("fecha_fin"))
    weeks = spark.range(1, 43).select((c("id") + 99).cast("int").alias("id_tiempo_gest"), c("id").cast("int").alias("semana_gestacion"))
    # the reading's id stands for its place in a package
    readings = R.readings(spark, d).select("id_sesion", c("id_lectura").cast("int").alias("indice"), (c("semana_gestacion") + 99).alias("id_tiempo_gest"), day("fecha_hora_captura").alias("dia"), "mov_valor").join(s.select("id_sesion"), "id_sesion", "left_semi")
    return validation.package_reference_faults(readings, s, R.pregnancies(spark, d), weeks, assigned).select("id_sesion", "regla", c("indice").cast("long").alias("indice"))


@query(R.with_("lecturas", "sesiones") + """, p as (select s.id_sesion, s.tipo_sesion, s.fecha_inicio, s.fecha_fin, s.estado_sesion, s.id_embarazo, l.id_lectura, l.hr_valor hr, l.spo2_valor sp, case when l.mov_valor between -32768 and 32767 then l.mov_valor end mv, l.fecha_hora_captura t, l.fecha_hora_sincronizacion z from sesiones s join lecturas l using (id_sesion)),
v as (select id_sesion, id_lectura, id_embarazo is not null and tipo_sesion is not null and fecha_inicio is not null legible, hr is not null and sp is not null and mv is null vital, hr is null and sp is null and mv is not null movil, * exclude (id_sesion, id_lectura) from p)
select id_lectura, 'ilegible' regla from v where not legible union all select id_lectura, 'forma' from v where not (vital or movil) union all select id_lectura, 'tipo' from v where not coalesce(case tipo_sesion when 'SIGNOS_MATERNOS' then vital when 'MOVIMIENTOS_FETALES' then movil else false end, false)
union all select id_lectura, 'orden_de_lectura' from v where z < t union all select id_lectura, 'fuera_de_sesion' from v where not coalesce(t >= fecha_inicio and coalesce(t <= fecha_fin, true), false)
union all select id_lectura, 'fin_antes_de_inicio' from v where fecha_fin < fecha_inicio union all select id_lectura, 'completa_sin_fin' from v where coalesce(estado_sesion, 'PENDIENTE') = 'COMPLETADA' and fecha_fin is null""")
def package_faults(spark, d):
    """Rules that packages break, each of one session and one reading, written as JSON and read again."""
    c = F.col
    iso = lambda name: F.date_format(c(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(name)
    s = R.sessions(spark, d).select("id_sesion", "id_embarazo", "id_dispositivo", "tipo_sesion", iso("fecha_inicio"), iso("fecha_fin"), "estado_sesion")
    r = R.readings(spark, d).select("id_sesion", "id_lectura", F.array(F.struct(iso("fecha_hora_captura"), iso("fecha_hora_sincronizacion"), "hr_valor", "spo2_valor", c("mov_valor").try_cast("short").alias("mov_valor"))).alias("lecturas"))
    payload = F.to_json(F.struct("id_embarazo", "id_dispositivo", "tipo_sesion", "fecha_inicio", "fecha_fin", "estado_sesion", "lecturas"))
    return packages.faults(packages.parse(s.join(r, "id_sesion").select("id_lectura", payload.alias("payload"))), "id_lectura")


_STARS = {
    "dim_tiempo_gestacional": ("semanas", ["id_tiempo_gestacional", "semana_gestacion", "mes_gestacion", "trimestre"], "id_tiempo_gestacional"),
    "dim_factor_riesgo": ("factores", ["id_factor_riesgo", "clave_factor", "nombre_factor", "activo"], "id_factor_riesgo"),
    "dim_paciente": ("pacientes", ["id_paciente", "id_clinica", "nombre_completo", "cedula", "telefono_pac"], "id_paciente"),
    "dim_embarazo": ("embarazos", ["id_embarazo", "id_paciente", "id_clinica", "estado_embarazo", "duracion_est_semanas"], "id_embarazo"),
    "puente_embarazo_factor": ("puente", ["id_embarazo", "id_factor_riesgo", "activo"], "id_embarazo"),
}


def _changed_sql(name: str) -> str:
    rel, cols, key = _STARS[name]
    a = f"select {', '.join(cols)} from {rel}"
    b = f"select {', '.join(f'case when {key} % 9 = 1 then null else {c} end {c}' if c == cols[-1] else c for c in cols)} from {rel} where {key} % 13 > 0"
    return f"select '{name}' dimension, (select count(*) from (({a}) except ({b}))) + (select count(*) from (({b}) except ({a}))) discrepancias"


@query(_CTE + " union all ".join(_changed_sql(n) for n in _STARS))
def dimension_checks(spark, d):
    """Each dimension against a source that lacks some rows and has other values in some."""
    star, _ = stand_ins(spark, d)
    rows = []
    for name, (_, cols, key) in _STARS.items():
        a = star[name].select(*cols)
        b = a.filter(F.col(key) % 13 > 0).withColumn(cols[-1], F.when(F.col(key) % 9 != 1, F.col(cols[-1])))
        rows.append(symmetric_difference(a, b).select(F.lit(name).alias("dimension"), "discrepancias"))
    return reduce(DataFrame.unionByName, rows)


QUERIES, SQL = query.QUERIES, query.SQL
