"""Published views (see ``telar.plans.views``) and clinical reads over the test tables.

The test tables lack patients, follow-ups, accounts, weeks and risk factors. They are made
up here from ids by rules, in the same way in Spark and in SQL; the views themselves are
those of any star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions import timeutil
from telar.operators.ranking import single_or_null, top_n
from telar.plans import relations as R
from telar.plans import views
from telar.queries.registry import Registry
from telar.session import table

query = Registry()

#: The day of the publication.
TODAY = "2024-06-30"

_DAY = "cast(fecha_hora at time zone 'America/Panama' as date)"
_CTE = R.with_("embarazos", "hechos", "clinicas", "niveles") + f""", mapa as (select id_embarazo, min(seudonimo) seudonimo_embarazo from seudonimo_embarazo group by 1),
pacientes as (select id_paciente, case when min(id_clinica) = max(id_clinica) then max(id_clinica) end id_clinica, 'Paciente ' || id_paciente nombre_completo, '8-' || id_paciente cedula, case when id_paciente % 4 > 0 then '6000-' || id_paciente end telefono_pac,
  'p' || id_paciente || '@x.invalid' email_pac, date '1980-01-01' + cast(id_paciente * 37 % 9000 as integer) fecha_nac from embarazos where id_paciente is not null group by id_paciente),
mapa_p as (select id_paciente, md5('paciente-' || id_paciente) seudonimo_paciente from pacientes where id_paciente % 17 > 0),
seguimiento as (select id_embarazo, id_medico, min({_DAY}) desde, case when id_medico % 3 = 0 then max({_DAY}) end hasta, (id_embarazo + id_medico) % 5 > 0 activo from hechos where id_embarazo is not null and id_medico is not null group by id_embarazo, id_medico),
cuentas as (select distinct id_medico, lower('M' || id_medico || '@X.invalid') upn_medico from seguimiento where id_medico % 7 > 0 and id_medico % 11 > 0),
semanas as (select 99 + s id_tiempo_gestacional, s semana_gestacion, least(9, (s - 1) // 4 + 1) mes_gestacion, case when s <= 13 then 1 when s <= 27 then 2 else 3 end trimestre from (select cast(unnest(range(1, 43)) as integer) s)),
factores as (select * from (values (1, 'HTA', 'Hipertension', true), (2, 'DMG', 'Diabetes', true), (3, 'OBS', 'Obesidad', false)) f(id_factor_riesgo, clave_factor, nombre_factor, activo)),
puente as (select id_embarazo, id_factor_riesgo, fecha_inicio + 30 fecha_diagnostico, id_embarazo % 2 = 0 activo from embarazos, factores where (id_embarazo + id_factor_riesgo) % 3 = 0),
permiso as (select distinct c.upn_medico, m.seudonimo_embarazo from seguimiento s join cuentas c using (id_medico) join mapa m on s.id_embarazo = m.id_embarazo where s.activo and s.desde <= date '{TODAY}' and (s.hasta is null or s.hasta >= date '{TODAY}')),
permiso_p as (select distinct p.upn_medico, q.seudonimo_paciente from permiso p join mapa m using (seudonimo_embarazo) join embarazos e on e.id_embarazo = m.id_embarazo join mapa_p q on q.id_paciente = e.id_paciente),
contrato as (select m.seudonimo_embarazo, q.seudonimo_paciente, e.estado_embarazo, cast(null as varchar) clasificacion_embarazo, e.duracion_est_semanas, e.numero_gestas, e.numero_partos, strftime(e.fecha_inicio, '%Y-%m-01') mes_inicio, strftime(e.fecha_probable_parto, '%Y-%m-01') mes_probable_parto,
  e.fecha_cierre is not null cerrado, cast(5 * floor((year(e.fecha_inicio) - year(p.fecha_nac) - case when strftime(e.fecha_inicio, '%m%d') < strftime(p.fecha_nac, '%m%d') then 1 else 0 end) / 5.0) as integer) edad_tramo_inicio,
  strftime(e.fecha_inicio, '%Y-%m-%d') fecha_inicio, strftime(e.fecha_probable_parto, '%Y-%m-%d') fecha_probable_parto, strftime(e.fecha_cierre, '%Y-%m-%d') fecha_cierre, e.id_clinica c_e, p.id_clinica c_p
  from embarazos e join mapa m on m.id_embarazo = e.id_embarazo join pacientes p on p.id_paciente = e.id_paciente join mapa_p q on q.id_paciente = e.id_paciente) """
_CONTRACT = ", ".join(views.CONTRACT[:-1])


def stand_ins(spark, d) -> tuple[views.Tables, views.Tables]:
    """A star and its source over the test tables."""
    e, f = R.pregnancies(spark, d), R.facts(spark, d)
    id_ = F.col("id_paciente")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    patients = e.filter("id_paciente is not null").groupBy("id_paciente").agg(single_or_null(F.col("id_clinica")).alias("id_clinica")).select(
        "id_paciente", "id_clinica", text("Paciente ", id_).alias("nombre_completo"), text("8-", id_).alias("cedula"), F.when(id_ % 4 > 0, text("6000-", id_)).alias("telefono_pac"),
        text("p", id_, "@x.invalid").alias("email_pac"), F.date_add(F.lit("1980-01-01").cast("date"), (id_ * 37 % 9000).cast("int")).alias("fecha_nac"),
    )
    day, physician = timeutil.clinical_day("fecha_hora"), F.col("id_medico")
    follow = f.filter("id_embarazo is not null and id_medico is not null").groupBy("id_embarazo", "id_medico").agg(F.min(day).alias("fecha_asignacion"), F.max(day).alias("_fin")).select(
        "id_embarazo", "id_medico", "fecha_asignacion", F.when(physician % 3 == 0, F.col("_fin")).alias("fecha_fin"), ((F.col("id_embarazo") + physician) % 5 > 0).alias("activo")
    )
    physicians = follow.select("id_medico").distinct()
    weeks = spark.range(1, 43).select((F.col("id") + 99).cast("int").alias("id_tiempo_gestacional"), F.col("id").cast("int").alias("semana_gestacion")).withColumns({"mes_gestacion": timeutil.gestational_month(F.col("semana_gestacion")), "trimestre": timeutil.trimester(F.col("semana_gestacion"))})
    factors = spark.createDataFrame([(1, "HTA", "Hipertension", True), (2, "DMG", "Diabetes", True), (3, "OBS", "Obesidad", False)], "id_factor_riesgo int, clave_factor string, nombre_factor string, activo boolean")
    bridge = e.select("id_embarazo", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("id_factor_riesgo"), F.date_add("fecha_inicio", 30).alias("fecha_diagnostico"), (F.col("id_embarazo") % 2 == 0).alias("activo"))
    star = {
        "hechos": f,
        "dim_embarazo": e.withColumn("clasificacion_embarazo", F.lit(None).cast("string")),
        "dim_paciente": patients,
        "dim_clinica": R.clinics(spark, d),
        "dim_semaforo": R.levels(spark, d),
        "dim_tiempo_gestacional": weeks,
        "dim_factor_riesgo": factors,
        "puente_embarazo_factor": bridge.filter((F.col("id_embarazo") + F.col("id_factor_riesgo")) % 3 == 0),
        "seudonimos": table(spark, d, "seudonimo_embarazo").groupBy("id_embarazo").agg(F.min("seudonimo").alias("seudonimo")),
        "seudonimos_paciente": patients.filter(id_ % 17 > 0).select("id_paciente", F.md5(text("paciente-", id_)).alias("seudonimo")),
    }
    source = {
        "seguimiento_clinico": follow,
        "usuario_medico": physicians.select("id_medico", (physician + 1000).alias("id_usuario")),
        "usuarios": physicians.select((physician + 1000).alias("id_usuario"), F.when(physician % 11 == 0, 3).otherwise(2).alias("id_rol"), text("M", physician, "@X.invalid").alias("email"), (physician % 7 > 0).alias("activo")),
        "roles": spark.createDataFrame([(1, "ADMIN"), (2, "MEDICO"), (3, "PACIENTE")], "id_rol int, nombre_rol string"),
    }
    return star, source


def _plain(df: DataFrame) -> DataFrame:
    """Days as text and decimals as numbers."""
    to = lambda kind: "string" if kind == "date" else "double" if kind.startswith("decimal") else kind
    return df.select(*[F.col(c).cast(to(kind)).alias(c) for c, kind in df.dtypes])


def _entitled(view, spark, d) -> DataFrame:
    return _plain(view(*stand_ins(spark, d), F.lit(TODAY).cast("date")))


@query(_CTE + f"select {_CONTRACT}, c.provincia from contrato left join clinicas c on c.id_clinica = c_p")
def v_embarazo(spark, d):
    return _plain(views.v_embarazo(stand_ins(spark, d)[0]))


@query(_CTE + f""", s as (select id_embarazo, id_sesion, row_number() over (partition by id_embarazo order by min(fecha_hora), id_sesion) secuencia_sesion from hechos where id_sesion is not null group by 1, 2)
select m.seudonimo_embarazo, q.seudonimo_paciente, w.semana_gestacion, w.trimestre, n.codigo_nivel codigo_semaforo, n.prioridad prioridad_semaforo, cast(h.hr_valor as double) hr_valor, cast(h.spo2_valor as double) spo2_valor, h.mov_valor, h.estado_hr, h.estado_spo2, h.estado_mov,
 strftime({_DAY.replace("fecha_hora", "h.fecha_hora")}, '%Y-%m-%d') fecha_captura, s.secuencia_sesion, c.provincia
from hechos h join s on s.id_embarazo = h.id_embarazo and s.id_sesion = h.id_sesion join mapa m on m.id_embarazo = h.id_embarazo join mapa_p q on q.id_paciente = h.id_paciente join semanas w on w.id_tiempo_gestacional = h.id_tiempo_gestacional join niveles n on n.id_semaforo = h.id_semaforo left join clinicas c on c.id_clinica = h.id_clinica""")
def v_lectura(spark, d):
    return _plain(views.v_lectura(stand_ins(spark, d)[0]))


@query(_CTE + """select upn_medico, seudonimo_embarazo from permiso""")
def v_entitlement_medico(spark, d):
    return _entitled(views.v_entitlement_medico, spark, d)


@query(_CTE + """select upn_medico, seudonimo_paciente from permiso_p""")
def v_entitlement_paciente_medico(spark, d):
    return _entitled(views.v_entitlement_paciente_medico, spark, d)


@query(_CTE + """select q.seudonimo_paciente, p.nombre_completo || ' — ' || p.cedula paciente_display, p.nombre_completo, p.cedula, p.telefono_pac, p.email_pac, strftime(p.fecha_nac, '%Y-%m-%d') fecha_nac from pacientes p join mapa_p q using (id_paciente) where q.seudonimo_paciente in (select seudonimo_paciente from permiso_p)""")
def v_paciente_medico(spark, d):
    return _entitled(views.v_paciente_medico, spark, d)


@query(_CTE + f"""select {_CONTRACT}, fecha_inicio, fecha_probable_parto, fecha_cierre, c.nombre_clinica, c.provincia, c.distrito from contrato join clinicas c on c.id_clinica = c_e where seudonimo_embarazo in (select seudonimo_embarazo from permiso)""")
def v_embarazo_medico(spark, d):
    return _entitled(views.v_embarazo_medico, spark, d)


@query(_CTE + """select m.seudonimo_embarazo, f.clave_factor, strftime(b.fecha_diagnostico, '%Y-%m-%d') fecha_diagnostico, b.activo from puente b join mapa m using (id_embarazo) join factores f using (id_factor_riesgo) where m.seudonimo_embarazo in (select seudonimo_embarazo from permiso)""")
def v_embarazo_factor_riesgo(spark, d):
    return _entitled(views.v_embarazo_factor_riesgo, spark, d)


_MEAN = "case when count({0}) > 0 then sign(sum(cast({0} * 100 as bigint))) * ((2 * abs(sum(cast({0} * 100 as bigint))) + 10 * count({0})) // (20 * count({0}))) / 10.0 end"


def _cells_sql(least: int) -> str:
    return f"""select c.provincia, strftime({_DAY}, '%Y-%m-01') mes, n.codigo_nivel codigo_semaforo, count(*) lecturas, count(distinct h.id_embarazo) embarazos, cast({_MEAN.format("h.hr_valor")} as double) hr_promedio, cast({_MEAN.format("h.spo2_valor")} as double) spo2_promedio
from hechos h join niveles n using (id_semaforo) left join clinicas c on h.id_clinica = c.id_clinica group by 1, 2, 3 having count(distinct h.id_embarazo) >= {least}"""


@query(_CTE + _cells_sql(views.LEAST_CELL))
def v_resumen_administrativo(spark, d):
    return _plain(views.v_resumen_administrativo(stand_ins(spark, d)[0]))


@query(_CTE + _cells_sql(2))
def summary_cells(spark, d):
    """The administrative summary with a lower bound for its cells, as small tables fill few of the published size."""
    return _plain(views.v_resumen_administrativo(stand_ins(spark, d)[0], least=2))


@query(_CTE + "select semana_gestacion, mes_gestacion, trimestre from semanas")
def v_tiempo_gestacional(spark, d):
    return views.v_tiempo_gestacional(stand_ins(spark, d)[0])


@query(R.with_("niveles") + "select codigo_nivel, etiqueta_visual, color_hex, prioridad, mensaje_app, version_referencia from niveles")
def v_semaforo(spark, d):
    return views.v_semaforo({"dim_semaforo": R.levels(spark, d)})


@query(_CTE + "select clave_factor, nombre_factor, activo from factores")
def v_factor_riesgo(spark, d):
    return views.v_factor_riesgo(stand_ins(spark, d)[0])


@query(_CTE + f"""select 'PACIENTE' rol, id_paciente identidad, count(*) embarazos from embarazos where id_paciente is not null group by 2
union all select 'MEDICO', id_medico, count(distinct id_embarazo) from seguimiento where activo and desde <= date '{TODAY}' and (hasta is null or hasta >= date '{TODAY}') and id_embarazo in (select id_embarazo from embarazos) group by 2""")
def scoped_rows(spark, d):
    """How many pregnancies each patient and each physician may see that day."""
    star, source = stand_ins(spark, d)
    e = star["dim_embarazo"]
    followed = views.current_follow_up(source, F.lit(TODAY).cast("date")).select("id_medico", "id_embarazo").distinct()
    own = e.filter("id_paciente is not null").groupBy(F.lit("PACIENTE").alias("rol"), F.col("id_paciente").alias("identidad")).agg(F.count("*").alias("embarazos"))
    theirs = followed.join(e.select("id_embarazo"), "id_embarazo", "left_semi").groupBy(F.lit("MEDICO").alias("rol"), F.col("id_medico").alias("identidad")).agg(F.count("*").alias("embarazos"))
    return own.unionByName(theirs)


@query(_CTE + ", " + R.CTE["sesiones"] + f""", v as (select distinct id_embarazo from seguimiento where activo and desde <= date '{TODAY}' and (hasta is null or hasta >= date '{TODAY}'))
select id_embarazo, id_sesion, epoch_us(fecha_inicio) inicio, row_number() over (partition by id_embarazo order by fecha_inicio desc, id_sesion desc) n from sesiones where id_embarazo in (select id_embarazo from v) qualify n <= 10""")
def newest_sessions(spark, d):
    """The ten newest sessions of each pregnancy that someone follows, newest first."""
    _, source = stand_ins(spark, d)
    seen = views.current_follow_up(source, F.lit(TODAY).cast("date")).select("id_embarazo")
    s = R.sessions(spark, d).join(seen, "id_embarazo", "left_semi")
    return top_n(s, ["id_embarazo"], [F.col("fecha_inicio").desc(), F.col("id_sesion").desc()], 10, "n").select("id_embarazo", "id_sesion", F.unix_micros("fecha_inicio").alias("inicio"), F.col("n").cast("long").alias("n"))


@query(R.with_("hechos") + """, l as (select * from hechos qualify row_number() over (partition by id_embarazo order by epoch_us(fecha_hora) desc, id_lectura desc) = 1),
m as (select id_embarazo, cast(arg_max(hr_valor, (epoch_us(fecha_hora), id_lectura)) filter (hr_valor is not null) as double) ultimo_hr, cast(arg_max(spo2_valor, (epoch_us(fecha_hora), id_lectura)) filter (spo2_valor is not null) as double) ultimo_spo2,
 arg_max(mov_valor, (epoch_us(fecha_hora), id_lectura)) filter (mov_valor is not null) ultimo_mov, count(*) lecturas from hechos group by 1)
select m.*, l.id_lectura ultima, l.estado_hr, l.estado_spo2, l.estado_mov from m join l using (id_embarazo)""")
def summary_document(spark, d):
    """Latest value of each metric, number of readings, and the levels of the latest reading of each pregnancy."""
    f = R.facts(spark, d, "id_embarazo", "fecha_hora", "hr_valor", "spo2_valor", "mov_valor", "estado_hr", "estado_spo2", "estado_mov").withColumn("t", F.unix_micros("fecha_hora"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("t", "id_lectura", c)))[c]
    states = ["estado_hr", "estado_spo2", "estado_mov"]
    newest = F.max(F.struct("t", "id_lectura", *states)).alias("x")
    m = f.groupBy("id_embarazo").agg(last("hr_valor").cast("double").alias("ultimo_hr"), last("spo2_valor").cast("double").alias("ultimo_spo2"), last("mov_valor").alias("ultimo_mov"), F.count("*").alias("lecturas"), newest)
    return m.select("id_embarazo", "ultimo_hr", "ultimo_spo2", "ultimo_mov", "lecturas", F.col("x.id_lectura").alias("ultima"), *[f"x.{c}" for c in states])


@query(R.with_("hechos") + """select id_embarazo, id_lectura, epoch_us(fecha_hora) t, row_number() over (partition by id_embarazo order by fecha_hora desc, id_lectura desc) n
from (select *, max(fecha_hora) over (partition by id_embarazo) fin from hechos) where fecha_hora >= fin - interval 30 day qualify n <= 10""")
def summary_readings(spark, d):
    """The ten newest readings of each pregnancy within the thirty days before its last one."""
    f = R.facts(spark, d, "id_embarazo", "fecha_hora")
    n = top_n(f, ["id_embarazo"], [F.col("fecha_hora").desc(), F.col("id_lectura").desc()], 10, "n")
    end = f.groupBy(F.col("id_embarazo").alias("_e")).agg(F.max("fecha_hora").alias("_fin"))
    kept = n.join(end, F.col("id_embarazo").eqNullSafe(F.col("_e"))).filter(F.col("fecha_hora") >= F.col("_fin") - F.expr("interval 30 days"))
    return kept.select("id_embarazo", "id_lectura", F.unix_micros("fecha_hora").alias("t"), F.col("n").cast("long").alias("n"))


QUERIES, SQL = query.QUERIES, query.SQL
