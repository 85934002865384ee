"""Ordered analytics: sequences, latest values, series, groups and trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators.ranking import latest_by, numbered, top_n
from telar.operators.skew import skew_safe_join
from telar.plans import relations as R
from telar.queries.registry import Registry
from telar.session import checkpoint, table

query = Registry()

_PERSONAL = R.with_("hechos") + ", h as (select id_embarazo, id_sesion, id_lectura, epoch_us(fecha_hora) t, cast(hr_valor as double) hr, cast(spo2_valor as double) spo2, cast(mov_valor as double) mov from hechos) "


def _facts(spark, d, *metrics: str) -> DataFrame:
    """Facts with their instant in microseconds and the metrics asked for."""
    own = R.facts(spark, d, "id_embarazo", "id_sesion", "fecha_hora", *[f"{m}_valor" for m in metrics])
    return own.select("id_embarazo", "id_sesion", "id_lectura", "fecha_hora", F.unix_micros("fecha_hora").alias("t"), *[F.col(f"{m}_valor").cast("double").alias(m) for m in metrics])


_ALL = ("hr", "spo2", "mov")


@query(_PERSONAL + "select id_sesion, min(t) inicio, max(t) fin, count(*) n from h group by 1")
def session_start(spark, d):
    return _facts(spark, d).groupBy("id_sesion").agg(F.min("t").alias("inicio"), F.max("t").alias("fin"), F.count("*").alias("n"))


@query(_PERSONAL + "select id_embarazo, id_sesion, inicio, row_number() over (partition by id_embarazo order by inicio, id_sesion) secuencia from (select id_embarazo, id_sesion, min(t) inicio from h where id_sesion is not null group by 1, 2)")
def session_sequence(spark, d):
    first = _facts(spark, d).filter("id_sesion is not null").groupBy("id_embarazo", "id_sesion").agg(F.min("fecha_hora").alias("_en"))
    return numbered(first, ["id_embarazo"], "_en", ["id_sesion"], "secuencia").select("id_embarazo", "id_sesion", F.unix_micros("_en").alias("inicio"), "secuencia")


@query(_PERSONAL + "select id_embarazo, t, id_lectura, hr, spo2, mov from h qualify row_number() over (partition by id_embarazo order by t desc, id_lectura desc) = 1")
def latest_reading(spark, d):
    return latest_by(_facts(spark, d, *_ALL), ["id_embarazo"], ["t", "id_lectura"], ["hr", "spo2", "mov"])


@query(_PERSONAL + "select id_embarazo, " + ", ".join(f"arg_max({c}, (t, id_lectura)) filter ({c} is not null) {c}" for c in ("hr", "spo2", "mov")) + " from h group by 1")
def latest_per_metric(spark, d):
    """The last value of each metric; zero is a value."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("t", "id_lectura", c)))[c].alias(c)
    return _facts(spark, d, *_ALL).groupBy("id_embarazo").agg(*[last(c) for c in ("hr", "spo2", "mov")])


@query(_PERSONAL + "select id_embarazo, t, id_lectura, hr valor from h where hr is not null order by 1, 2, 3")
def metric_series(spark, d):
    """One metric over time, neither filled in nor averaged."""
    return _facts(spark, d, "hr").filter("hr is not null").select("id_embarazo", "t", "id_lectura", F.col("hr").alias("valor")).orderBy("id_embarazo", "t", "id_lectura")


@query(_PERSONAL + """, g as (select *, coalesce('s' || id_sesion, 'l' || id_lectura) grupo from h),
p as (select id_embarazo, grupo, t, id_lectura, row_number() over (partition by id_embarazo, grupo order by t, id_lectura) indice, count(*) over (partition by id_embarazo, grupo) total, min((t, id_lectura)) over (partition by id_embarazo, grupo) primera from g)
select id_embarazo, id_lectura, indice, total, dense_rank() over (partition by id_embarazo order by primera) orden from p""")
def group_by_session(spark, d):
    """Readings by session: place in the session, its size, and the session's rank by its first reading.

    A reading without session is a group of its own.
    """
    own = _facts(spark, d).withColumn("grupo", F.coalesce(F.concat(F.lit("s"), F.col("id_sesion").cast("string")), F.concat(F.lit("l"), F.col("id_lectura").cast("string"))))
    groups = own.groupBy("id_embarazo", "grupo").agg(F.min(F.struct("fecha_hora", "id_lectura")).alias("p"), F.count("*").alias("total")).select("id_embarazo", "grupo", "total", F.col("p.fecha_hora").alias("_en"), F.col("p.id_lectura").alias("_id"))
    ranked = checkpoint(numbered(groups, ["id_embarazo"], "_en", ["_id"], "orden").select("id_embarazo", "grupo", "total", "orden", F.col("total").alias("filas")))
    places = numbered(own, ["id_embarazo", "grupo"], "fecha_hora", ["id_lectura"], "indice").select("id_embarazo", "grupo", "id_lectura", "indice")
    return skew_safe_join(places, ranked, ["id_embarazo", "grupo"], "filas").select("id_embarazo", "id_lectura", "indice", "total", "orden")


@query(_PERSONAL + "select id_embarazo, id_lectura, t from (select *, max(t) over (partition by id_embarazo) ultimo from h) where t >= ultimo - 30 * 86400000000")
def trailing_30d(spark, d):
    """Readings of the thirty days up to the pregnancy's last one."""
    own = _facts(spark, d).select("id_embarazo", "id_lectura", "t")
    last = checkpoint(own.groupBy("id_embarazo").agg(F.max("t").alias("ultimo"), F.count("*").alias("n")))
    return skew_safe_join(own, last, ["id_embarazo"], "n").filter(F.col("t") >= F.col("ultimo") - 30 * 86_400_000_000).select("id_embarazo", "id_lectura", "t")


@query(_PERSONAL + "select id_embarazo, id_lectura, t, hr, spo2, mov from h qualify row_number() over (partition by id_embarazo order by t desc, id_lectura desc) <= 10")
def top_n_recent(spark, d):
    return top_n(_facts(spark, d, *_ALL), ["id_embarazo"], [F.col("t").desc(), F.col("id_lectura").desc()], 10).select("id_embarazo", "id_lectura", "t", "hr", "spo2", "mov")


@query(R.with_("embarazos") + "select id_embarazo, id_paciente, strftime(fecha_inicio, '%Y-%m-%d') inicio from embarazos order by fecha_inicio desc, id_embarazo desc")
def episodes_newest_first(spark, d):
    return R.pregnancies(spark, d).orderBy(F.col("fecha_inicio").desc(), F.col("id_embarazo").desc()).select("id_embarazo", "id_paciente", F.col("fecha_inicio").cast("string").alias("inicio"))


@query("select event_id, user_id, event_type from events where event_type <> 'view' order by event_id limit 50")
def fifo_limit(spark, d):
    """The oldest fifty events of the queue."""
    return table(spark, d, "events").filter("event_type <> 'view'").orderBy("event_id").limit(50).select("event_id", "user_id", "event_type")


@query(R.with_("hechos") + "select id_clinica, count(*) total, array_to_string(list_slice(list_sort(list(distinct id_lectura)), 1, 10), ',') primeras from hechos group by 1")
def bounded_id_list(spark, d):
    """The ten least ids of each clinic and how many there are; only ten of each leave a task."""
    f = R.facts(spark, d, "id_clinica")
    n = f.groupBy("id_clinica").agg(F.count("*").alias("total"))
    least = top_n(f.distinct(), ["id_clinica"], [F.col("id_lectura")], 10).groupBy("id_clinica").agg(F.concat_ws(",", F.sort_array(F.collect_list("id_lectura")).cast("array<string>")).alias("primeras"))
    return n.join(least, "id_clinica")


@query("select id_medico, count(distinct vigente_desde) n from dim_medico_version group by 1 having count(distinct vigente_desde) > 1")
def uniqueness_probe(spark, d):
    return table(spark, d, "dim_medico_version").groupBy("id_medico").agg(F.countDistinct("vigente_desde").alias("n")).filter("n > 1")


@query(R.with_("embarazos") + """, c as (select *, estado_embarazo = 'ACTIVO' and fecha_cierre is null corriente from embarazos), n as (select id_paciente, count(*) filter (corriente) k from c group by 1)
select c.id_paciente, id_embarazo, case when k > 1 then 'AMBIGUO' when corriente then 'ACTUAL' else 'ANTERIOR' end clase from c join n on c.id_paciente is not distinct from n.id_paciente""")
def classify_episodes(spark, d):
    """Exactly one current pregnancy of a patient is current; with two or more the patient is ambiguous."""
    e = R.pregnancies(spark, d).select("id_paciente", "id_embarazo", ((F.col("estado_embarazo") == "ACTIVO") & F.col("fecha_cierre").isNull()).alias("corriente"))
    n = e.groupBy(F.col("id_paciente").alias("_p")).agg(F.count_if("corriente").alias("k"))
    return e.join(n, F.col("id_paciente").eqNullSafe(F.col("_p"))).select("id_paciente", "id_embarazo", F.when(F.col("k") > 1, "AMBIGUO").when(F.col("corriente"), "ACTUAL").otherwise("ANTERIOR").alias("clase"))


QUERIES, SQL = query.QUERIES, query.SQL
