"""Joins, aggregations and set operations over the monitoring relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions import levels, timeutil
from telar.operators.copies import symmetric_difference
from telar.operators.coverage import covered_whole, covering
from telar.operators.ranking import single_or_null
from telar.plans import relations as R
from telar.queries.registry import Registry
from telar.session import table

query = Registry()


@query(R.with_("lecturas", "sesiones", "embarazos") + """select l.id_lectura, s.id_embarazo, s.tipo_sesion, e.id_paciente, e.estado_embarazo, epoch_us(l.fecha_hora_captura) captura_us from lecturas l join sesiones s using (id_sesion) join embarazos e on s.id_embarazo = e.id_embarazo""")
def reading_context_join(spark, d):
    """Readings with their session and pregnancy; readings without either fall out."""
    s = R.sessions(spark, d).select("id_sesion", "id_embarazo", "tipo_sesion")
    e = R.pregnancies(spark, d).select("id_embarazo", "id_paciente", "estado_embarazo")
    # pregnancies go to the sessions first, of which there are fewer: a pregnancy with many readings does not come together
    both = R.readings(spark, d).select("id_lectura", "id_sesion", F.unix_micros("fecha_hora_captura").alias("captura_us")).join(s.join(e, "id_embarazo"), "id_sesion")
    return both.select("id_lectura", "id_embarazo", "tipo_sesion", "id_paciente", "estado_embarazo", "captura_us")


@query(R.with_("lecturas", "hechos") + "select id_lectura, id_sesion, semana_gestacion from lecturas l where not exists (select 1 from hechos h where h.id_lectura = l.id_lectura)")
def incremental_antijoin(spark, d):
    """Readings that the facts don't hold yet: by difference of keys, not by time or greatest id."""
    return R.readings(spark, d).join(table(spark, d, "fact_lectura_biometrica").select("id_lectura"), "id_lectura", "left_anti").select("id_lectura", "id_sesion", "semana_gestacion")


@query(R.with_("medicos", "clinicas") + "select m.id_medico, m.especialidad, c.nombre_clinica, c.provincia from medicos m join clinicas c using (id_clinica)")
def dimension_lookup(spark, d):
    return R.physicians(spark, d).join(R.clinics(spark, d), "id_clinica").select("id_medico", "especialidad", "nombre_clinica", "provincia")


@query(R.with_("hechos", "niveles") + "select h.id_lectura, n.codigo_nivel, n.prioridad from hechos h join niveles n using (id_semaforo)")
def catalogue_lookup_inner(spark, d):
    """Inner on purpose: a fact with a broken level must not pass as one without a level."""
    return R.facts(spark, d, "id_semaforo").join(R.levels(spark, d), "id_semaforo").select("id_lectura", "codigo_nivel", "prioridad")


@query(R.with_("embarazos", "clinicas") + "select e.id_embarazo, c.nombre_clinica, c.provincia from embarazos e left join clinicas c using (id_clinica)")
def optional_clinic(spark, d):
    return R.pregnancies(spark, d).join(R.clinics(spark, d), "id_clinica", "left").select("id_embarazo", "nombre_clinica", "provincia")


_FKS = [
    ("fact_lectura_biometrica", "id_sesion", "sesion_monitoreo", "id_sesion"),
    ("fact_lectura_biometrica", "id_embarazo", "dim_embarazo", "id_embarazo"),
    ("fact_lectura_biometrica", "id_clinica", "dim_clinica", "id_clinica"),
    ("fact_lectura_biometrica", "id_medico", "dim_medico_version", "id_medico"),
    ("fact_lectura_biometrica", "id_semaforo", "dim_semaforo", "id_semaforo"),
    ("lectura_resumen", "id_sesion", "sesion_monitoreo", "id_sesion"),
    ("sesion_monitoreo", "id_embarazo", "dim_embarazo", "id_embarazo"),
    ("seudonimo_embarazo", "id_embarazo", "dim_embarazo", "id_embarazo"),
    ("dim_embarazo", "id_clinica", "dim_clinica", "id_clinica"),
    ("medico_clinica", "id_clinica", "dim_clinica", "id_clinica"),
]


def _fk_sql(t: str, c: str, p: str, k: str) -> str:
    return f"select '{t}' tabla, '{c}' columna, count(distinct {c}) claves, count(*) filas from {t} where {c} is not null and {c} not in (select {k} from {p} where {k} is not null) having count(*) > 0"


@query(" union all ".join(_fk_sql(*x) for x in _FKS))
def fk_check(spark, d):
    """Foreign keys missing in their parent.

    All keys of a table are stacked in one scan, and counted per key before anything is
    shuffled; parents' keys come as rows of their own, so one aggregation tells which are there.
    """
    rows = []
    for t in dict.fromkeys(x[0] for x in _FKS):
        own = [(i, c) for i, (t_, c, _, _) in enumerate(_FKS) if t_ == t]
        stacked = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("long").alias("k")) for i, c in own])
        rows.append(table(spark, d, t).select(F.explode(stacked).alias("x")).select("x.i", "x.k", F.lit(1).cast("long").alias("n"), F.lit(0).alias("hay")))
    for p, k in dict.fromkeys(x[2:] for x in _FKS):
        of = F.array(*[F.lit(i) for i, x in enumerate(_FKS) if x[2:] == (p, k)])
        rows.append(table(spark, d, p).select(F.explode(of).alias("i"), F.col(k).cast("long").alias("k"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("hay")))
    keys = reduce(DataFrame.unionByName, rows).filter("k is not null").groupBy("i", "k").agg(F.sum("n").alias("n"), F.max("hay").alias("hay"))
    gone = keys.filter("hay = 0").groupBy("i").agg(F.count("*").alias("claves"), F.sum("n").alias("filas"))
    name = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in _FKS]), F.col("i") + 1)
    return gone.select(name(0).alias("tabla"), name(1).alias("columna"), "claves", "filas")


_DIMS = [("sesion", "id_sesion", "sesion_monitoreo"), ("embarazo", "id_embarazo", "dim_embarazo"), ("clinica", "id_clinica", "dim_clinica"), ("medico", "id_medico", "dim_medico_version"), ("semaforo", "id_semaforo", "dim_semaforo")]


@query(R.with_("hechos") + "select id_lectura, " + ", ".join(f"{c} not in (select {c} from {p} where {c} is not null) sin_{n}" for n, c, p in _DIMS) + " from hechos where " + " or ".join(f"{c} not in (select {c} from {p} where {c} is not null)" for _, c, p in _DIMS))
def orphans(spark, d):
    """Facts without one of their dimensions, with a flag for each; a null reference is none."""
    f = R.facts(spark, d, *[c for _, c, _ in _DIMS])
    for n, c, p in _DIMS:
        f = f.join(table(spark, d, p).select(c).distinct().withColumn(f"_{n}", F.lit(True)), c, "left")
        f = f.withColumn(f"sin_{n}", F.when(F.col(c).isNotNull(), F.col(f"_{n}").isNull()))
    return f.filter(" or ".join(f"sin_{n}" for n, _, _ in _DIMS)).select("id_lectura", *[f"sin_{n}" for n, _, _ in _DIMS])


_TODAY = "2024-06-30"


@query(R.with_("embarazos") + f"""select id_embarazo, id_clinica from embarazos e where exists (select 1 from medico_clinica a where a.id_clinica = e.id_clinica and a.fecha_inicio <= date '{_TODAY}' and (a.fecha_final is null or a.fecha_final >= date '{_TODAY}'))""")
def entitlement_semijoin(spark, d):
    """Pregnancies at a clinic with a physician there on the day: EXISTS, which multiplies nothing."""
    today = F.lit(_TODAY).cast("date")
    valid = table(spark, d, "medico_clinica").filter(timeutil.day_at_least(today, F.col("fecha_inicio"), F.col("fecha_final")))
    return R.pregnancies(spark, d).join(valid.select("id_clinica"), "id_clinica", "left_semi").select("id_embarazo", "id_clinica")


@query(R.with_("embarazos") + f"""select distinct lower(m.email_med) upn, e.id_embarazo from embarazos e join medico_clinica a using (id_clinica) join (select distinct id_medico, email_med from dim_medico_version) m using (id_medico)
where a.fecha_inicio <= date '{_TODAY}' and (a.fecha_final is null or a.fecha_final >= date '{_TODAY}')""")
def entitlement_pairs(spark, d):
    """Distinct (account, pregnancy) pairs through affiliations valid on the day."""
    today = F.lit(_TODAY).cast("date")
    valid = table(spark, d, "medico_clinica").filter(timeutil.day_at_least(today, F.col("fecha_inicio"), F.col("fecha_final"))).select("id_medico", "id_clinica").distinct()
    mails = table(spark, d, "dim_medico_version").select("id_medico", F.lower("email_med").alias("upn")).distinct()
    return R.pregnancies(spark, d).select("id_embarazo", "id_clinica").join(valid, "id_clinica").join(mails, "id_medico").select("upn", "id_embarazo").distinct()


_COVER = R.with_("hechos") + """, c as (select h.id_lectura, h.id_clinica, count(a.id_medico) cubren, case when count(a.id_medico) = 1 then max(a.id_clinica) end valor from hechos h left join medico_clinica a on a.id_medico = h.id_medico
 and a.fecha_inicio <= cast(h.fecha_hora at time zone 'America/Panama' as date) and (a.fecha_final is null or a.fecha_final >= cast(h.fecha_hora at time zone 'America/Panama' as date)) group by 1, 2) """


def _covered(spark, d) -> DataFrame:
    f = R.facts(spark, d, "id_medico", "fecha_hora")
    events = f.select(F.col("id_lectura").alias("id"), F.col("id_medico").alias("k"), timeutil.clinical_day("fecha_hora").alias("dia")).distinct()
    periods = table(spark, d, "medico_clinica").select(F.col("id_medico").alias("k"), F.col("fecha_inicio").alias("desde"), F.col("fecha_final").alias("hasta"), F.col("id_clinica").alias("valor"))
    return covering(events, periods)


@query(_COVER + "select id_lectura, cubren, cast(valor as bigint) valor from c")
def interval_responsible(spark, d):
    """How many affiliations of the fact's physician cover its day, and the clinic where exactly one does."""
    return _covered(spark, d).select(F.col("id").alias("id_lectura"), "cubren", "valor")


@query(_COVER + "select id_lectura from c where cubren = 0")
def interval_unresolved(spark, d):
    return _covered(spark, d).filter("cubren = 0").select(F.col("id").alias("id_lectura"))


@query(_COVER + "select id_lectura, cubren from c where cubren > 1")
def interval_ambiguous(spark, d):
    return _covered(spark, d).filter("cubren > 1").select(F.col("id").alias("id_lectura"), "cubren")


@query(_COVER + "select case when cubren = 0 then 'sin_afiliacion' when cubren > 1 then 'varias' when valor = id_clinica then 'propia' else 'ajena' end resultado, count(*) n from c group by 1")
def affiliation_check(spark, d):
    """Facts by whether their physician had exactly one affiliation that day, and at the fact's clinic."""
    own = R.facts(spark, d, "id_clinica")
    both = own.join(_covered(spark, d).withColumnRenamed("id", "id_lectura"), "id_lectura")
    return both.groupBy(F.when(F.col("cubren") == 0, "sin_afiliacion").when(F.col("cubren") > 1, "varias").when(F.col("valor") == F.col("id_clinica"), "propia").otherwise("ajena").alias("resultado")).agg(F.count("*").alias("n"))


@query(R.with_("hechos") + """, s as (select id_sesion, id_medico, min(cast(fecha_hora at time zone 'America/Panama' as date)) a, max(cast(fecha_hora at time zone 'America/Panama' as date)) b from hechos where id_sesion is not null group by 1, 2)
select id_sesion, bool_and(exists (select 1 from medico_clinica m where m.id_medico = s.id_medico and m.fecha_inicio <= s.a and (m.fecha_final is null or m.fecha_final >= s.b) and (m.fecha_final is null or m.fecha_final >= m.fecha_inicio))) cubierto from s group by 1""")
def period_covered(spark, d):
    """Sessions all of whose days one affiliation of their physician covers."""
    f = R.facts(spark, d, "id_sesion", "id_medico", "fecha_hora").filter("id_sesion is not null")
    spans = f.groupBy(F.col("id_sesion").alias("id"), F.col("id_medico").alias("k")).agg(F.min(timeutil.clinical_day("fecha_hora")).alias("desde"), F.max(timeutil.clinical_day("fecha_hora")).alias("hasta"))
    periods = table(spark, d, "medico_clinica").select(F.col("id_medico").alias("k"), F.col("fecha_inicio").alias("desde"), F.col("fecha_final").alias("hasta"))
    return covered_whole(spans, periods).select(F.col("id").cast("int").alias("id_sesion"), "cubierto")


@query("""select count(*) total, count(*) filter (activo) activas, count(*) filter (activo and fecha_final is null) abiertas, count(*) filter (not activo and fecha_final is null) contradictorias, count(*) filter (fecha_inicio is null) sin_inicio from medico_clinica""")
def conditional_counts(spark, d):
    """Several conditional counts from one scan."""
    n = lambda x, a: F.count_if(F.expr(x)).alias(a)
    return table(spark, d, "medico_clinica").agg(F.count("*").alias("total"), n("activo", "activas"), n("activo and fecha_final is null", "abiertas"), n("not activo and fecha_final is null", "contradictorias"), n("fecha_inicio is null", "sin_inicio"))


@query(R.with_("embarazos", "sesiones") + "select e.id_embarazo, count(s.id_sesion) sesiones from embarazos e left join sesiones s using (id_embarazo) group by 1")
def bridge_count(spark, d):
    """Sessions of each pregnancy, also where there are none: counted before the join."""
    n = R.sessions(spark, d).groupBy("id_embarazo").agg(F.count("*").alias("sesiones"))
    return R.pregnancies(spark, d).join(n, "id_embarazo", "left").select("id_embarazo", F.coalesce("sesiones", F.lit(0)).alias("sesiones"))


@query(R.with_("embarazos") + "select distinct id_paciente from embarazos where id_paciente not in (select id_paciente from embarazos where estado_embarazo = 'ACTIVO' and id_paciente is not null)")
def not_in_subquery(spark, d):
    e = R.pregnancies(spark, d)
    return e.filter("id_paciente is not null").join(e.filter("estado_embarazo = 'ACTIVO'").select("id_paciente"), "id_paciente", "left_anti").select("id_paciente").distinct()


_COUNTED = ["lectura_resumen", "sesion_monitoreo", "fact_lectura_biometrica", "candidata_de_carga", "dim_embarazo", "seudonimo_embarazo", "medico_clinica", "dim_medico_version", "clinica", "dim_clinica", "semaforo", "dim_semaforo"]


@query(" union all ".join(f"select '{t}' nombre, count(*) valor from {t}" for t in _COUNTED) + " union all select 'sesiones_distintas', count(distinct id_sesion) from fact_lectura_biometrica union all select 'ultima_captura', max(epoch_us(fecha_hora_captura)) from lectura_resumen")
def totals(spark, d):
    """Named totals of all tables as rows; each table is read once."""
    more = {"fact_lectura_biometrica": [("sesiones_distintas", F.countDistinct("id_sesion"))], "lectura_resumen": [("ultima_captura", F.max(F.unix_micros("fecha_hora_captura")))]}
    parts = []
    for t in _COUNTED:
        own = [(t, F.count("*")), *more.get(t, [])]
        counts = table(spark, d, t).agg(*[value.alias(name) for name, value in own])
        parts.append(counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("nombre"), F.col(name).alias("valor")) for name, _ in own])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


@query("""select 'hechos' tabla, count(*) - count(distinct id_lectura) repetidas from fact_lectura_biometrica union all select 'afiliaciones', (select count(*) from medico_clinica) - (select count(*) from (select distinct id_medico, id_clinica, fecha_inicio from medico_clinica))
union all select 'seudonimos', count(*) - count(distinct id_embarazo) from seudonimo_embarazo""")
def duplicate_keys(spark, d):
    """Rows beyond one per key; a null in a composite key counts as a value."""
    one = lambda t, n, *c: table(spark, d, t).agg((F.count("*") - F.countDistinct(F.struct(*c))).alias("repetidas")).select(F.lit(n).alias("tabla"), "repetidas")
    return one("fact_lectura_biometrica", "hechos", "id_lectura").unionByName(one("medico_clinica", "afiliaciones", "id_medico", "id_clinica", "fecha_inicio")).unionByName(one("seudonimo_embarazo", "seudonimos", "id_embarazo"))


@query("""select id_medico, count(distinct id_clinica) clinicas, case when count(distinct id_clinica) = 1 then max(id_clinica) end unica, case when count(distinct case when activo then id_clinica end) = 1 then max(case when activo then id_clinica end) end unica_activa from medico_clinica group by 1""")
def single_or_null_clinic(spark, d):
    """The only clinic of a physician, null for none or several."""
    c = F.col("id_clinica")
    return table(spark, d, "medico_clinica").groupBy("id_medico").agg(F.countDistinct("id_clinica").alias("clinicas"), single_or_null(c).alias("unica"), single_or_null(c, F.col("activo")).alias("unica_activa"))


@query(R.with_("embarazos") + """select id_paciente, count(*) embarazos, min(id_clinica) id_clinica from embarazos where id_paciente is not null group by 1 having bool_and(estado_embarazo = 'FINALIZADO') and count(distinct id_clinica) = 1""")
def all_closed_groups(spark, d):
    g = R.pregnancies(spark, d).filter("id_paciente is not null").groupBy("id_paciente").agg(F.count("*").alias("embarazos"), F.min("id_clinica").alias("id_clinica"), F.every(F.col("estado_embarazo") == "FINALIZADO").alias("todos"), F.countDistinct("id_clinica").alias("clinicas"))
    return g.filter("todos and clinicas = 1").drop("todos", "clinicas")


_PRINTED = {
    "lectura_resumen": ["id_lectura", "id_sesion", "id_dispositivo", "fecha_hora_captura", "fecha_hora_sincronizacion", "codigo_semaforo", "semana_gestacion", "hr_valor", "spo2_valor", "mov_valor"],
    "fact_lectura_biometrica": ["id_lectura", "id_sesion", "id_paciente", "id_medico", "id_clinica", "id_tiempo_gestacional", "id_embarazo", "id_semaforo", "hr_valor", "spo2_valor", "mov_valor", "estado_hr", "estado_spo2", "estado_mov", "fecha_hora", "cargado_en"],
}
_INSTANTS = {"fecha_hora_captura", "fecha_hora_sincronizacion", "fecha_hora", "cargado_en"}


def _printed_sql(t: str) -> str:
    row = " || '|' || ".join(f"coalesce(cast({f'epoch_us({c})' if c in _INSTANTS else c} as varchar), '~')" for c in _PRINTED[t])
    return f"select '{t}' tabla, count(*) filas, cast(sum(cast('0x' || substr(h, 1, 8) as bigint)) as bigint) suma_1, cast(sum(cast('0x' || substr(h, 9, 8) as bigint)) as bigint) suma_2 from (select md5({row}) h from {t})"


@query(" union all ".join(_printed_sql(t) for t in _PRINTED))
def table_fingerprint(spark, d):
    """A fingerprint per table over all columns of all rows that doesn't depend on their order: sums of hashes of the rows' texts."""

    def one(t: str) -> DataFrame:
        parts = [F.coalesce((F.unix_micros(c) if c in _INSTANTS else F.col(c)).cast("string"), F.lit("~")) for c in _PRINTED[t]]
        h = table(spark, d, t).select(F.md5(F.concat_ws("|", *parts)).alias("h"))
        piece = lambda at: F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("long"))
        return h.agg(F.count("*").alias("filas"), piece(1).alias("suma_1"), piece(9).alias("suma_2")).select(F.lit(t).alias("tabla"), "filas", "suma_1", "suma_2")

    return reduce(DataFrame.unionByName, [one(t) for t in _PRINTED])


@query(R.with_("sesiones") + """select strftime(fecha_inicio at time zone 'America/Panama', '%Y-%m') mes, count(*) filter (tipo_sesion = 'SIGNOS_MATERNOS') signos, count(*) filter (tipo_sesion = 'MOVIMIENTOS_FETALES') movimientos, count(*) n from sesiones group by 1""")
def month_type_pivot(spark, d):
    """Counts by month and type in one aggregation; sessions without a beginning make up a group of their own."""
    month = timeutil.month_text(timeutil.clinical_day("fecha_inicio")).alias("mes")
    n = lambda kind, a: F.count_if(F.col("tipo_sesion") == kind).alias(a)
    return R.sessions(spark, d).groupBy(month).agg(n("SIGNOS_MATERNOS", "signos"), n("MOVIMIENTOS_FETALES", "movimientos"), F.count("*").alias("n"))


@query("select id_lectura, 'sin_hecho' lado from (select id_lectura from lectura_resumen except select id_lectura from fact_lectura_biometrica) union all select id_lectura, 'sin_lectura' from (select id_lectura from fact_lectura_biometrica except select id_lectura from lectura_resumen)")
def except_keys(spark, d):
    a, b = (table(spark, d, t).select("id_lectura") for t in ("lectura_resumen", "fact_lectura_biometrica"))
    return a.subtract(b).withColumn("lado", F.lit("sin_hecho")).unionByName(b.subtract(a).withColumn("lado", F.lit("sin_lectura")))


@query("""select (select count(*) from (select id_clinica, nombre_clinica, provincia, distrito from clinica except select id_clinica, nombre_clinica, provincia, distrito from dim_clinica))
+ (select count(*) from (select id_clinica, nombre_clinica, provincia, distrito from dim_clinica except select id_clinica, nombre_clinica, provincia, distrito from clinica)) discrepancias""")
def symmetric_diff(spark, d):
    cols = ["id_clinica", "nombre_clinica", "provincia", "distrito"]
    return symmetric_difference(table(spark, d, "clinica").select(*cols), table(spark, d, "dim_clinica").select(*cols))


@query("""select column_name columna, case when count(*) = 2 then 'ambas' when max(table_name) = 'clinica' then 'origen' else 'copia' end lado from (select 'clinica' table_name, column_name from (describe clinica) union all select 'dim_clinica', column_name from (describe dim_clinica)) group by 1""")
def schema_difference(spark, d):
    """Columns that only one of two tables has: a comparison of schemas, not of data."""
    a, b = (set(table(spark, d, t).columns) for t in ("clinica", "dim_clinica"))
    return spark.createDataFrame([(c, "ambas" if c in a & b else "origen" if c in a else "copia") for c in sorted(a | b)], "columna string, lado string")


@query(R.with_("hechos", "lecturas") + """select h.id_lectura from hechos h join lecturas l using (id_lectura) where (h.hr_valor, h.spo2_valor, h.mov_valor, h.id_sesion) is distinct from (l.hr_valor, l.spo2_valor, l.mov_valor, l.id_sesion)""")
def row_is_distinct(spark, d):
    """Loaded readings that differ from their source, nulls being equal."""
    cols = ["hr_valor", "spo2_valor", "mov_valor", "id_sesion"]
    h, r = R.facts(spark, d, *cols).alias("h"), R.readings(spark, d).alias("l")
    differ = ~F.struct(*[F.col(f"h.{c}") for c in cols]).eqNullSafe(F.struct(*[F.col(f"l.{c}") for c in cols]))
    return h.join(r, "id_lectura").filter(differ).select("id_lectura")


_K = 5


@query(R.with_("hechos", "niveles") + f"""select strftime(h.fecha_hora at time zone 'America/Panama', '%Y-%m') mes, n.codigo_nivel, count(*) lecturas, count(distinct h.id_embarazo) embarazos, cast(sum(cast(h.hr_valor * 100 as bigint)) as bigint) hr_suma, count(h.hr_valor) hr_n
from hechos h join niveles n using (id_semaforo) group by 1, 2 having count(distinct h.id_embarazo) >= {_K}""")
def kanon_summary(spark, d):
    """Cells of month and level with at least k pregnancies; sums in hundredths are exact."""
    h = R.facts(spark, d, "id_semaforo", "id_embarazo", "hr_valor", "fecha_hora").select("id_semaforo", "id_embarazo", "hr_valor", timeutil.month_text(timeutil.clinical_day("fecha_hora")).alias("mes"))
    j = h.join(R.levels(spark, d), "id_semaforo")
    return j.groupBy("mes", "codigo_nivel").agg(F.count("*").alias("lecturas"), F.countDistinct("id_embarazo").alias("embarazos"), F.sum((F.col("hr_valor") * 100).cast("long")).alias("hr_suma"), F.count("hr_valor").alias("hr_n")).filter(F.col("embarazos") >= _K)


@query(f"""select n_name, strftime(o_orderdate, '%Y-%m') mes, o_orderstatus, count(*) pedidos, count(distinct o_custkey) clientes, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) centavos
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3 having count(distinct o_custkey) >= {_K}""")
def kanon_orders(spark, d):
    """The same summary over orders, whose cells are fuller."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("mes"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "mes", "o_orderstatus").agg(F.count("*").alias("pedidos"), F.countDistinct("o_custkey").alias("clientes"), F.sum("c").alias("centavos")).filter(F.col("clientes") >= _K)


@query(R.with_("hechos", "niveles", "lecturas") + """select n.codigo_nivel nivel, l.codigo_semaforo origen, count(*) n from hechos h join niveles n using (id_semaforo) join lecturas l on h.id_lectura = l.id_lectura where n.codigo_nivel <> l.codigo_semaforo group by 1, 2""")
def level_against_source(spark, d):
    h = R.facts(spark, d, "id_semaforo").join(R.levels(spark, d), "id_semaforo")
    return h.join(R.readings(spark, d).select("id_lectura", "codigo_semaforo"), "id_lectura").filter("codigo_nivel <> codigo_semaforo").groupBy(F.col("codigo_nivel").alias("nivel"), F.col("codigo_semaforo").alias("origen")).agg(F.count("*").alias("n"))


@query(R.with_("hechos") + """, s as (select id_lectura, case when 'ERROR' in (estado_hr, estado_spo2, estado_mov) then 'ERROR' when 'WARNING' in (estado_hr, estado_spo2, estado_mov) then 'WARNING' when 'OK' in (estado_hr, estado_spo2, estado_mov) then 'OK' end severo from hechos) select severo, count(*) n from s group by 1""")
def max_severity(spark, d):
    worst = levels.severest(F.col("estado_hr"), F.col("estado_spo2"), F.col("estado_mov")).alias("severo")
    return R.facts(spark, d, "estado_hr", "estado_spo2", "estado_mov").groupBy(worst).agg(F.count("*").alias("n"))


QUERIES, SQL = query.QUERIES, query.SQL
