"""Scalar derivations: levels, clinical time, names, hashes, backoff and axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions import axis, delivery, levels, text, timeutil
from telar.operators.ranking import numbered
from telar.operators.skew import skew_safe_join
from telar.plans import relations as R
from telar.queries.registry import Registry
from telar.session import checkpoint, table

query = Registry()


def _classified(spark: SparkSession, d: str) -> DataFrame:
    week = F.col("semana_gestacion")
    return R.readings(spark, d).select(
        "id_lectura",
        "codigo_semaforo",
        levels.hr_level(F.col("hr_valor")).alias("estado_hr"),
        levels.spo2_level(F.col("spo2_valor")).alias("estado_spo2"),
        levels.mov_level(F.col("mov_valor"), week, timeutil.trimester(week)).alias("estado_mov"),
    ).withColumn("nivel", levels.severest(F.col("estado_hr"), F.col("estado_spo2"), F.col("estado_mov")))


_CLASES = R.with_("lecturas") + """, clases as (select id_lectura, codigo_semaforo,
 case when hr_valor < 55 or hr_valor > 110 then 'ERROR' when hr_valor >= 60 and hr_valor < 100 then 'OK' when hr_valor is not null then 'WARNING' end estado_hr,
 case when spo2_valor >= 95 then 'OK' when spo2_valor >= 92 then 'WARNING' when spo2_valor is not null then 'ERROR' end estado_spo2,
 case when mov_valor < 0 or semana_gestacion is null or semana_gestacion < 20 then null when mov_valor >= 10 then 'OK' when 2 * mov_valor >= 10 then 'WARNING' when mov_valor is not null then 'ERROR' end estado_mov from lecturas),
 niveles as (select *, case when 'ERROR' in (estado_hr, estado_spo2, estado_mov) then 'ERROR' when 'WARNING' in (estado_hr, estado_spo2, estado_mov) then 'WARNING' when 'OK' in (estado_hr, estado_spo2, estado_mov) then 'OK' end nivel from clases) """


@query(_CLASES + "select id_lectura, estado_hr, estado_spo2, estado_mov, nivel from niveles")
def classify_levels(spark, d):
    return _classified(spark, d).drop("codigo_semaforo")


@query(_CLASES + """select 'nivel' medida, nivel estado, count(*) n from niveles where nivel is not null group by nivel union all select 'estado_hr', estado_hr, count(*) from niveles where estado_hr is not null group by estado_hr
union all select 'estado_spo2', estado_spo2, count(*) from niveles where estado_spo2 is not null group by estado_spo2 union all select 'estado_mov', estado_mov, count(*) from niveles where estado_mov is not null group by estado_mov""")
def state_distribution(spark, d):
    """One scan for all four distributions."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("medida"), F.col(c).alias("estado")) for c in ("nivel", "estado_hr", "estado_spo2", "estado_mov")])).alias("x")
    return _classified(spark, d).select(each).select("x.*").filter("estado is not null").groupBy("medida", "estado").agg(F.count("*").alias("n"))


@query(_CLASES + "select codigo_semaforo, nivel, count(*) n from niveles where codigo_semaforo is distinct from nivel group by 1, 2")
def semaphore_mismatches(spark, d):
    """Readings whose level as sent differs from the one derived, by pair of levels."""
    return _classified(spark, d).filter(~F.col("codigo_semaforo").eqNullSafe(F.col("nivel"))).groupBy("codigo_semaforo", "nivel").agg(F.count("*").alias("n"))


@query("""select codigo_nivel, count(*) filas, count(*) filter ((codigo_nivel, prioridad) not in (('OK', 1), ('WARNING', 2), ('ERROR', 3))) incoherentes from dim_semaforo group by 1""")
def tuple_not_in(spark, d):
    """Levels whose code and priority are no pair of the fixed ones."""
    wrong = ~F.expr("(codigo_nivel, prioridad) IN (('OK', 1), ('WARNING', 2), ('ERROR', 3))")
    return table(spark, d, "dim_semaforo").groupBy("codigo_nivel").agg(F.count("*").alias("filas"), F.count_if(wrong).alias("incoherentes"))


@query(R.with_("lecturas") + "select strftime(fecha_hora_captura at time zone 'America/Panama', '%Y-%m-%d') dia, count(*) n, count(hr_valor) n_hr, count(mov_valor) n_mov from lecturas group by 1")
def clinical_day(spark, d):
    return R.readings(spark, d).groupBy(timeutil.clinical_day("fecha_hora_captura").cast("string").alias("dia")).agg(F.count("*").alias("n"), F.count("hr_valor").alias("n_hr"), F.count("mov_valor").alias("n_mov"))


@query(R.with_("lecturas") + "select strftime(fecha_hora_captura at time zone 'America/Panama', '%Y-%m') mes, id_dispositivo, count(*) n from lecturas group by 1, 2")
def clinical_month(spark, d):
    return R.readings(spark, d).groupBy(timeutil.month_text(timeutil.clinical_month("fecha_hora_captura")).alias("mes"), "id_dispositivo").agg(F.count("*").alias("n"))


_SEMANAS = R.with_("hechos", "embarazos") + """, s as (select h.id_lectura, h.id_tiempo_gestacional - 99 declarada, datediff('day', e.fecha_inicio, cast(h.fecha_hora at time zone 'America/Panama' as date)) dias from hechos h join embarazos e using (id_embarazo)) """


@query(_SEMANAS + "select id_lectura, declarada, cast(floor(dias / 7.0) as integer) + 1 calculada, case when cast(floor(dias / 7.0) as integer) + 1 <= 13 then 1 when cast(floor(dias / 7.0) as integer) + 1 <= 27 then 2 else 3 end trimestre, cast(least(9, floor(floor(dias / 7.0) / 4.0) + 1) as integer) mes from s")
def gestational_week(spark, d):
    week = timeutil.gestational_week(timeutil.clinical_day("fecha_hora"), F.col("fecha_inicio"))
    both = R.facts(spark, d, "id_embarazo", "id_tiempo_gestacional", "fecha_hora").join(R.pregnancies(spark, d).select("id_embarazo", "fecha_inicio"), "id_embarazo")
    return both.select("id_lectura", (F.col("id_tiempo_gestacional") - 99).alias("declarada"), week.alias("calculada")).select("*", timeutil.trimester(F.col("calculada")).alias("trimestre"), timeutil.gestational_month(F.col("calculada")).alias("mes"))


@query(_SEMANAS + "select declarada - (cast(floor(dias / 7.0) as integer) + 1) diferencia, count(*) n from s where declarada <> floor(dias / 7.0) + 1 group by 1")
def recalculated_week(spark, d):
    """Informative: declared weeks that differ from the recalculated ones."""
    return gestational_week(spark, d).filter("declarada <> calculada").groupBy((F.col("declarada") - F.col("calculada")).alias("diferencia")).agg(F.count("*").alias("n"))


@query(R.with_("embarazos") + "select id_embarazo, case when datediff('day', fecha_inicio, fecha_probable_parto) % 7 = 0 and fecha_probable_parto >= fecha_inicio then datediff('day', fecha_inicio, fecha_probable_parto) // 7 end semanas, duracion_est_semanas from embarazos")
def exact_weeks(spark, d):
    return R.pregnancies(spark, d).select("id_embarazo", timeutil.exact_weeks(F.col("fecha_probable_parto"), F.col("fecha_inicio")).alias("semanas"), "duracion_est_semanas")


@query("""with v as (select distinct id_medico, vigente_desde, cast(registrado_en at time zone 'UTC' as date) hasta from dim_medico_version)
select id_medico, strftime(vigente_desde, '%Y-%m-%d') desde, strftime(hasta, '%Y-%m-%d') hasta, cast(5 * floor((year(hasta) - year(vigente_desde) - case when strftime(hasta, '%m%d') < strftime(vigente_desde, '%m%d') then 1 else 0 end) / 5.0) as integer) banda from v""")
def age_band(spark, d):
    """Five-year bands of calendar years between two days."""
    until = F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("registrado_en").cast("timestamp_ntz")))
    v = table(spark, d, "dim_medico_version").select("id_medico", "vigente_desde", until.alias("hasta")).distinct()
    return v.select("id_medico", F.col("vigente_desde").cast("string").alias("desde"), F.col("hasta").cast("string").alias("hasta"), timeutil.age_band(F.col("hasta"), F.col("vigente_desde")).alias("banda"))


@query(R.with_("embarazos") + """select id_embarazo, case when date '2025-06-30' <= fecha_probable_parto then cast(floor(datediff('day', fecha_inicio, date '2025-06-30') / 7.0) as integer) + 1 end semana from embarazos where estado_embarazo = 'ACTIVO' and fecha_cierre is null""")
def current_week(spark, d):
    """The week of current pregnancies on a given day, none after the due date."""
    today = F.lit("2025-06-30").cast("date")
    return R.pregnancies(spark, d).filter((F.col("estado_embarazo") == "ACTIVO") & F.col("fecha_cierre").isNull()).select("id_embarazo", F.when(today <= F.col("fecha_probable_parto"), timeutil.gestational_week(today, F.col("fecha_inicio"))).alias("semana"))


@query(R.with_("embarazos") + "select id_embarazo, strftime(fecha_inicio, '%Y-%m-01') mes_inicio, strftime(fecha_probable_parto, '%Y-%m-01') mes_parto, fecha_cierre is not null cerrado from embarazos")
def month_generalise(spark, d):
    month = lambda c: F.trunc(c, "MM").cast("string")
    return R.pregnancies(spark, d).select("id_embarazo", month("fecha_inicio").alias("mes_inicio"), month("fecha_probable_parto").alias("mes_parto"), F.col("fecha_cierre").isNotNull().alias("cerrado"))


@query(R.with_("medicos") + """select id_medico, nullif(concat_ws(' ', nullif(especialidad, ''), nullif(nombre_completo, ''), nullif(telefono_med, '')), '') completo, nombre_completo || ' — ' || telefono_med rotulo from medicos""")
def full_name(spark, d):
    c = F.col
    return R.physicians(spark, d).select("id_medico", text.full_name(c("especialidad"), c("nombre_completo"), c("telefono_med")).alias("completo"), F.concat(c("nombre_completo"), F.lit(" — "), c("telefono_med")).alias("rotulo"))


@query(R.with_("medicos") + """, c as (select id_medico, '  ' || upper(email_med) || ' ' crudo from medicos) select id_medico, lower(regexp_replace(crudo, '^\\s+|\\s+$', '', 'g')) correo, regexp_full_match(lower(trim(crudo)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') valido, substr(sha256(crudo), 1, 12) clave from c""")
def canonical_email(spark, d):
    raw = F.concat(F.lit("  "), F.upper("email_med"), F.lit(" "))
    own = R.physicians(spark, d).select("id_medico", raw.alias("crudo"))
    return own.select("id_medico", text.canonical_email(F.col("crudo")).alias("correo"), text.canonical_email(F.col("crudo")).rlike(text.EMAIL_FORM).alias("valido"), text.short_key(F.col("crudo")).alias("clave"))


@query("""select id_lectura, fecha_clinica, case when fecha_clinica is not null then regexp_full_match(fecha_clinica, '\\d{4}-\\d{2}-\\d{2}') and try_cast(fecha_clinica as date) is not null end valida, count(*) n from candidata_de_carga group by 1, 2""")
def regex_validity(spark, d):
    return table(spark, d, "candidata_de_carga").groupBy("id_lectura", "fecha_clinica").agg(F.count("*").alias("n")).select("id_lectura", "fecha_clinica", F.when(F.col("fecha_clinica").isNotNull(), text.valid_date(F.col("fecha_clinica")).isNotNull()).alias("valida"), "n")


@query("""select user_id, count(*) filter (isfinite(x)) finitos, count(*) n from (select user_id, try_cast(case when event_id % 7 = 0 then 'NaN' when event_id % 11 = 0 then '' else cast(value as varchar) end as double) x from events) group by 1""")
def finite_values(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 11 == 0, "").otherwise(F.col("value").cast("string"))
    return e.groupBy("user_id").agg(F.count(text.finite(raw)).alias("finitos"), F.count("*").alias("n"))


@query(R.with_("lecturas") + """, p as (select id_lectura, '{"fecha_hora_captura":"' || strftime(fecha_hora_captura at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') || case when epoch_us(fecha_hora_captura) % 1000000 = 0 then '' else '.' || lpad(cast(epoch_us(fecha_hora_captura) % 1000000 as varchar), 6, '0') end
 || '+00:00","hr_valor":' || coalesce('"' || cast(hr_valor as varchar) || '"', 'null') || ',"id_sesion":' || id_sesion || ',"mov_valor":' || coalesce(cast(mov_valor as varchar), 'null') || ',"spo2_valor":' || coalesce('"' || cast(spo2_valor as varchar) || '"', 'null') || '}' texto from lecturas)
 select id_lectura, texto, sha256(texto) huella from p""")
def canonical_hash(spark, d):
    """Canonical text and fingerprint of each reading."""
    num = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit('"'), text.hundredths(F.col(c)), F.lit('"')))
    fields = {
        "id_sesion": F.coalesce(F.col("id_sesion").cast("string"), F.lit("null")),
        "fecha_hora_captura": F.concat(F.lit('"'), text.utc_instant(F.col("fecha_hora_captura")), F.lit('"')),
        "hr_valor": num("hr_valor"),
        "spo2_valor": num("spo2_valor"),
        "mov_valor": F.coalesce(F.col("mov_valor").cast("string"), F.lit("null")),
    }
    own = R.readings(spark, d).select("id_lectura", text.canonical_object(fields).alias("texto"))
    return own.select("id_lectura", "texto", text.fingerprint(F.col("texto")).alias("huella"))


@query("""with k as (select user_id, row_number() over (partition by user_id order by ts, event_id) intento from events)
select user_id, intento, cast(least(60, power(2, least(intento - 1, 62))) as double) espera, intento >= 5 agotado from k""")
def backoff_schedule(spark, d):
    k = numbered(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], "intento")
    return k.select("user_id", "intento", delivery.backoff(F.col("intento")).alias("espera"), (F.col("intento") >= delivery.ATTEMPTS).alias("agotado"))


_ANSWERS = [(201, "true"), (409, None), (503, None), (401, None), (403, None), (422, None), (302, None), (600, None), (201, "quizas"), (599, None), (None, None)]


@query("""with r as (select user_id, event_id % 11 c, event_id % 3 + 1 enviadas, case when event_id % 13 = 0 then event_id % 3 + 2 else event_id % 3 + 1 end creadas, case when event_id % 17 = 0 then 1 else 0 end sobran, event_id % 19 = 0 roto from events),
q as (select *, case c when 0 then 201 when 1 then 409 when 2 then 503 when 3 then 401 when 4 then 403 when 5 then 422 when 6 then 302 when 7 then 600 when 8 then 201 when 9 then 599 end codigo from r)
select user_id, codigo, case when codigo is null then 'REINTENTO' when codigo = 201 and c = 0 and not roto and sobran = 0 and creadas = enviadas then 'ENTREGADO' when codigo between 500 and 599 then 'REINTENTO' when codigo in (401, 403) then 'REINTENTO_Y_ALTO' else 'RECHAZO' end resultado, count(*) n from q group by all""")
def http_outcome(spark, d):
    """Outcomes of answers; of those with code 201 only the coherent ones are deliveries."""
    i = (F.col("event_id") % len(_ANSWERS) + 1).cast("int")
    code, header = (F.element_at(F.array(*[F.lit(x[k]).cast(kind) for x in _ANSWERS]), i) for k, kind in ((0, "int"), (1, "string")))
    e = table(spark, d, "events").select("user_id", "event_id", code.alias("codigo"), header.alias("repeticion"), (F.col("event_id") % 3 + 1).alias("enviadas"))
    made = F.when(F.col("event_id") % 13 == 0, F.col("enviadas") + 1).otherwise(F.col("enviadas"))
    ids = F.sequence(F.lit(1), (made + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)).cast("int"))
    body = F.when(F.col("event_id") % 19 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"id_sesion":1,"lecturas_creadas":'), made.cast("string"), F.lit(',"ids_lectura":['), F.concat_ws(",", ids.cast("array<string>")), F.lit("]}")))
    own = e.select("user_id", "codigo", delivery.outcome(F.col("codigo"), delivery.coherent_201(F.col("repeticion"), body, F.col("enviadas"))).alias("resultado"))
    return own.groupBy("user_id", "codigo", "resultado").agg(F.count("*").alias("n"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) k, coalesce(json_array_length('[' || repeat('1,', cast(json_extract(props, '$.k') as integer) % 4) || '1]'), 0) lecturas from events""")
def json_payload(spark, d):
    """Values out of JSON text, and how many elements a list holds."""
    k = F.get_json_object("props", "$.k").cast("long")
    package = F.concat(F.lit('{"lecturas":['), F.repeat(F.lit("1,"), (k % 4).cast("int")), F.lit("1]}"))
    return table(spark, d, "events").select("event_id", k.alias("k"), delivery.payload_size(package).cast("long").alias("lecturas"))


@query(R.with_("lecturas") + "select id_lectura, epoch_us(fecha_hora_sincronizacion) - epoch_us(fecha_hora_captura) demora_us, fecha_hora_sincronizacion < fecha_hora_captura invertida from lecturas")
def sync_delay(spark, d):
    us = lambda c: F.unix_micros(c)
    return R.readings(spark, d).select("id_lectura", (us("fecha_hora_sincronizacion") - us("fecha_hora_captura")).alias("demora_us"), (F.col("fecha_hora_sincronizacion") < F.col("fecha_hora_captura")).alias("invertida"))


_STEP = "potencia * case when round(bruto / potencia, 9) <= 1 then 1 when round(bruto / potencia, 9) <= 2 then 2 when round(bruto / potencia, 9) <= 2.5 then 2.5 when round(bruto / potencia, 9) <= 5 then 5 else 10 end"


@query(f"""with e as (select user_id, min(value) lo, max(value) hi from events group by 1),
w as (select user_id, 'lineas' tipo, case when lo < hi then lo when hi = 0 then -1 else lo - abs(hi) * 0.05 end lo, case when lo < hi then hi when hi = 0 then 1 else hi + abs(hi) * 0.05 end hi from e
 union all select user_id, 'barras', 0, case when hi = 0 then 1 else hi end from e),
p as (select *, (hi - lo) / 4.0 bruto, power(10.0, floor(log10((hi - lo) / 4.0))) potencia from w),
s as (select *, {_STEP} paso from p)
select user_id, tipo, cast(paso as double) paso, cast(case when tipo = 'barras' then 0 else (floor(lo / paso) - 1) * paso end as double) primera, cast(ceil(hi / paso) * paso as double) ultima, cast(ceil(hi / paso) - case when tipo = 'barras' then 0 else floor(lo / paso) - 1 end as bigint) + 1 marcas from s""")
def axis_marks(spark, d):
    """The marks of lines, and of bars, which begin at zero."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))

    def of(kind: str, from_zero: bool) -> DataFrame:
        low, high = axis.bounds(F.col("a"), F.col("b"), from_zero)
        own = e.select("user_id", F.lit(kind).alias("tipo"), low.alias("lo"), high.alias("hi")).withColumn("paso", axis.nice_step(F.col("hi") - F.col("lo")))
        own = own.withColumn("m", axis.marks(F.col("lo"), F.col("hi"), F.col("paso"), from_zero))
        return own.select("user_id", "tipo", "paso", F.element_at("m", 1).alias("primera"), F.element_at("m", -1).alias("ultima"), F.size("m").cast("long").alias("marcas"))

    return of("lineas", False).unionByName(of("barras", True))


@query("""with e as (select user_id, min(value) lo, max(value) hi from events group by 1)
select event_id, round(case when hi > lo then 200.0 + (value - lo) / (hi - lo) * (10.0 - 200.0) else 105.0 end, 4) y from events join e using (user_id)""")
def axis_scale(spark, d):
    """Values on the user's own axis; the bounds come from an aggregation, joined so that hot users don't hurt."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    bounds = checkpoint(e.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")))
    return skew_safe_join(e, bounds, ["user_id"], "n").select("event_id", F.round(axis.scaled(F.col("value"), F.col("lo"), F.col("hi"), 200.0, 10.0), 4).alias("y"))


QUERIES, SQL = query.QUERIES, query.SQL
