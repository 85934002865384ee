"""Queries of the general data-quality problems over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions.timeutil import clinical_day, month_text
from telar.operators.asof import known_at_event
from telar.operators.copies import diff_copies
from telar.operators.orphans import orphan_references
from telar.operators.periods import periods_and_gaps
from telar.operators.spikes import Field, flag_measurements
from telar.session import table, together

#: Bounds of a plausible reading of a living person, and of the sensors' units.
FIELDS = [
    Field("hr_valor", 20, 300, 0.35, 6.0),
    Field("spo2_valor", 0, 100, 0.15, 1.5, open_low=True),
    Field("mov_valor", 0, 1000, 0.7, 4.0),
]


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_measurements(table(spark, d, "lectura_resumen"), "id_lectura", "id_dispositivo", "fecha_hora_captura", FIELDS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).select("id_lectura", "campo").distinct()


def p1_por_dispositivo(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).groupBy("id_dispositivo", "campo").agg(F.count("*").alias("marcadas"), F.count_if("imposible").alias("imposibles"), F.count_if("salto").alias("saltos"), F.count_if("cambio").alias("cambios"), F.count_if("atascado").alias("atascadas"))


_RANGE = """greatest(quantile_disc(salto, 0.75) - quantile_disc(salto, 0.25), least((quantile_disc(salto, 0.9) - quantile_disc(salto, 0.1)) / 1.9,
  case when quantile_disc(salto, 0.75) > quantile_disc(salto, 0.25) then 2 * (quantile_disc(salto, 0.75) - quantile_disc(salto, 0.25)) end), any_value(piso))"""

_P1 = f"""
with base as (select distinct id_lectura, id_dispositivo, fecha_hora_captura, hr_valor, spo2_valor, mov_valor from lectura_resumen),
largo as (
  select id_lectura, id_dispositivo d, fecha_hora_captura t, 'hr_valor' campo, cast(hr_valor as double) v, hr_valor < 20 or hr_valor > 300 imposible, 0.35 piso, 6.0 usual from base where hr_valor is not null
  union all select id_lectura, id_dispositivo, fecha_hora_captura, 'spo2_valor', cast(spo2_valor as double), spo2_valor <= 0 or spo2_valor > 100, 0.15, 1.5 from base where spo2_valor is not null
  union all select id_lectura, id_dispositivo, fecha_hora_captura, 'mov_valor', cast(mov_valor as double), mov_valor < 0 or mov_valor > 1000, 0.7, 4.0 from base where mov_valor is not null),
cabezas as (select *, case when v is distinct from lag(v) over w then 1 else 0 end cabeza from largo window w as (partition by d, campo order by t, id_lectura)),
numeradas as (select *, sum(cabeza) over (partition by d, campo order by t, id_lectura) corrida from cabezas),
rachas as (select *, count(*) over (partition by d, campo, corrida) racha from numeradas),
vecinas as (select *, floor(extract(hour from t) / 6) franja, v - median(v) over (partition by d, campo order by t, id_lectura rows between 10 preceding and 10 following) salto,
  v - lag(v) over w a, lead(v) over w - v b, t - lag(t) over w <= interval 10 minute cerca_a, lead(t) over w - t <= interval 10 minute cerca_b
  from rachas where not imposible and racha < 8 window w as (partition by d, campo order by t, id_lectura)),
normales as (select *, case when cerca_a then abs(a) end corto, case when cerca_a and cerca_b and a * b < 0 then least(abs(a), abs(b)) end pico from vecinas),
disp as (select d, campo, quantile_disc(salto, 0.25) q1, quantile_disc(salto, 0.75) q3, (count(*) * {_RANGE} + 2 * any_value(usual)) / (count(*) + 2) iqr, any_value(piso) piso,
  count(corto) nc, coalesce(quantile_disc(corto, 0.75), 0) c3, coalesce(greatest(quantile_disc(corto, 0.75) - quantile_disc(corto, 0.25), any_value(piso)), 0) ciqr from normales group by 1, 2),
franjas as (select d, campo, franja, count(*) n, quantile_disc(salto, 0.25) q1, quantile_disc(salto, 0.75) q3, {_RANGE} iqr from normales group by 1, 2, 3),
cercas as (select d, campo, franja, (f.n * f.q1 + 100 * p.q1) / (f.n + 100) q1, (f.n * f.q3 + 100 * p.q3) / (f.n + 100) q3, (f.n * f.iqr + 100 * p.iqr) / (f.n + 100) iqr,
  (nc * c3 + 160 * p.iqr) / (nc + 100) + 4.3 * (nc * ciqr + 160 * p.iqr) / (nc + 100) brusco from franjas f join disp p using (d, campo)),
largas as (select d, campo, greatest(8, ceil(1 + (ln(0.001) - ln(n)) / ln(least(0.9, greatest(0.01, m / n))))) larga
  from (select d, campo, greatest(1.0, cast(sum(case when racha < 8 then cabeza else 0 end) as double)) n, cast(sum(case when racha between 2 and 7 then cabeza else 0 end) as double) m from rachas group by 1, 2)),
marcadas as (
  select id_lectura, d, campo, true imposible, false salto, false cambio, false atascado from largo where imposible
  union all select id_lectura, d, campo, false, salto < q1 - 4.3 * iqr or salto > q3 + 4.3 * iqr, coalesce(pico > brusco, false), false from normales join cercas using (d, campo, franja) where salto < q1 - 4.3 * iqr or salto > q3 + 4.3 * iqr or pico > brusco
  union all select id_lectura, d, campo, false, false, false, true from rachas join largas using (d, campo) where racha >= larga)
"""


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "medico_clinica"), ("id_medico", "id_clinica"), "fecha_inicio", "fecha_final")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _p2(spark, d).filter("intervalos > 1").select("id_medico", "id_clinica", "clase", day("desde").alias("desde"), F.coalesce(day("hasta"), F.lit("abierto")).alias("hasta"))


def p2_cobertura(spark: SparkSession, d: str) -> DataFrame:
    """Days covered and missed per physician and clinic, up to the last closed day."""
    days = F.sum(F.when(F.col("clase") == "continuo", F.datediff("hasta", "desde") + 1))
    gaps = F.sum(F.when(F.col("clase") == "hueco", F.datediff("hasta", "desde") + 1))
    return _p2(spark, d).groupBy("id_medico", "id_clinica").agg(F.count_if(F.col("clase") == "continuo").alias("periodos"), F.count_if(F.col("clase") == "hueco").alias("huecos"), F.coalesce(days, F.lit(0)).alias("dias_cubiertos"), F.coalesce(gaps, F.lit(0)).alias("dias_descubiertos"), F.max(F.col("hasta").isNull()).alias("abierto"))


_P2 = """
with iv as (select distinct id_medico, id_clinica, fecha_inicio s, coalesce(fecha_final, date '9999-12-31') e from medico_clinica
  where fecha_inicio is not null and (fecha_final is null or fecha_final >= fecha_inicio)),
m as (select *, max(e) over (partition by id_medico, id_clinica order by s, e rows between unbounded preceding and 1 preceding) antes from iv),
i as (select *, case when antes is null or s > antes + interval 1 day then 1 else 0 end nueva from m),
n as (select *, sum(nueva) over (partition by id_medico, id_clinica order by s, e) isla from i),
p as (select id_medico, id_clinica, isla, min(s) s, max(e) e, count(*) n from n group by all),
h as (select *, lag(e) over (partition by id_medico, id_clinica order by isla) previa from p)
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    clinics = lambda: diff_copies(table(spark, d, "clinica"), table(spark, d, "dim_clinica"), "id_clinica", ["nombre_clinica", "provincia", "distrito"], "actualizado_en", "cargado_en")
    levels = lambda: diff_copies(table(spark, d, "semaforo"), table(spark, d, "dim_semaforo"), "id_semaforo", ["codigo_nivel", "etiqueta_visual", "color_hex", "prioridad", "mensaje_app", "version_referencia"])
    clinics, levels = together(spark, clinics, levels)
    found = lambda df, name, key: df.select(F.lit(name).alias("tabla"), F.col(key).cast("long").alias("id_registro"), "campo")
    return found(clinics, "dim_clinica", "id_clinica").unionByName(found(levels, "dim_semaforo", "id_semaforo"))


def p3_resumen(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("tabla", "campo").agg(F.count("*").alias("diferencias"))


def _p3_side(table: str, key: str, columns: list[str], newest: str | None) -> str:
    order = ", ".join(([f"{newest} desc nulls last"] if newest else []) + [f"{c} desc nulls last" for c in columns])
    return f"(select {key} k, {', '.join(columns)}, true hay from {table} qualify row_number() over (partition by {key} order by {order}) = 1)"


def _p3(table: str, origin: str, key: str, columns: list[str], a: str | None, b: str | None) -> str:
    both = f"from {_p3_side(origin, key, columns, a)} a full join {_p3_side(table, key, columns, b)} b on a.k is not distinct from b.k"
    parts = [f"select '{table}' tabla, cast(coalesce(a.k, b.k) as bigint) id_registro, case when b.hay is null then 'fila_solo_en_origen' else 'fila_solo_en_copia' end campo {both} where a.hay is null or b.hay is null"]
    parts += [f"select '{table}', cast(a.k as bigint), '{c}' {both} where a.hay and b.hay and a.{c} is distinct from b.{c}" for c in columns]
    return " union all ".join(parts)


_P3 = " union all ".join(
    (
        _p3("dim_clinica", "clinica", "id_clinica", ["nombre_clinica", "provincia", "distrito"], "actualizado_en", "cargado_en"),
        _p3("dim_semaforo", "semaforo", "id_semaforo", ["codigo_nivel", "etiqueta_visual", "color_hex", "prioridad", "mensaje_app", "version_referencia"], None, None),
    )
)


TABLES = ["candidata_de_carga", "fact_lectura_biometrica", "seudonimo_embarazo"]


def _p4(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(c)

    def refs(n: int, key: str, fk: str, instant: str, target: int) -> DataFrame:
        rows = table(spark, d, TABLES[n]).filter(F.col(instant).isNotNull() & F.col(fk).isNotNull())
        own = rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.struct(us(instant).alias("t"), F.col(fk).cast("long").alias("k"))).alias("x"))
        return own.select(F.lit(n).alias("tabla"), "id", F.lit(target).alias("destino"), "x.k", "x.t")

    all_refs = refs(0, "id_lectura", "id_embarazo", "instantanea", 0).unionByName(refs(1, "id_lectura", "id_sesion", "cargado_en", 1)).unionByName(refs(2, "id_embarazo", "id_embarazo", "creado_en", 0))
    parent = lambda t, n, key, a, b: table(spark, d, t).select(F.lit(n).alias("destino"), F.col(key).cast("long").alias("k"), us(a).alias("desde"), us(b).alias("hasta"))
    parents = parent("dim_embarazo", 0, "id_embarazo", "cargado_en", "eliminado_en").unionByName(parent("sesion_monitoreo", 1, "id_sesion", "registrada_en", "eliminada_en"))
    found = orphan_references(all_refs, parents)
    return found.select(F.element_at(F.array(*[F.lit(t) for t in TABLES]), F.col("tabla") + 1).alias("tabla"), F.col("id").alias("id_registro"), month_text(clinical_day(F.timestamp_micros("t"))).alias("periodo"), "clase")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)


def p4_por_periodo(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).groupBy("tabla", "periodo", "clase").agg(F.count("*").alias("huerfanas"))


_P4 = """
with refs as (
  select 'candidata_de_carga' tabla, id_lectura id_registro, 'e' destino, arg_min(id_embarazo, instantanea) k, min(instantanea) t from candidata_de_carga group by id_lectura
  union all select 'fact_lectura_biometrica', id_lectura, 's', arg_min(id_sesion, cargado_en), min(cargado_en) from fact_lectura_biometrica group by id_lectura
  union all select 'seudonimo_embarazo', id_embarazo, 'e', id_embarazo, min(creado_en) from seudonimo_embarazo group by id_embarazo),
padres as (select 'e' destino, id_embarazo k, cargado_en desde, eliminado_en hasta from dim_embarazo
  union all select 's', id_sesion, registrada_en, eliminada_en from sesion_monitoreo),
huerfanas as (
  select tabla, cast(id_registro as bigint) id_registro, strftime(t at time zone 'America/Panama', '%Y-%m') periodo,
    case when count(p.k) = 0 then 'ausente' when count(*) filter (p.desde <= t) > 0 then 'eliminada' else 'tardia' end clase
  from refs r left join padres p on r.k = p.k and r.destino = p.destino where r.k is not null and t is not null
  group by tabla, id_registro, t having count(*) filter (p.desde <= t and (p.hasta is null or t < p.hasta)) = 0)
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    candidates, versions = table(spark, d, "candidata_de_carga"), table(spark, d, "dim_medico_version")
    events = candidates.select(F.col("id_lectura").alias("id"), F.col("id_medico").alias("k"), F.unix_date(F.expr("try_cast(fecha_clinica as date)")).alias("t"), F.col("id_clinica").alias("propio"))
    since, known = F.unix_date("vigente_desde"), F.unix_date(clinical_day("registrado_en"))
    changes = versions.select(F.col("id_medico").alias("k"), F.greatest(since, known).alias("t"), since.alias("a"), F.unix_micros("registrado_en").alias("b"), F.col("id_version").alias("c"), F.col("id_clinica").alias("v"))
    found = known_at_event(events, changes).filter(F.col("vigente").isNotNull() & ~F.col("vigente").eqNullSafe(F.col("propio")))
    return found.groupBy(F.col("id").alias("id_lectura")).agg(F.min("vigente").cast("int").alias("id_clinica_vigente"))


_P5 = """
with v as (select id_lectura, c.id_clinica propia, v.id_clinica vigente,
  row_number() over (partition by c.id_lectura, c.id_clinica order by v.vigente_desde desc, v.registrado_en desc, v.id_version desc) n
  from (select distinct id_lectura, id_medico, id_clinica, cast(fecha_clinica as date) dia from candidata_de_carga) c join dim_medico_version v on c.id_medico = v.id_medico
  and v.vigente_desde <= dia and cast(v.registrado_en at time zone 'America/Panama' as date) <= dia)
select id_lectura, min(vigente) id_clinica_vigente from v where n = 1 and vigente is not null and vigente is distinct from propia group by 1
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_por_dispositivo": p1_por_dispositivo,
    "p2_found": p2_found,
    "p2_cobertura": p2_cobertura,
    "p3_found": p3_found,
    "p3_resumen": p3_resumen,
    "p4_found": p4_found,
    "p4_por_periodo": p4_por_periodo,
    "p5_found": p5_found,
}

SQL = {
    "p1_found": _P1 + "select distinct id_lectura, campo from marcadas",
    "p1_por_dispositivo": _P1 + """select d id_dispositivo, campo, count(distinct id_lectura) marcadas, count(distinct id_lectura) filter (imposible) imposibles, count(distinct id_lectura) filter (salto) saltos, count(distinct id_lectura) filter (cambio) cambios, count(distinct id_lectura) filter (atascado) atascadas from marcadas group by 1, 2""",
    "p2_found": _P2 + """select id_medico, id_clinica, 'continuo' clase, strftime(s, '%Y-%m-%d') desde, case when e = date '9999-12-31' then 'abierto' else strftime(e, '%Y-%m-%d') end hasta from p where n > 1
union all select id_medico, id_clinica, 'hueco', strftime(previa + interval 1 day, '%Y-%m-%d'), strftime(s - interval 1 day, '%Y-%m-%d') from h where previa is not null""",
    "p2_cobertura": _P2 + """select id_medico, id_clinica, count(*) periodos, count(previa) huecos, cast(coalesce(sum(case when e < date '9999-12-31' then datediff('day', s, e) + 1 end), 0) as bigint) dias_cubiertos,
cast(coalesce(sum(datediff('day', previa, s) - 1), 0) as bigint) dias_descubiertos, max(e) = date '9999-12-31' abierto from h group by 1, 2""",
    "p3_found": _P3,
    "p3_resumen": f"select tabla, campo, count(*) diferencias from ({_P3}) group by 1, 2",
    "p4_found": _P4 + "select * from huerfanas",
    "p4_por_periodo": _P4 + "select tabla, periodo, clase, count(*) huerfanas from huerfanas group by 1, 2, 3",
    "p5_found": _P5,
}
