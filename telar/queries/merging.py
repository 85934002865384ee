"""Merges, idempotent claims and load checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators import merging as M
from telar.plans import relations as R
from telar.queries.registry import Registry
from telar.session import table

query = Registry()

_BOTH = R.with_("clinicas") + ", " + R._latest("origen", "clinica", "id_clinica", ["actualizado_en"], R.CLINIC)
_TAGGED = _BOTH + """, m as (select coalesce(s.id_clinica, t.id_clinica) id_clinica, case when s.id_clinica is not null then s.nombre_clinica else t.nombre_clinica end nombre_clinica, case when s.id_clinica is not null then s.provincia else t.provincia end provincia,
 case when s.id_clinica is not null then s.distrito else t.distrito end distrito, case when t.id_clinica is null then 'insertada' when s.id_clinica is null then 'conservada' when (s.nombre_clinica, s.provincia, s.distrito) is distinct from (t.nombre_clinica, t.provincia, t.distrito) then 'actualizada' else 'igual' end accion
 from origen s full join clinicas t on s.id_clinica = t.id_clinica) """


def _merged(spark, d) -> DataFrame:
    return M.type1_merge(R.clinics(spark, d), R.clinics(spark, d, copy=False), ["id_clinica"], R.CLINIC)


@query(_TAGGED + "select * from m")
def tag_merge_type1(spark, d):
    """The clinic dimension after a type-1 merge of its source, with what happened to each row."""
    return _merged(spark, d)


@query(_TAGGED + "select count(*) filter (accion = 'insertada') insertadas, count(*) filter (accion = 'actualizada') actualizadas, count(*) filter (accion = 'igual') iguales, count(*) filter (accion = 'conservada') conservadas from m")
def merge_counters(spark, d):
    return M.merge_counts(_merged(spark, d))


@query("select distinct id_embarazo from dim_embarazo where id_embarazo not in (select id_embarazo from seudonimo_embarazo where id_embarazo is not null)")
def insert_missing(spark, d):
    """Pregnancies that still need a pseudonym; minting adds a ``uuid()``, which no oracle can repeat."""
    return M.missing_keys(table(spark, d, "seudonimo_embarazo"), table(spark, d, "dim_embarazo"), "id_embarazo")


@query(R.with_("hechos", "lecturas") + """, c as (select h.id_lectura, concat_ws(',', case when h.id_sesion is distinct from l.id_sesion then 'id_sesion' end, case when h.hr_valor is distinct from l.hr_valor then 'hr_valor' end, case when h.spo2_valor is distinct from l.spo2_valor then 'spo2_valor' end, case when h.mov_valor is distinct from l.mov_valor then 'mov_valor' end) columnas from hechos h join lecturas l using (id_lectura)) select * from c where columnas <> ''""")
def load_conflicts(spark, d):
    """Readings loaded before whose values have changed: names of the fields only."""
    return M.load_conflicts(R.facts(spark, d, "id_sesion", "hr_valor", "spo2_valor", "mov_valor"), R.readings(spark, d), "id_lectura", ["id_sesion", "hr_valor", "spo2_valor", "mov_valor"])


@query(R.with_("hechos") + """, n as (select id_lectura, count(*) k from candidata_de_carga group by 1) select id_lectura, 'existe' motivo from n where id_lectura in (select id_lectura from hechos) union all select id_lectura, 'repetida' from n where k > 1""")
def append_anomalies(spark, d):
    """Why the candidates can't simply be appended to the facts."""
    return M.append_anomalies(table(spark, d, "fact_lectura_biometrica"), table(spark, d, "candidata_de_carga"), "id_lectura")


@query("select count(distinct id_lectura) cargadas from fact_lectura_biometrica where id_lectura in (select id_lectura from lectura_resumen)")
def verify_loaded(spark, d):
    """Facts of the keys of the source."""
    f = table(spark, d, "fact_lectura_biometrica").join(table(spark, d, "lectura_resumen").select("id_lectura"), "id_lectura", "left_semi")
    return f.agg(F.countDistinct("id_lectura").alias("cargadas"))


@query("""with c as (select event_id, user_id clave, sha256(event_type) huella, user_id % 9 > 0 contestada from events),
p as (select clave, min((event_id, huella)) primera from c group by 1)
select c.event_id, c.clave, c.huella, c.contestada, case when c.event_id = primera[1] then 'nueva' when not c.contestada then 'incompleta' when c.huella = primera[2] then 'repeticion' else 'colision' end resultado from c join p using (clave)""")
def idempotent_claims(spark, d):
    """The first claim of a key wins; the same content again is a replay, other content a collision; without an answer of the first there is neither."""
    claims = table(spark, d, "events").select("event_id", F.col("user_id").alias("clave"), F.sha2("event_type", 256).alias("huella"), (F.col("user_id") % 9 > 0).alias("contestada"))
    return M.claim_outcomes(claims, ["clave"], "huella", ["event_id"], "contestada")


QUERIES, SQL = query.QUERIES, query.SQL
