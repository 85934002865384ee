"""The delivery queue as snapshots: census, eligibility, traces and rate limits.

The events table stands for the attempts: an event is an attempt of its user's package,
of an outcome that depends on its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.functions import delivery
from telar.functions.timeutil import local_micros
from telar.operators.ranking import numbered
from telar.queries.registry import Registry
from telar.session import table

query = Registry()

_NOW = 1_706_616_000_000_000
_LIMIT = 70
#: A pause after rejected credentials, which holds back what could be sent now.
_PAUSE = _NOW + 30_000_000
_LEASE_US = int(delivery.lease_seconds() * 1_000_000)

_QUEUE = f"""with cola as (select user_id id_outbox, count(*) intentos, max(epoch_us(ts)) ultimo, arg_max(event_type, (ts, event_id)) ultimo_tipo, bool_or(event_type = 'purchase' and user_id % 3 = 0) enviado, bool_or(event_type = 'signup' and user_id % 5 = 0) rechazado from events group by 1),
q as (select id_outbox, intentos, ultimo, case when enviado then 'ENVIADO' when rechazado or user_fallido then 'FALLIDO' else 'PENDIENTE' end estado, case when enviado then null when rechazado then false when user_fallido then true end reintentable,
 case when id_outbox % 10 = 0 then 60 else {_LIMIT} end limite, case when ultimo_tipo = 'click' then ultimo + {_LEASE_US} end arriendo,
 ultimo + cast(least(60, power(2, least(intentos - 1, 62))) * 1000000 as bigint) proximo from (select *, id_outbox % 7 = 0 user_fallido from cola)),
c as (select *, not (estado = 'ENVIADO' or (estado = 'FALLIDO' and not coalesce(reintentable, false))) viva, viva and intentos < limite and arriendo is null puede, puede and proximo <= {_NOW} elegible, puede and proximo > {_NOW} programada from q) """


def queue(spark, d) -> DataFrame:
    """One row per package: id_outbox, intentos, limite, ultimo, estado, reintentable, proximo and arriendo (end of the open attempt's lease), in microseconds."""
    own = table(spark, d, "events").groupBy(F.col("user_id").alias("id_outbox")).agg(
        F.count("*").alias("intentos"),
        F.max(local_micros("ts")).alias("ultimo"),
        F.max(F.struct("ts", "event_id", "event_type")).alias("x"),
        F.bool_or((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0)).alias("enviado"),
        F.bool_or((F.col("event_type") == "signup") & (F.col("user_id") % 5 == 0)).alias("rechazado"),
    )
    failed = F.col("id_outbox") % 7 == 0
    state = F.when(F.col("enviado"), delivery.SENT).when(F.col("rechazado") | failed, delivery.FAILED).otherwise(delivery.PENDING)
    again = F.when(F.col("enviado"), None).when(F.col("rechazado"), False).when(failed, True)
    lease = F.when(F.col("x.event_type") == "click", F.col("ultimo") + _LEASE_US)
    limit = F.when(F.col("id_outbox") % 10 == 0, 60).otherwise(_LIMIT)
    return own.select("id_outbox", "intentos", limit.alias("limite"), "ultimo", state.alias("estado"), again.alias("reintentable"), (F.col("ultimo") + (delivery.backoff(F.col("intentos")) * 1_000_000).cast("long")).alias("proximo"), lease.alias("arriendo"))


def _eligible(scheduled: bool = True):
    c = F.col
    return delivery.eligible(c("estado"), c("reintentable"), c("intentos"), c("limite"), c("proximo"), F.lit(_NOW), c("arriendo").isNotNull(), scheduled)


@query(_QUEUE + """select count(*) total, count(*) filter (elegible) elegibles, count(*) filter (programada) programados, min(case when programada then proximo end) proximo_programado, count(*) filter (viva and arriendo is not null) con_intento_abierto, min(case when viva then arriendo end) proximo_reconciliable,
count(*) filter (estado = 'ENVIADO') enviados, count(*) filter (estado = 'FALLIDO' and not reintentable) revision, count(*) filter (viva and intentos >= limite) bloqueados, min(case when elegible then id_outbox end) primero from c""")
def queue_census(spark, d):
    """All counters of the queue from one scan, so that they agree with each other."""
    c = F.col
    alive, may, waits = ~delivery.terminal(c("estado"), c("reintentable")), _eligible(), _eligible(False) & (c("proximo") > _NOW)
    return queue(spark, d).agg(
        F.count("*").alias("total"),
        F.count_if(may).alias("elegibles"),
        F.count_if(waits).alias("programados"),
        F.min(F.when(waits, c("proximo"))).alias("proximo_programado"),
        F.count_if(alive & c("arriendo").isNotNull()).alias("con_intento_abierto"),
        F.min(F.when(alive, c("arriendo"))).alias("proximo_reconciliable"),
        F.count_if(c("estado") == delivery.SENT).alias("enviados"),
        F.count_if((c("estado") == delivery.FAILED) & ~c("reintentable")).alias("revision"),
        F.count_if(alive & (c("intentos") >= c("limite"))).alias("bloqueados"),
        F.min(F.when(may, c("id_outbox"))).alias("primero"),
    )


@query(_QUEUE + "select estado, reintentable, count(*) n from q group by 1, 2")
def queue_summary(spark, d):
    return queue(spark, d).groupBy("estado", "reintentable").agg(F.count("*").alias("n"))


@query(_QUEUE + "select id_outbox, intentos from c where elegible")
def queue_eligible(spark, d):
    """Packages that may be sent at a given moment: alive, attempts left, none open, schedule due."""
    return queue(spark, d).filter(_eligible()).select("id_outbox", "intentos")


@query(_QUEUE + "select id_outbox, proximo from c where puede")
def queue_forced(spark, d):
    """Packages that a person may send now, whatever their schedule."""
    return queue(spark, d).filter(_eligible(False)).select("id_outbox", "proximo")


@query(_QUEUE + f"select least(min(case when programada then proximo end), min(case when viva then arriendo end), case when count(*) filter (elegible) > 0 then {_PAUSE} end) despertar from c")
def next_wakeup(spark, d):
    """The earliest of schedules, lease ends and the pause, which counts only if it holds back a package."""
    alive, waits = ~delivery.terminal(F.col("estado"), F.col("reintentable")), _eligible(False) & (F.col("proximo") > _NOW)
    return queue(spark, d).agg(F.least(F.min(F.when(waits, F.col("proximo"))), F.min(F.when(alive, F.col("arriendo"))), F.when(F.count_if(_eligible()) > 0, F.lit(_PAUSE))).alias("despertar"))


@query("""select user_id, row_number() over (partition by user_id order by ts, event_id) numero, epoch_us(ts) t, event_type, event_type = 'purchase' confirmo from events""")
def attempt_trace(spark, d):
    """All attempts of each package in order."""
    number = numbered(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], "numero")
    return number.select("user_id", "numero", local_micros("ts").alias("t"), "event_type", (F.col("event_type") == "purchase").alias("confirmo"))


@query("""select user_id, max(case when event_type = 'purchase' then epoch_us(ts) end) confirmado, max(epoch_us(ts)) ultimo, count(*) filter (event_type = 'error') errores from events group by 1""")
def confirmation_instant(spark, d):
    t = local_micros("ts")
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", t)).alias("confirmado"), F.max(t).alias("ultimo"), F.count_if(F.col("event_type") == "error").alias("errores"))


@query("select e.event_id, q.estado, e.props from (select user_id id_outbox, case when max(case when event_type = 'purchase' then 1 else 0 end) = 1 then 'ENVIADO' else 'PENDIENTE' end estado, max(event_id) event_id from events group by 1) q join events e using (event_id)")
def queue_payload(spark, d):
    """Each package's last captured content."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("event_id", "props")).alias("x"), F.max((F.col("event_type") == "purchase").cast("int")).alias("p"))
    return last.select(F.col("x.event_id").alias("event_id"), F.when(F.col("p") == 1, delivery.SENT).otherwise(delivery.PENDING).alias("estado"), F.col("x.props").alias("props"))


QUERIES, SQL = query.QUERIES, query.SQL
