import json
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from telar.functions.delivery import DELIVERED, FAILED, PENDING, REJECTED, RETRY, RETRY_AND_STOP, SENT
from telar.sources import packages
from telar.streaming import incremental, processors
from telar.streaming.machine import Package, Policy, admit, claim, inherited_exhaustion, lease_expired, result

P = Policy(base_ms=1000, cap_ms=60_000, attempts=3, lease_ms=70_000)
#: Short leases, so that a timer fires while a test waits.
SHORT = Policy(base_ms=1000, cap_ms=60_000, attempts=3, lease_ms=500)


def test_a_package_from_capture_to_delivery():
    p, what = claim(Package(), 0, P)
    assert what == "RECLAMADO" and p.attempts == 1 and p.lease_until == 70_000
    assert claim(p, 1, P)[1] == "ARRENDADO"
    p, what = result(p, 1, RETRY, 10, P)
    assert (what, p.state, p.retryable, p.next_at) == ("REPROGRAMADO", FAILED, True, 1010)
    assert claim(p, 1009, P)[1] == "AUN_NO"
    p, _ = claim(p, 1010, P)
    p, what = result(p, 2, DELIVERED, 1020, P)
    assert (what, p.state) == ("ENTREGADO", SENT) and claim(p, 9999, P)[1] == "TERMINAL"


def test_waits_double_up_to_the_cap():
    assert [Policy().wait(k) for k in (1, 2, 3, 4, 7, 500)] == [1000, 2000, 4000, 8000, 60_000, 60_000]


def test_failures():
    p, _ = claim(Package(), 0, P)
    assert result(p, 1, REJECTED, 5, P)[0].reason == "RECHAZO"
    stopped, what = result(p, 1, RETRY_AND_STOP, 5, P)
    assert what == "SIN_PROGRAMAR" and stopped.next_at is None and claim(stopped, 6, P)[1] == "RECLAMADO"
    for t in (0, 100_000, 200_000):
        p, _ = (p, "") if p.lease_until else claim(p, t, P)
        p, what = result(p, p.attempts, RETRY, t + 1, P)
    assert what == "AGOTADO" and p.retryable is False and claim(p, 10**9, P)[1] == "TERMINAL"
    assert result(p, 9, RETRY, 1, P)[1] == "DESCONOCIDO"
    with pytest.raises(ValueError):
        result(claim(Package(), 0, P)[0], 1, "?", 1, P)


def test_abandoned_and_late():
    p, _ = claim(Package(), 0, P)
    assert lease_expired(p, 69_999, P)[1] == "VIGENTE"
    sealed, what = lease_expired(p, 70_000, P)
    assert what == "ABANDONADO_REPROGRAMADO" and sealed.lease_until is None and sealed.next_at == 71_000
    assert result(sealed, 1, RETRY, 70_001, P) == (sealed, "TARDIO")
    late, what = result(sealed, 1, DELIVERED, 70_001, P)
    assert what == "ENTREGADO_TARDE" and late.state == SENT and result(late, 1, DELIVERED, 70_002, P)[1] == "TARDIO"
    assert inherited_exhaustion(Package(attempts=3), P).reason == "AGOTAMIENTO_HEREDADO" and inherited_exhaustion(late, P) == late


def test_an_abandoned_attempt_of_a_settled_package_changes_only_itself():
    p, _ = claim(lease_expired(claim(Package(), 0, P)[0], 70_000, P)[0], 71_000, P)
    sent, what = result(p, 1, DELIVERED, 71_500, P)  # late, while the second is open
    assert what == "ENTREGADO_TARDE" and sent.lease_until is not None
    assert result(sent, 2, RETRY, 71_600, P)[1] == "YA_ENTREGADO"
    done, what = lease_expired(sent, 10**6, P)
    assert what == "ABANDONADO_YA_ENTREGADO" and done.state == SENT and done.lease_until is None and done.attempts == 2
    closed = Package(FAILED, False, 2, 50, None, "RECHAZO")
    assert lease_expired(closed, 60, P) == (Package(FAILED, False, 2, None, None, "RECHAZO"), "ABANDONADO_CERRADO")
    assert lease_expired(p, 10**6, P, attempt=1) == (p, "ABANDONADO_SUPERADO")
    assert lease_expired(Package(PENDING, None, 3, 50), 60, P)[1] == "ABANDONADO_AGOTADO"


def test_rate_limit_ignores_refused_requests():
    accepted, seen = [], []
    for t in (0, 1, 2, 3, 1000, 1001, 1002):
        accepted, ok = admit(accepted, t, 2, 1000)
        seen.append(ok)
    assert seen == [True, True, False, False, True, True, False]


def run(spark, tmp_path, schema, batches, build, timers=False):
    """The stream's rows. One with timers never ends by itself, so it is stopped once its input is through and a timer may have fired."""
    spark.conf.set(*processors.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    out = str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    try:
        for i, rows in enumerate(batches):
            (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
            writer = build(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
            if not timers:
                q = writer.trigger(availableNow=True).start()
                assert q.awaitTermination(60) and q.exception() is None
                continue
            q = writer.trigger(processingTime="200 milliseconds").start()
            end = time.time() + 40
            while q.isActive and time.time() < end and sum(p.numInputRows for p in q.recentProgress) < len(rows):
                time.sleep(0.2)
            time.sleep(3)
            q.stop()
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark.read.parquet(out)


QUEUE = "id_outbox long, llegada long, t long, evento string, intento int"


def test_claims_stream(spark, tmp_path):
    c = lambda clave, huella, llegada, recurso="r", contestada=True: {"recurso": recurso, "clave": clave, "huella": huella, "llegada": llegada, "contestada": contestada}
    batches = [[c("a", "x", 2), c("a", "y", 1), c("b", "x", 3), c("a", "x", 7, "otro")], [c("a", "y", 4), c("b", "z", 5), c(None, "x", 6), c("c", "x", 8, contestada=False), c("c", "x", 9), c("c", "y", 10)]]
    got = run(spark, tmp_path, "recurso string, clave string, huella string, llegada long, contestada boolean", batches, processors.ingest_claims).collect()
    assert {r.llegada: (r.resultado, r.primera) for r in got} == {1: ("NUEVA", 1), 2: ("COLISION", 1), 3: ("NUEVA", 3), 4: ("REPETICION", 1), 5: ("COLISION", 3), 6: ("NUEVA", 6), 7: ("NUEVA", 7), 8: ("NUEVA", 8), 9: ("INCOMPLETA", 8), 10: ("INCOMPLETA", 8)}


def test_queue_stream(spark, tmp_path):
    e = lambda i, t, evento, intento=None: {"id_outbox": 1, "llegada": i, "t": t, "evento": evento, "intento": intento}
    batches = [[e(1, 0, "CAPTURA"), e(2, 10, "RECLAMO"), e(3, 20, RETRY, 1)], [e(5, 1020, "RECLAMO"), e(4, 500, "RECLAMO"), e(6, 100_000, "VENCIMIENTO")], [e(7, 100_001, DELIVERED, 2)]]
    got = run(spark, tmp_path, QUEUE, batches, lambda s: processors.queue_machine(s, SHORT), timers=True).orderBy("llegada").collect()
    assert [r.efecto for r in got if r.llegada] == ["CAPTURADO", "RECLAMADO", "REPROGRAMADO", "AUN_NO", "RECLAMADO", "ABANDONADO_REPROGRAMADO", "ENTREGADO_TARDE"]
    assert got[-1].estado == SENT


def test_a_timer_seals_an_abandoned_attempt(spark, tmp_path):
    now = int(time.time() * 1000)
    e = lambda i, evento: {"id_outbox": 1, "llegada": i, "t": now, "evento": evento, "intento": None}
    got = run(spark, tmp_path, QUEUE, [[e(1, "CAPTURA"), e(2, "RECLAMO")]], lambda s: processors.queue_machine(s, SHORT), timers=True).orderBy("t").collect()
    assert [(r.efecto, r.estado) for r in got if r.llegada is None][:2] == [("ABANDONADO_REPROGRAMADO", FAILED), ("LISTO", FAILED)]


def test_rate_limit_stream(spark, tmp_path):
    batches = [[{"origen": "a", "llegada": i, "t": t} for i, t in enumerate((0, 1, 2))], [{"origen": "a", "llegada": 3 + i, "t": t} for i, t in enumerate((500, 1001))]]
    got = run(spark, tmp_path, "origen string, llegada long, t long", batches, lambda s: processors.rate_limit(s, 2, 1000)).collect()
    assert {r.llegada: r.aceptada for r in got} == {0: True, 1: True, 2: False, 3: False, 4: True}


def test_rate_limit_of_all_origins(spark, tmp_path):
    batches = [[{"origen": o, "llegada": i, "t": t} for i, (o, t) in enumerate((("a", 0), ("a", 1), ("b", 2), (None, 3), ("c", 4)))], [{"origen": o, "llegada": 5 + i, "t": t} for i, (o, t) in enumerate((("c", 999), ("c", 1000), ("a", 1001), ("b", 1002)))]]
    got = run(spark, tmp_path, "origen string, llegada long, t long", batches, lambda s: processors.rate_limit(s, 1, 1000, total=3)).collect()
    assert {r.llegada: (r.origen, r.aceptada) for r in got} == {0: ("a", True), 1: ("a", False), 2: ("b", True), 3: (None, True), 4: ("c", False), 5: ("c", False), 6: ("c", True), 7: ("a", False), 8: ("b", True)}


PACKAGE = "estado string, reintentable boolean, intentos int, arriendo long, proximo long, motivo string"


def test_wakeup_over_schedule_lease_and_pause(spark):
    at = lambda rows, pause=None: processors.next_wakeup(spark.createDataFrame(rows, PACKAGE), 100, pause, P).first().despertar
    scheduled, leased, due, sent = (FAILED, True, 1, None, 300, None), (FAILED, True, 1, 200, None, None), (PENDING, None, 0, None, None, None), (SENT, None, 1, None, 110, None)
    assert at([scheduled, sent]) == 300 and at([scheduled, leased]) == 200 and at([scheduled, leased], 150) == 200
    assert at([scheduled, leased, due], 150) == 150 and at([due]) is None and at([sent], 150) is None and at([]) is None


def test_inherited_packages_are_closed(spark):
    rows = [(FAILED, True, P.attempts, None, 5, "x"), (PENDING, None, P.attempts + 1, None, None, None), (PENDING, None, P.attempts, 9, None, None), (PENDING, None, 0, None, 7, None), (SENT, None, P.attempts, None, None, None), (FAILED, False, P.attempts, None, None, "RECHAZO")]
    got = processors.close_inherited(spark.createDataFrame(rows, PACKAGE), P).collect()
    assert [Package(*r) for r in got] == [inherited_exhaustion(Package(*r), P) for r in rows] and sum(r.motivo == "AGOTAMIENTO_HEREDADO" for r in got) == 2


def test_incremental_stream_by_difference_of_keys(spark, tmp_path):
    facts = str(tmp_path / "facts")
    (tmp_path / "in").mkdir()
    total = []
    for i, rows in enumerate(([(5, 1), (6, 2), (5, 3)], [(1, 9), (5, 9), (None, 9)])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"id": a, "v": b}) for a, b in rows))
        stream = spark.readStream.schema("id long, v long").json(str(tmp_path / "in"))
        incremental.start(stream, facts, str(tmp_path / "cp"), "id", "v").awaitTermination(60)
        total.append(sorted((r.id, r.v) for r in spark.read.parquet(facts).collect()))
    assert total == [[(5, 3), (6, 2)], [(1, 9), (5, 3), (6, 2)]]
    batch = spark.createDataFrame([(2, 1), (5, 1), (8, 1), (9, 1)], "id long, v long")
    assert incremental.load_new(batch, facts, "id", "v", up_to=8) == 2 and incremental.load_new(batch, facts, "id", "v") == 1
    assert incremental.load_new(batch.limit(0), facts, "id", "v") == 0 and spark.read.parquet(facts).count() == 6


def package(**changes):
    p = {"id_embarazo": 1, "id_dispositivo": 2, "tipo_sesion": "SIGNOS_MATERNOS", "fecha_inicio": "2025-01-01T10:00:00-05:00", "fecha_fin": "2025-01-01T10:30:00-05:00", "lecturas": [{"id_tiempo_gest": 1, "id_semaforo": 1, "fecha_hora_captura": "2025-01-01T15:01:00.5Z", "fecha_hora_sincronizacion": None, "hr_valor": 80, "spo2_valor": 97.5, "mov_valor": None}]}
    return p | changes


def test_packages(spark):
    base = package()
    bad = {
        "forma": package(lecturas=[{**base["lecturas"][0], "mov_valor": 3}]),
        "tipo": package(tipo_sesion="MOVIMIENTOS_FETALES"),
        "orden_de_lectura": package(lecturas=[{**base["lecturas"][0], "fecha_hora_sincronizacion": "2025-01-01T15:00:00Z"}]),
        "fuera_de_sesion": package(lecturas=[{**base["lecturas"][0], "fecha_hora_captura": "2025-01-01T16:01:00Z"}]),
        "fin_antes_de_inicio": package(fecha_fin="2025-01-01T09:00:00-05:00", lecturas=[]),
        "completa_sin_fin": package(estado_sesion="COMPLETADA", fecha_fin=None),
        "sin_lecturas": package(lecturas=[]),
    }
    same = [package(), package(fecha_inicio="2025-01-01T15:00:00Z", estado_sesion="PENDIENTE", origen_dato="DISPOSITIVO"), dict(reversed(package().items()))]
    rows = [("ok", json.dumps(base)), ("no", "{nada"), ("nulo", None), *[(k, json.dumps(v)) for k, v in bad.items()], *[(f"igual{i}", json.dumps(v)) for i, v in enumerate(same)], ("otro", json.dumps(package(id_embarazo=2)))]
    df = packages.parse(spark.createDataFrame(rows, "clave string, payload string"))
    found = {}
    for r in packages.faults(df, "clave").collect():
        found.setdefault(r.clave, set()).add(r.regla)
    assert {k for k in found if not k.startswith("n")} == set(bad) and all(k in found[k] for k in bad) and "ilegible" in found["no"] and "ilegible" in found["nulo"]
    text = {r.clave: r.t for r in df.select("clave", packages.canonical().alias("t")).collect()}
    assert text["ok"] == '{"estado_sesion":"PENDIENTE","fecha_fin":"2025-01-01T15:30:00+00:00","fecha_inicio":"2025-01-01T15:00:00+00:00","id_dispositivo":2,"id_embarazo":1,"lecturas":[{"fecha_hora_captura":"2025-01-01T15:01:00.500000+00:00","fecha_hora_sincronizacion":null,"hr_valor":"80.00","id_semaforo":1,"id_tiempo_gest":1,"mov_valor":null,"spo2_valor":"97.50"}],"origen_dato":"DISPOSITIVO","tipo_sesion":"SIGNOS_MATERNOS"}'
    assert text["igual0"] == text["igual1"] == text["igual2"] == text["ok"] != text["otro"]
    assert packages.readings_of(df.filter("clave = 'ok'"), "clave").count() == 1


def test_sqlite_source(spark, tmp_path):
    from telar.sources.sqlite import SqliteSource

    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute("create table cola (id integer primary key, texto text, v real)")
        c.executemany("insert into cola values (?, ?, ?)", [(i, f"t{i}" if i % 3 else None, i / 2) for i in range(1, 101)])
    c.close()
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite_ro").option("path", path).option("table", "cola").option("partitions", 4).load()
    assert df.count() == 100 and df.filter("texto is null").count() == 33 and df.agg(F.sum("v")).first()[0] == 2525.0
    assert df.rdd.getNumPartitions() == 4
    with pytest.raises(Exception):
        spark.read.format("sqlite_ro").option("path", path + "x").option("table", "cola").load().count()
