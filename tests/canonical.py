"""The canonical dataset as its description gives it: counts are fixed, values are not."""

from __future__ import annotations

import datetime as dt

DAY = dt.timedelta(days=1)


def build() -> dict:
    d0 = dt.date(2025, 1, 6)
    ids = range(100, 130)
    doc: dict = {
        "metadata": {"nombre": "canonico", "semilla": 20260810, "total_sesiones": 732, "total_registros_biometricos": 1180, "uso": "ficticio"},
        "especialidades": [{"id_especialidad": 100, "nombre_especialidad": "Obstetricia"}],
        "factores_riesgo": [{"id_factor_riesgo": 100 + i, "clave_factor": k, "nombre_factor": k, "descripcion": None, "activo": True} for i, k in enumerate(("HTA", "DMG", "OBS"))],
        "tiempo_gestacional": [{"id_tiempo_gest": 99 + w, "semana_gestacion": w, "mes_gestacion": min(9, (w - 1) // 4 + 1), "trimestre": 1 if w <= 13 else 2 if w <= 27 else 3, "grupo_clinico": "g", "descripcion": None} for w in range(1, 41)],
        "semaforos": [{"id_semaforo": 100 + i, "codigo_nivel": c, "etiqueta_visual": c, "color_hex": "#000000", "prioridad": i + 1, "mensaje_app": c, "version_referencia": "SIM-1.0"} for i, c in enumerate(("OK", "WARNING", "ERROR"))],
        "roles": [{"id_rol": 100 + i, "nombre_rol": r} for i, r in enumerate(("ADMIN", "MEDICO", "PACIENTE"))],
        "clinicas": [{"id_clinica": 100 + i, "nombre_clinica": f"Clinica {i}", "ruc": str(i), "provincia": f"P{i}", "distrito": "d", "corregimiento": "c", "direccion_fisica": "x"} for i in range(3)],
        "pacientes": [{"id_paciente": i, "cedula": f"8-{i}", "primer_nombre": "Ana", "segundo_nombre": None, "apellido_paterno": f"A{i}", "apellido_materno": "", "email_pac": f"p{i}@x.invalid", "fecha_nac": "1995-02-28"} for i in ids],
        "medicos": [{"id_medico": 100 + i, "id_especialidad": 100, "primer_nombre": "Luz", "segundo_nombre": "M", "apellido_paterno": f"B{i}", "apellido_materno": None, "email_med": f"m{i}@x.invalid"} for i in range(5)],
        "dispositivos": [{"id_dispositivo": i, "id_clinica": 100 + i % 3, "codigo_dispositivo": f"D{i}", "modelo": "m", "version_firmware": "1", "estado": "ACTIVO", "fecha_registro": "2025-01-01T00:00:00Z"} for i in ids],
        "usuarios": [{"id_usuario": 100 + i, "id_rol": 100 if i < 2 else 101 if i < 7 else 102, "email": f"u{i}@x.invalid", "password_hash": "x", "activo": True} for i in range(37)],
        "telefonos_paciente": [{"id_telefono_paciente": i, "id_paciente": i, "tipo_contacto": "CELULAR", "valor_contacto": f"6000-{i}", "principal": True} for i in ids] + [{"id_telefono_paciente": 200 + i, "id_paciente": 100 + i, "tipo_contacto": "CORREO_ALTERNO", "valor_contacto": f"c{i}", "principal": False} for i in range(10)],
        "telefonos_medico": [{"id_telefono_medico": 100 + i, "id_medico": 100 + i % 5, "tipo_contacto": "CELULAR" if i < 5 else "TELEFONO_DOMICILIO", "valor_contacto": f"2{i}", "principal": i < 5} for i in range(10)],
        "medico_clinica": [{"id_medico": 100 + i, "id_clinica": 100 + i % 3, "fecha_inicio": "2025-01-01", "fecha_final": None, "activo": True} for i in range(5)],
        "embarazos": [],
        "seguimiento_clinico": [],
        "embarazo_factor_riesgo": [],
        "asignacion_dispositivo": [],
        "sesiones_monitoreo": [],
        "lecturas_biometricas": [],
        "usuario_medico": [{"id_usuario": 102 + i, "id_medico": 100 + i} for i in range(5)],
        "usuario_paciente": [{"id_usuario": 107 + i, "id_paciente": 100 + i} for i in range(30)],
    }
    for n, i in enumerate(ids):
        start = d0 + 9 * n * DAY
        state = "ACTIVO" if n < 20 else "FINALIZADO" if n < 28 else "SUSPENDIDO"
        medico = 100 + n % 5
        doc["embarazos"].append({"id_embarazo": i, "id_paciente": i, "id_clinica": 100 + (n % 5) % 3, "numero_gestas": 1, "numero_partos": 0, "fecha_inicio": str(start), "fecha_probable_parto": str(start + 280 * DAY), "estado_embarazo": state, "fecha_cierre": None if n < 20 else str(start + 275 * DAY)})
        doc["seguimiento_clinico"].append({"id_seguimiento": i, "id_embarazo": i, "id_medico": medico, "fecha_asignacion": str(start), "fecha_fin": None, "rol_seguimiento": "PRINCIPAL", "activo": True})
        doc["asignacion_dispositivo"].append({"id_asignacion": i, "id_dispositivo": i, "id_embarazo": i, "fecha_inicio": str(start), "fecha_fin": None, "activo": True})
        for f in range(0 if n < 14 else 1 if n < 23 else 2):
            doc["embarazo_factor_riesgo"].append({"id_embarazo": i, "id_factor_riesgo": 100 + f, "fecha_diagnostico": str(start), "fecha_fin": None, "activo": True, "observaciones": None})
    reading = 100

    def session(n: int, kind: str, levels: list[tuple]) -> None:
        nonlocal reading
        i = 100 + n % 30
        start = d0 + 9 * (n % 30) * DAY + (140 + n // 30 * 3 % 120) * DAY
        at = dt.datetime.combine(start, dt.time(15, 0), dt.timezone.utc)
        sid = 100 + len(doc["sesiones_monitoreo"])
        doc["sesiones_monitoreo"].append({"id_sesion": sid, "id_embarazo": i, "id_dispositivo": i, "tipo_sesion": kind, "fecha_inicio": at.isoformat(), "fecha_fin": (at + dt.timedelta(minutes=30)).isoformat(), "estado_sesion": "PROCESADA", "origen_dato": "DISPOSITIVO"})
        week = (start - d0 - 9 * (n % 30) * DAY).days // 7 + 1
        for k, (level, hr, spo2, mov) in enumerate(levels):
            t = at + dt.timedelta(minutes=k)
            doc["lecturas_biometricas"].append({"id_lectura": reading, "id_sesion": sid, "id_tiempo_gest": 99 + week, "id_semaforo": 100 + ("OK", "WARNING", "ERROR").index(level), "fecha_hora_captura": t.isoformat(), "fecha_hora_sincronizacion": (t + dt.timedelta(seconds=9)).isoformat(), "hr_valor": hr, "spo2_valor": spo2, "mov_valor": mov})
            reading += 1

    # 112 vitals sessions of five readings: 78 OK, 28 WARNING and 6 ERROR; the WARNING ones are 76 by hr and 64 by spo2, the ERROR ones 12 and 18
    warned, failed = 0, 0
    for n in range(112):
        rows = []
        for k in range(5):
            if n < 78:
                rows.append(("OK", 65.0 + (n + k) % 30, 96.5, None))
            elif n < 106:
                rows.append(("WARNING", 105.25, 97.0, None) if warned < 76 else ("WARNING", 80.0, 93.0, None))
                warned += 1
            else:
                rows.append(("ERROR", 50.0, 98.0, None) if failed < 12 else ("ERROR", 80.0, 88.0, None))
                failed += 1
        session(n, "SIGNOS_MATERNOS", rows)
    for n in range(620):
        session(n, "MOVIMIENTOS_FETALES", [("OK", None, None, 10 + n % 5) if n < 436 else ("WARNING", None, None, 5 + n % 5) if n < 591 else ("ERROR", None, None, n % 5)])
    return doc
