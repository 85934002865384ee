"""Schemas of what comes in: the dataset document, monitoring packages and claims."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "short": T.ShortType(), "string": T.StringType(), "bool": T.BooleanType(), "date": T.DateType(), "ts": T.TimestampType(), "dec": T.DecimalType(5, 2), "ints": T.ArrayType(T.IntegerType())}


def struct(text: str) -> T.StructType:
    """A schema from ``name kind`` pairs; a kind with ``?`` may be null."""
    fields = []
    for pair in text.split(","):
        name, kind = pair.split()
        fields.append(T.StructField(name, _KINDS[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


# Sections of the dataset document and their columns.
SECTIONS = {
    "especialidades": struct("id_especialidad int, nombre_especialidad string"),
    "factores_riesgo": struct("id_factor_riesgo int, clave_factor string, nombre_factor string, descripcion string?, activo bool"),
    "tiempo_gestacional": struct("id_tiempo_gest int, semana_gestacion short, mes_gestacion short, trimestre short, grupo_clinico string, descripcion string?"),
    "semaforos": struct("id_semaforo int, codigo_nivel string, etiqueta_visual string, color_hex string, prioridad short, mensaje_app string, version_referencia string"),
    "roles": struct("id_rol int, nombre_rol string"),
    "clinicas": struct("id_clinica int, nombre_clinica string, ruc string, provincia string, distrito string, corregimiento string, direccion_fisica string"),
    "pacientes": struct("id_paciente int, cedula string, primer_nombre string, segundo_nombre string?, apellido_paterno string, apellido_materno string?, email_pac string, fecha_nac date"),
    "medicos": struct("id_medico int, id_especialidad int, primer_nombre string, segundo_nombre string?, apellido_paterno string, apellido_materno string?, email_med string"),
    "dispositivos": struct("id_dispositivo int, id_clinica int, codigo_dispositivo string, modelo string, version_firmware string, estado string, fecha_registro ts"),
    "usuarios": struct("id_usuario int, id_rol int, email string, password_hash string, activo bool"),
    "telefonos_paciente": struct("id_telefono_paciente int, id_paciente int, tipo_contacto string, valor_contacto string, principal bool"),
    "telefonos_medico": struct("id_telefono_medico int, id_medico int, tipo_contacto string, valor_contacto string, principal bool"),
    "medico_clinica": struct("id_medico int, id_clinica int, fecha_inicio date, fecha_final date?, activo bool"),
    "embarazos": struct("id_embarazo int, id_paciente int, id_clinica int, numero_gestas short, numero_partos short, fecha_inicio date, fecha_probable_parto date, estado_embarazo string, fecha_cierre date?"),
    "seguimiento_clinico": struct("id_seguimiento int, id_embarazo int, id_medico int, fecha_asignacion date, fecha_fin date?, rol_seguimiento string, activo bool"),
    "embarazo_factor_riesgo": struct("id_embarazo int, id_factor_riesgo int, fecha_diagnostico date, fecha_fin date?, activo bool, observaciones string?"),
    "asignacion_dispositivo": struct("id_asignacion int, id_dispositivo int, id_embarazo int, fecha_inicio date, fecha_fin date?, activo bool"),
    "sesiones_monitoreo": struct("id_sesion int, id_embarazo int, id_dispositivo int, tipo_sesion string, fecha_inicio ts, fecha_fin ts?, estado_sesion string, origen_dato string"),
    "lecturas_biometricas": struct("id_lectura int, id_sesion int, id_tiempo_gest int, id_semaforo int, fecha_hora_captura ts, fecha_hora_sincronizacion ts?, hr_valor dec?, spo2_valor dec?, mov_valor short?"),
    "usuario_medico": struct("id_usuario int, id_medico int"),
    "usuario_paciente": struct("id_usuario int, id_paciente int"),
}
KEYS = {"medico_clinica": ["id_medico", "id_clinica", "fecha_inicio"], "embarazo_factor_riesgo": ["id_embarazo", "id_factor_riesgo"], "usuario_medico": ["id_usuario"], "usuario_paciente": ["id_usuario"]}
#: (section, column, parent section, parent's key)
REFERENCES = [
    ("medicos", "id_especialidad", "especialidades", "id_especialidad"),
    ("dispositivos", "id_clinica", "clinicas", "id_clinica"),
    ("usuarios", "id_rol", "roles", "id_rol"),
    ("telefonos_paciente", "id_paciente", "pacientes", "id_paciente"),
    ("telefonos_medico", "id_medico", "medicos", "id_medico"),
    ("medico_clinica", "id_medico", "medicos", "id_medico"),
    ("medico_clinica", "id_clinica", "clinicas", "id_clinica"),
    ("embarazos", "id_paciente", "pacientes", "id_paciente"),
    ("embarazos", "id_clinica", "clinicas", "id_clinica"),
    ("seguimiento_clinico", "id_embarazo", "embarazos", "id_embarazo"),
    ("seguimiento_clinico", "id_medico", "medicos", "id_medico"),
    ("embarazo_factor_riesgo", "id_embarazo", "embarazos", "id_embarazo"),
    ("embarazo_factor_riesgo", "id_factor_riesgo", "factores_riesgo", "id_factor_riesgo"),
    ("asignacion_dispositivo", "id_dispositivo", "dispositivos", "id_dispositivo"),
    ("asignacion_dispositivo", "id_embarazo", "embarazos", "id_embarazo"),
    ("sesiones_monitoreo", "id_embarazo", "embarazos", "id_embarazo"),
    ("sesiones_monitoreo", "id_dispositivo", "dispositivos", "id_dispositivo"),
    ("lecturas_biometricas", "id_sesion", "sesiones_monitoreo", "id_sesion"),
    ("lecturas_biometricas", "id_tiempo_gest", "tiempo_gestacional", "id_tiempo_gest"),
    ("lecturas_biometricas", "id_semaforo", "semaforos", "id_semaforo"),
]


def key_of(section: str) -> list[str]:
    return KEYS.get(section, [SECTIONS[section].fieldNames()[0]])


READING_IN_PACKAGE = struct("id_tiempo_gest int?, id_semaforo int?, fecha_hora_captura string?, fecha_hora_sincronizacion string?, hr_valor dec?, spo2_valor dec?, mov_valor short?")
PACKAGE = T.StructType([*struct("id_embarazo int?, id_dispositivo int?, tipo_sesion string?, fecha_inicio string?, fecha_fin string?, estado_sesion string?, origen_dato string?").fields, T.StructField("lecturas", T.ArrayType(READING_IN_PACKAGE))])
CLAIM = struct("recurso string, clave string, huella string, id_sesion int?, ids_lectura ints?, fecha_hora ts")
