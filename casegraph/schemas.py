"""Explicit schemas, as DDL, of the tables and of the nested documents, with the labels that forms print."""

from __future__ import annotations

STATUS = "case_id string, document_id string, stage string, attempt_count int, last_updated string, error_detail string"
EXTRACTION_ROW = "case_id string, document_id string, extracted_at string, processing_seconds double, payload string"
EVALUATION_ROW = "case_id string, evaluated_at string, payload string"

OCR_RESULT = (
    "case_id string, document_id string, source_file string, "
    "extraction struct<file_type: string, extracted_text: string, page_count: int, pages_via_text_layer: int, pages_via_vlm: int, "
    "orientation_corrections: map<string,string>, acroform_fields: map<string,string>, xfa_fields: map<string,string>>, "
    "classification struct<document_type: string, generation: string, confidence: double, raw_response: string>, "
    "field_extraction struct<fields: map<string,string>, raw_response: string>, "
    "processing_seconds double, model_name string, extracted_at string"
)
RESULT_FILE = f"case_id string, document_id string, ok boolean, error_detail string, result struct<{OCR_RESULT}>"

STAGES = ("RECEIVED", "OCR_DONE", "FAILED")
CASE_STATUSES = ("RECEIVED", "OCR_DONE", "RULES_EVALUATED", "RENDERED", "FAILED")

# Attributes of the three document kinds, in order, with their printed labels.
SOLICITUD = {
    "tipo_anexo": "Tipo de Anexo",
    "nombre_solicitante": "Nombre del solicitante",
    "apellido_padre": "Apellido del padre",
    "apellido_madre": "Apellido de la madre",
    "nacionalidad": "Nacionalidad",
    "estado_civil": "Estado Civil",
    "numero_id": "Numero de ID",
    "domicilio": "Domicilio",
    "provincia": "Provincia",
    "pais": "País",
    "telf_contacto": "Telf. Contacto",
    "email": "E-mail",
    "nacionalidad_origen_progenitor": "Nacionalidad de origen del progenitor",
    "lugar_presentacion": "Lugar de presentación",
    "fecha_presentacion": "Fecha de presentación",
    "op_vecindad": "Op. Vecindad",
    "firma": "Firma",
    "tomo": "Tomo",
    "folio": "Folio",
    "fecha_ejercicio_opcion": "Fecha de ejercicio de la opción",
    "registro_civil_inscripcion": "Inscrito/a en el Registro Civil de",
}
IDENTIDAD = {
    "tipo_id": "Tipo de ID",
    "numero_id": "Número de ID",
    "apellidos": "Apellidos",
    "nombres": "Nombres",
    "nacionalidad": "Nacionalidad",
    "sexo": "Sexo",
    "fecha_nacimiento": "Fecha de nacimiento",
    "fecha_emision": "Fecha de emisión",
    "fecha_vencimiento": "Fecha de vencimiento",
}
CERTIFICADO = {
    "grado_certificado": "grado_certificado",
    "nombre": "Nombre G_X",
    "fecha_nacimiento": "Fecha de nacimiento G_X",
    "sexo": "sexo G_X",
    "lugar_inscripcion": "Lugar de inscripción G_X",
    "fecha_inscripcion": "Fecha de Inscripción G_X",
    "progenitor1_nombre": "Nombre progenitor 1 G_X",
    "progenitor1_num_doc": "Nº Documento progenitor 1 G_X",
    "progenitor1_nacionalidad": "Nacionalidad progenitor 1 G_X",
    "progenitor2_nombre": "Nombre progenitor 2 G_X",
    "progenitor2_num_doc": "Nº Documento progenitor 2 G_X",
    "progenitor2_nacionalidad": "Nacionalidad progenitor 2 G_X",
    "apostillado": "Apostillado G_X",
}
BOOLEANS = {"firma", "apostillado"}

# Which attribute a form template's numbered field holds.
ANEXO_III_IV = {
    "Textfield": "nombre_solicitante",
    "Textfield-0": "apellido_padre",
    "Textfield-1": "apellido_madre",
    "Textfield-2": "nacionalidad",
    "Textfield-3": "estado_civil",
    "Textfield-4": "numero_id",
    "Textfield-5": "domicilio",
    "Textfield-6": "provincia",
    "Textfield-7": "pais",
    "Textfield-8": "telf_contacto",
    "Textfield-9": "email",
    "Textfield-10": "registro_civil_inscripcion",
    "Textfield-11": "tomo",
    "Textfield-12": "folio",
    "Textfield-13": "fecha_ejercicio_opcion",
}
ANEXO_I = {
    "Textfieldad": "registro_civil_inscripcion",
    "Textfield": "nombre_solicitante",
    "Textfield-0": "apellido_padre",
    "Textfield-1": "apellido_madre",
    "Textfield-2": "nacionalidad",
    "Textfield-3": "estado_civil",
    "Textfield-4": "numero_id",
    "Textfield-3a": "domicilio",
    "Textfield-5": "provincia",
    "Textfield-6": "pais",
    "Textfield-7": "telf_contacto",
    "Textfield-8": "email",
    "Textfield-9": "nacionalidad_origen_progenitor",
}
FORM_MAPS = {"ANEXO_I": ANEXO_I, "ANEXO_III_IV": ANEXO_III_IV}


def struct_ddl(attributes: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{a}: {'boolean' if a in BOOLEANS else 'string'}" for a in attributes) + ">"
