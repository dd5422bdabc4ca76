"""Rule parameters: frozen, validated, read from YAML or a mapping."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

DOCUMENT_TYPES = ("APPLICATION", "ID_DOCUMENT", "BIRTH_CERT", "OTHER", "EMPTY")
GENERATIONS = ("G1", "G2", "G3")
ROLES = {"G1": "Solicitante", "G2": "Progenitor", "G3": "Abuelo/a"}


@dataclass(frozen=True)
class Band:
    min_years: int
    max_years: int

    def __post_init__(self):
        if not 0 <= self.min_years <= self.max_years:
            raise ValueError(f"no band of years: {self.min_years} to {self.max_years}")


@dataclass(frozen=True)
class GapBands:
    typical: Band = Band(20, 35)
    hard: Band = Band(14, 60)


@dataclass(frozen=True)
class EntityResolution:
    min_criteria: int = 2
    total_criteria: int = 3
    dob_tolerance_years: int = 1

    def __post_init__(self):
        if not 1 <= self.min_criteria <= self.total_criteria or self.dob_tolerance_years < 0:
            raise ValueError("entity resolution needs 1 to total_criteria criteria and no negative tolerance")


@dataclass(frozen=True)
class Expected:
    label: str
    document_type: str
    generation: str | None = None

    def __post_init__(self):
        if not self.label or self.document_type not in DOCUMENT_TYPES or self.generation not in (None, *GENERATIONS):
            raise ValueError(f"no checklist entry: {self}")


@dataclass(frozen=True)
class Severity:
    # The severities of the flags.
    rojo: tuple[str, ...] = (
        "DOCUMENTO_VENCIDO", "NOMBRE_AMBIGUO", "NOMBRE_INCONSISTENTE", "ID_INCONSISTENTE", "DOCUMENTO_CRUZADO", "FECHA_CONFLICTO", "BRECHA_GENERACIONAL",
    )
    amarillo: tuple[str, ...] = ("DOCUMENT_INCOMPLETE", "NACIONALIDAD_INCONSISTENTE", "FECHA_PRESENTACION_FALTANTE", "GENERACION_INFERIDA_BAJA_CONFIANZA")

    def __post_init__(self):
        if set(self.rojo) & set(self.amarillo):
            raise ValueError("a flag has two severities")


# The checklist, in order.
CHECKLIST = (
    Expected("Solicitud Principal", "APPLICATION"),
    Expected("Identificación del Solicitante", "ID_DOCUMENT"),
    Expected("Certificado de Nacimiento del Solicitante", "BIRTH_CERT", "G1"),
    Expected("Certificado de Nacimiento del Progenitor", "BIRTH_CERT", "G2"),
    Expected("Certificado de Nacimiento Español de origen", "BIRTH_CERT", "G3"),
)


@dataclass(frozen=True)
class Rules:
    gap_bands: GapBands = GapBands()
    entity_resolution: EntityResolution = EntityResolution()
    document_validity_months_past_application: int = 6
    expected_documents: tuple[Expected, ...] = CHECKLIST
    severity: Severity = field(default_factory=Severity)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> Rules:
        """Rules with what `values` holds in place of the defaults; unknown top-level keys are errors."""
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown rule parameters: {sorted(unknown)}")
        return _filled(cls(), values)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Rules:
        """Rules of a YAML file; an empty one is an error."""
        import yaml

        values = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        if not isinstance(values, Mapping):
            raise ValueError(f"{path} holds no mapping of rule parameters")
        return cls.from_mapping(values)


def _filled(default, values: Mapping[str, Any]):
    new: dict[str, Any] = {}
    for f in fields(default):
        own = getattr(default, f.name)
        if f.name not in values:
            new[f.name] = own
        elif is_dataclass(own):
            new[f.name] = _filled(own, values[f.name] or {})
        elif f.name == "expected_documents":
            new[f.name] = tuple(Expected(**x) for x in values[f.name])
        elif isinstance(own, tuple):
            new[f.name] = tuple(values[f.name])
        else:
            new[f.name] = values[f.name]
    return type(default)(**new)


@dataclass(frozen=True)
class Settings:
    """Settings of a service over the engine."""

    spool_dir: str = "spool"
    upload_dir: str = "uploads"
    max_running: int = 3
    timeout_seconds: int = 1800
    grace_seconds: int = 120
    model_url: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "CASEGRAPH_") -> Settings:
        """Settings of environment variables; numbers are positive, the model's address is http(s) and ends in /v1."""
        new: dict[str, Any] = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "").strip()
            if not raw:
                continue
            if f.type == "int":
                if not raw.isdigit() or int(raw) < 1:
                    raise ValueError(f"{prefix}{f.name.upper()} is no positive number: {raw!r}")
                new[f.name] = int(raw)
            else:
                new[f.name] = raw
        url = new.get("model_url")
        if url and not (url.startswith(("http://", "https://")) and url.rstrip("/").endswith("/v1")):
            raise ValueError(f"no model address: {url!r}")
        return cls(**new)
