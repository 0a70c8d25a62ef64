"""What to compare: the two sides, their keys, and the fields paired between them."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

# Accepted declared type names and the family each belongs to.
TYPE_FAMILY = {
    "STRING": "string",
    "VARCHAR": "string",
    "CHAR": "string",
    "TEXT": "string",
    "INT": "integer",
    "INTEGER": "integer",
    "BIGINT": "integer",
    "SMALLINT": "integer",
    "DECIMAL": "decimal",
    "NUMERIC": "decimal",
    "FLOAT": "float",
    "DOUBLE": "float",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
    "DATETIME": "timestamp",
    "UUID": "uuid",
    "UUIDV4": "uuid",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
    "BYTES": "binary",
    "BINARY": "binary",
}

# Default thresholds, in percent.
DEFAULT_SLO = 95.0
DEFAULT_VARIANCE = 1.0

NUMERIC_FAMILIES = frozenset({"integer", "decimal", "float"})
DATETIME_FAMILIES = frozenset({"date", "timestamp"})


@dataclass(frozen=True)
class Field:
    """A column and its declared type; a missing type means STRING.

    Numbers are compared exactly. `digits` rounds them, half up, to so many fraction digits first.
    `precision` and `scale` say what a DECIMAL declaration holds, for checks of conformance.
    """

    name: str
    type: str | None = "STRING"
    digits: int | None = None
    precision: int | None = None
    scale: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "type", (self.type or "STRING").upper())

    @property
    def family(self) -> str | None:
        """Type family, or None for an unknown type name."""
        return TYPE_FAMILY.get(self.type)

    def is_numeric(self) -> bool:
        return self.family in NUMERIC_FAMILIES

    def is_integer(self) -> bool:
        return self.family == "integer"

    def is_datetime(self) -> bool:
        return self.family in DATETIME_FAMILIES

    def is_string(self) -> bool:
        return self.family == "string"

    def is_uuid(self) -> bool:
        return self.family == "uuid"


@dataclass(frozen=True)
class Enrichment:
    """A reference table joined to a side, on one key pair, before hashing."""

    table: str
    key: str
    ref_key: str
    how: str = "left"
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Side:
    """One relation: where it is, its key columns and its compared columns, in pair order."""

    table: str
    id_fields: tuple[Field, ...] = ()
    hash_fields: tuple[Field, ...] = ()
    schema: str = ""
    view_suffix: str = ""
    kind: str | None = None
    url: str | None = None
    username: str | None = None
    password: str | None = dc_field(default=None, repr=False)
    joins: tuple[Enrichment, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "id_fields", tuple(map(_as_field, self.id_fields or ())))
        object.__setattr__(self, "hash_fields", tuple(map(_as_field, self.hash_fields or ())))
        object.__setattr__(self, "view_suffix", self.view_suffix or "")

    @property
    def table_name(self) -> str:
        return f"{self.schema}.{self.table}" if self.schema else self.table

    @property
    def view_name(self) -> str:
        return self.table_name + self.view_suffix

    @property
    def id_names(self) -> list[str]:
        return [f.name for f in self.id_fields]

    @property
    def hash_names(self) -> list[str]:
        return [f.name for f in self.hash_fields]

    @property
    def has_composite_id(self) -> bool:
        return len(self.id_fields) > 1

    @property
    def has_connection(self) -> bool:
        """True when the side carries its own connection (url and user both set)."""
        return self.url is not None and self.username is not None


@dataclass(frozen=True)
class Domain:
    """A named comparison of two sides.

    Target fields pair with source fields by position, or by name when
    `field_mappings` (source name -> target name) is given.
    """

    name: str
    source: Side
    target: Side
    field_mappings: dict[str, str] | None = None
    ignore_case: bool = False
    slo_target: float = DEFAULT_SLO
    variance_threshold: float = DEFAULT_VARIANCE
    algorithm: str = "md5"

    def __post_init__(self):
        if not 0 <= self.slo_target <= 100:
            raise ValueError(f"slo_target must be between 0 and 100, got {self.slo_target}")
        if self.variance_threshold < 0:
            raise ValueError(f"variance_threshold must not be negative, got {self.variance_threshold}")
        if self.algorithm not in ("md5", "sha256"):
            raise ValueError(f"algorithm must be md5 or sha256, got {self.algorithm}")

    def id_pairs(self) -> list[tuple[Field, Field]]:
        return list(zip(self.source.id_fields, self.target.id_fields))

    def field_pairs(self) -> list[tuple[Field, Field]]:
        """Paired hash fields; the common prefix when the lists differ in length."""
        if not self.field_mappings:
            return list(zip(self.source.hash_fields, self.target.hash_fields))
        targets = {f.name: f for f in self.target.hash_fields}
        unknown = [
            f"{s} -> {t}"
            for s, t in self.field_mappings.items()
            if s not in self.source.hash_names or t not in targets
        ]
        if unknown:
            raise ValueError("field_mappings name unknown fields: " + ", ".join(unknown))
        return [
            (f, targets[self.field_mappings[f.name]])
            for f in self.source.hash_fields
            if f.name in self.field_mappings
        ]


def _as_field(value) -> Field:
    """Accept a Field, a bare name, or a (name, type) pair."""
    if isinstance(value, Field):
        return value
    if isinstance(value, str):
        return Field(value)
    return Field(*value)
