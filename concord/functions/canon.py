"""One text form for equal values, and the record hash built from it.

Both sides of a pair are brought to one type before they are turned into text, so that
the same value stored as INT and DECIMAL, or as DATE and TIMESTAMP, hashes alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.domain import DATETIME_FAMILIES, NUMERIC_FAMILIES, Field

# Fixed values of the hash format.
NULL_TEXT = "NULL"
SEPARATOR = "|"
ORACLE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# What the databases make of a value that is turned into text. Decimals there have four places unless said otherwise.
DATABASE_SCALE = 4
SECONDS, MICROSECONDS = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS"
BYTES_PREFIX = {"postgres": "\\x", "mysql": "", "sqlserver": "0x"}
PROFILES = ("plain", "oracle", *BYTES_PREFIX)


def physical_family(dtype: T.DataType) -> str:
    """Type family of a Spark column type."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.FractionalType):
        return "float"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    raise TypeError(f"columns of type {dtype.simpleString()} cannot be compared")


def effective_family(dtype: T.DataType, field: Field) -> str:
    """The stored type decides; text takes its declared type, a timestamp declared DATE is a date, and a
    number declared BOOLEAN is one."""
    family = physical_family(dtype)
    if family == "string":
        return field.family or "string"
    if family in ("integer", "decimal") and field.family == "boolean":
        return "boolean"
    if family == "timestamp" and field.family == "date":
        return "date"
    return family


def pair_family(a: str, b: str) -> str:
    """The family in which two families are compared; `text` when they have nothing in common."""
    if a == b:
        return a
    both = {a, b}
    if both <= NUMERIC_FAMILIES:
        return "float" if "float" in both else "decimal"
    if both <= DATETIME_FAMILIES:
        return "date"
    if both == {"uuid", "string"}:
        return "uuid"
    return "text"


def raw_text(c: Column, dtype: T.DataType) -> Column:
    """The value's own text; bytes as hex."""
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.StringType):
        return c
    return c.cast("string")


# Texts of a number without exponent, and the digits that every double keeps.
PLAIN_NUMBER = r"^[+-]?+(\d++(\.\d*+)?+|\.\d++)$"
SAFE_DIGITS = 15


def short_number(text: Column) -> Column:
    """The shortest text of a plain number: `+012.500` -> `12.5`, `-0.0` -> `0`. Exact, as no digit but a
    zero goes; any other text is left alone."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0++(?=\d)", "$1")
    bare = F.regexp_replace(bare, r"^(-?)\.", "$10.")
    bare = F.when(bare.contains("."), F.regexp_replace(F.rtrim(bare, F.lit("0")), r"\.$", "")).otherwise(bare)
    return F.when(text.rlike(PLAIN_NUMBER), F.when(bare == "-0", "0").otherwise(bare)).otherwise(text)


def double_text(c: Column) -> Column:
    """A double's or float's own text, with one zero."""
    return F.when(c == 0, "0.0").otherwise(c.cast("string"))


def number_text(c: Column, dtype: T.DataType, family: str, digits: int | None = None) -> Column:
    """Exact text of a number among numbers of its pair; the value's own text where it is none.

    Decimals and integers have their shortest text. Next to a double every number is its nearest double;
    a text is one only if it has few enough digits to name that double alone.
    """
    kind = physical_family(dtype)
    own = raw_text(c, dtype)
    if digits is not None:
        return F.coalesce(c.try_cast(f"decimal(38,{digits})").cast("string"), own)
    if kind not in ("string", "integer", "decimal", "float"):
        return own
    if family == "float":
        if kind == "float":
            return double_text(c)
        if kind in ("integer", "decimal"):
            return double_text(c.cast("double"))
        few = F.length(F.regexp_replace(short_number(own), "[^0-9]", "")) <= SAFE_DIGITS
        number = F.when(own.rlike(PLAIN_NUMBER) & few, own.try_cast("double"))
        return F.coalesce(double_text(number), own)
    if kind == "decimal" and dtype.scale == 0 or kind == "integer":
        return own
    return double_text(c) if kind == "float" else short_number(own)


def to_family(c: Column, dtype: T.DataType, family: str) -> Column:
    """The value in the type its family is compared in; NULL where it does not fit."""
    if family in ("date", "boolean"):
        if family == "boolean" and physical_family(dtype) in NUMERIC_FAMILIES:
            return F.when(c == 1, True).when(c == 0, False)
        return c.try_cast(family)
    if family == "timestamp":
        return c.try_cast("timestamp_ntz")
    if family == "uuid":
        return F.lower(raw_text(c, dtype))
    return raw_text(c, dtype)


def double_in(c: Column, profile: str) -> Column:
    """A double as `postgres` or `mysql` writes it: all its digits, no closing `.0`, an exponent only beyond a range of sizes."""
    text = F.when(c == 0, "0").otherwise(c.cast("string"))
    size = F.abs(c.cast("double"))
    small = 1e-4 if profile == "postgres" else 1e-15
    plain = F.when(size >= 1, short_number(text.try_cast("decimal(38,22)").cast("string"))).otherwise(
        short_number(text.try_cast("decimal(38,37)").cast("string"))
    )
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(2)), "^-", "")
    sign = F.when(text.contains("E-"), "-").otherwise("+" if profile == "postgres" else "")
    shown = F.concat(mantissa, F.lit("e"), sign, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power) if profile == "postgres" else power)
    return F.when((size >= small) & (size < 1e15) | (size == 0), plain).when(text.contains("E"), shown).otherwise(text)


def database_text(c: Column, dtype: T.DataType, family: str, profile: str, scale: int) -> Column | None:
    """Text of a value in a database's own form, where that is not the plain one. Values that do not fit keep their own text."""
    own = raw_text(c, dtype)
    if family == "boolean" and profile != "postgres":
        value = to_family(c, dtype, family)
        return F.coalesce(F.when(value, "1").when(~value, "0"), own)
    if family == "decimal" and profile != "postgres":
        return F.coalesce(c.try_cast(f"decimal(38,{scale})").cast("string"), own)
    if family == "float" and physical_family(dtype) == "float" and profile != "sqlserver":
        return double_in(c, profile)
    if family == "timestamp" and profile != "postgres":
        value = to_family(c, dtype, family)
        if profile == "mysql":  # whole seconds, rounded
            return F.coalesce(F.date_format(value + F.expr("INTERVAL 0.5 SECOND"), SECONDS), own)
        return F.coalesce(F.concat(F.date_format(value, MICROSECONDS), F.lit("0")), own)
    if family == "binary" and physical_family(dtype) == "binary":
        digits = F.lower(F.hex(c)) if profile == "postgres" else F.hex(c)
        return F.concat(F.lit(BYTES_PREFIX[profile]), digits)
    return None


def family_text(
    c: Column,
    dtype: T.DataType,
    family: str,
    digits: int | None = None,
    profile: str = "plain",
    strip_zeros: bool = False,
    scale: int = DATABASE_SCALE,
) -> Column:
    """Text of a value compared in `family`.

    A value that does not fit the type keeps its own text, so two different misfits stay different.
    `profile="oracle"` writes dates and timestamps with a time of day, and numbers as TO_CHAR does: without
    closing zeros, and without the zero before the point. `mysql` and `sqlserver` write booleans as 1 and 0 and decimals with `scale`
    places; `mysql` timestamps have whole seconds, those of `sqlserver` seven digits behind them; `postgres` and `mysql` floats have
    no closing `.0`. Floats of `sqlserver` are plain: it has no text that keeps all their digits by default.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if profile in BYTES_PREFIX:
        text = database_text(c, dtype, family, profile, scale if digits is None else digits)
        if text is not None:
            return text
    if family in ("string", "text", "binary", "uuid"):
        return to_family(c, dtype, family)
    if family in NUMERIC_FAMILIES:
        same = physical_family(dtype) == family
        text = raw_text(c, dtype) if same and family != "float" and digits is None else number_text(c, dtype, family, digits)
        if profile == "oracle":
            return F.regexp_replace(short_number(text), r"^(-?)0\.", "$1.")
        return short_number(text) if strip_zeros and family != "integer" else text
    value = to_family(c, dtype, family)
    if profile == "oracle" and family in DATETIME_FAMILIES:
        text = F.date_format(value, ORACLE_TIME_FORMAT)
    else:
        text = value.cast("string")
    return text if physical_family(dtype) == family else F.coalesce(text, raw_text(c, dtype))


def declared_text(c: Column, dtype: T.DataType, field: Field, **options) -> Column:
    """Text of a single column in its declared type. Numbers keep all their digits."""
    family = field.family or "string"
    if family in NUMERIC_FAMILIES and physical_family(dtype) in NUMERIC_FAMILIES:
        family = physical_family(dtype)  # the stored type holds the value
    elif family in ("integer", "float") and physical_family(dtype) == "string":
        family = "decimal"
    return family_text(c, dtype, family, field.digits, scale=DATABASE_SCALE if field.scale is None else field.scale, **options)


def paired_text(
    a: Column, a_type: T.DataType, a_field: Field, b: Column, b_type: T.DataType, b_field: Field,
    ignore_case: bool = False,
) -> tuple[Column, Column]:
    """Text of both columns of a pair, in the type the pair has in common."""
    family = pair_family(effective_family(a_type, a_field), effective_family(b_type, b_field))
    digits = [f.digits for f in (a_field, b_field) if f.digits is not None]
    if family in NUMERIC_FAMILIES and (digits or a_type != b_type or isinstance(a_type, T.StringType)):
        texts = [number_text(c, t, family, min(digits, default=None)) for c, t in ((a, a_type), (b, b_type))]
    else:
        texts = [family_text(c, t, family) for c, t in ((a, a_type), (b, b_type))]
    if ignore_case and family in ("string", "text"):
        texts = [F.lower(t) for t in texts]
    return texts[0], texts[1]


def paired_key(
    a: Column, a_type: T.DataType, a_field: Field, b: Column, b_type: T.DataType, b_field: Field,
) -> tuple[Column, Column]:
    """Both columns of a key pair as one joinable type, in which no value becomes NULL.

    Keys keep a typed form within a family; across families, and wherever one side is stored as
    text, they are compared as text. Next to a double every number is a double.
    """
    families = [physical_family(a_type), physical_family(b_type)]
    if "string" in families:
        family = "uuid" if a_field.is_uuid() or b_field.is_uuid() else "text"
    elif set(families) <= NUMERIC_FAMILIES:
        if "float" in families:
            return a.cast("double"), b.cast("double")
        if families == ["integer", "integer"]:
            return a.cast("bigint"), b.cast("bigint")
        common = _common_decimal(a_type, b_type)
        if common:
            return a.cast(common), b.cast(common)
        return number_text(a, a_type, "decimal"), number_text(b, b_type, "decimal")
    else:
        family = pair_family(*families)
        if families == ["timestamp", "timestamp"] and "date" in (a_field.family, b_field.family):
            family = "date"
    return to_family(a, a_type, family), to_family(b, b_type, family)


# Digits that the integer types hold.
_INTEGER_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _common_decimal(*dtypes: T.DataType) -> str | None:
    """The decimal type that holds every value of both types, if there is one."""
    whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else _INTEGER_DIGITS[type(t)] for t in dtypes)
    scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in dtypes)
    return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else None


def digest(text: Column, algorithm: str = "md5") -> Column:
    """Lower-case hex digest of a text."""
    return F.sha2(text, 256) if algorithm == "sha256" else F.md5(text)


def record_hash(texts: Sequence[Column], algorithm: str = "md5") -> Column:
    """Digest of the field texts in order. Never NULL: a NULL field counts as the text NULL."""
    return digest(F.concat_ws(SEPARATOR, *[F.coalesce(t, F.lit(NULL_TEXT)) for t in texts]), algorithm)
