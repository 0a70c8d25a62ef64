"""Hash view of one relation, and the projection both sides go through before they are joined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.domain import Domain, Side
from concord.functions import canon, variance

# Accepted names of a stored hash column, in order of preference.
HASH_COLUMNS = ("record_hash", "_record_hash", "hash")


def column_type(df: DataFrame, name: str) -> T.DataType:
    """Type of a column, looked up as Spark resolves names (ignoring case)."""
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f.dataType
    raise ValueError(f"no column {name!r} among {df.columns}")


def find_hash_column(df: DataFrame) -> str | None:
    present = {c.lower(): c for c in df.columns}
    return next((present[n] for n in HASH_COLUMNS if n in present), None)


def hash_view(
    df: DataFrame,
    side: Side,
    algorithm: str = "md5",
    profile: str = "plain",
    strip_zeros: bool = False,
    ignore_case: bool = False,
) -> DataFrame:
    """Key columns, compared columns and `record_hash`, each field in its declared type."""
    if not side.id_fields or not side.hash_fields:
        raise ValueError("a hash view needs id_fields and hash_fields")
    texts = []
    for f in side.hash_fields:
        text = canon.declared_text(
            df[f.name], column_type(df, f.name), f, profile=profile, strip_zeros=strip_zeros
        )
        texts.append(F.lower(text) if ignore_case and f.is_string() else text)
    return df.select(
        *[df[n] for n in dict.fromkeys(side.id_names + side.hash_names)],
        canon.record_hash(texts, algorithm).alias("record_hash"),
    )


@dataclass(frozen=True)
class PairColumns:
    """Where a field pair lives in the aligned frame.

    A text field has two columns more, its short form and the number a long text may be, so that
    counting verdicts moves no long texts.
    """

    name: str
    src: str
    tgt: str
    src_type: T.DataType
    tgt_type: T.DataType

    def sides(self) -> list[tuple[str, T.DataType]]:
        return [(self.src, self.src_type), (self.tgt, self.tgt_type)]


def short_column(column: str) -> str:
    return f"_short_{column}"


def number_column(column: str) -> str:
    return f"_number_{column}"


def value_columns(c: Column, name: str, dtype: T.DataType) -> list[Column]:
    """A compared column under its aligned name, with the two extra columns of a text."""
    if not isinstance(dtype, T.StringType):
        return [c.alias(name)]
    return [
        c.alias(name),
        variance.short_text(c).alias(short_column(name)),
        variance.long_number(c).alias(number_column(name)),
    ]


@dataclass(frozen=True)
class Prepared:
    """Both sides projected to the same key columns, a hash and their own compared columns."""

    source: DataFrame
    target: DataFrame
    keys: list[str]
    pairs: list[PairColumns]
    # Rows with a NULL key, found by the columns as stored, which lets the filter reach the scan. None: there can be none.
    null_source: DataFrame | None = None
    null_target: DataFrame | None = None

    def keyed(self) -> tuple[DataFrame, DataFrame]:
        """The rows that can have a partner."""
        full = ~reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])
        return self.source.where(full), self.target.where(full)

    def loose(self) -> tuple[DataFrame | None, DataFrame | None]:
        """The rows that can't, as a part of their key is NULL."""
        return self.null_source, self.null_target

    def thin(self) -> "Prepared":
        """Keys and hashes."""
        return self.narrowed([*self.keys, "src_hash"], [*self.keys, "tgt_hash"])

    def short(self) -> "Prepared":
        """Keys, hashes and what a verdict needs of the compared columns: no long text."""

        def columns(name: str, dtype: T.DataType) -> list[str]:
            return [short_column(name), number_column(name)] if isinstance(dtype, T.StringType) else [name]

        src = [c for p in self.pairs for c in columns(p.src, p.src_type)]
        tgt = [c for p in self.pairs for c in columns(p.tgt, p.tgt_type)]
        return self.narrowed([*self.keys, *src, "src_hash"], [*self.keys, *tgt, "tgt_hash"])

    def narrowed(self, src_columns: list[str], tgt_columns: list[str]) -> "Prepared":
        """The same with some of the columns."""
        s, t = (None if d is None else d.select(*c) for d, c in zip(self.loose(), (src_columns, tgt_columns)))
        return replace(self, source=self.source.select(*src_columns), target=self.target.select(*tgt_columns), null_source=s, null_target=t)


def prepare(source: DataFrame, target: DataFrame, domain: Domain, use_hash_column: bool = False, carried: tuple[str, ...] = ()) -> Prepared:
    """Narrow projections only: nothing here moves a row. `carried` columns of both sides are kept as they are."""
    src_cols: list[Column] = [source[c] for c in carried]
    tgt_cols: list[Column] = [target[c] for c in carried]
    keys = []
    for i, (a, b) in enumerate(domain.id_pairs(), start=1):
        key = f"k_{i}"
        ka, kb = canon.paired_key(
            source[a.name], column_type(source, a.name), a, target[b.name], column_type(target, b.name), b
        )
        keys.append(key)
        src_cols.append(ka.alias(key))
        tgt_cols.append(kb.alias(key))

    field_pairs = domain.field_pairs()
    names_clash = any(
        len({f.name.lower() for f in side}) < len(side) or {"hash", "present", "copies"} & {f.name.lower() for f in side}
        for side in ([a for a, _ in field_pairs], [b for _, b in field_pairs])
    )
    pairs, src_texts, tgt_texts = [], [], []
    for i, (a, b) in enumerate(field_pairs, start=1):
        infix = f"{i}_" if names_clash else ""
        p = PairColumns(
            a.name, f"src_{infix}{a.name}", f"tgt_{infix}{b.name}",
            column_type(source, a.name), column_type(target, b.name),
        )
        pairs.append(p)
        src_cols += value_columns(source[a.name], p.src, p.src_type)
        tgt_cols += value_columns(target[b.name], p.tgt, p.tgt_type)
        ta, tb = canon.paired_text(
            source[a.name], p.src_type, a, target[b.name], p.tgt_type, b, domain.ignore_case
        )
        src_texts.append(ta)
        tgt_texts.append(tb)

    src_hash = _hash(source, src_texts, domain, use_hash_column)
    tgt_hash = _hash(target, tgt_texts, domain, use_hash_column)
    src_cols.append(src_hash.alias("src_hash"))
    tgt_cols.append(tgt_hash.alias("tgt_hash"))
    null_source = _null_keys(source, [a.name for a, _ in domain.id_pairs()])
    null_target = _null_keys(target, [b.name for _, b in domain.id_pairs()])
    return Prepared(
        source.select(*src_cols),
        target.select(*tgt_cols),
        keys,
        pairs,
        None if null_source is None else null_source.select(*src_cols),
        None if null_target is None else null_target.select(*tgt_cols),
    )


def _null_keys(df: DataFrame, names: list[str]) -> DataFrame | None:
    nullable = [f.name for f in df.schema if f.nullable and f.name.lower() in {n.lower() for n in names}]
    return df.where(reduce(lambda a, b: a | b, [df[n].isNull() for n in nullable])) if nullable else None


def _hash(df: DataFrame, texts: Sequence[Column], domain: Domain, use_hash_column: bool) -> Column:
    if not use_hash_column:
        return canon.record_hash(texts, domain.algorithm)
    name = find_hash_column(df)
    if name is None:
        raise ValueError("no hash column (expected one of: " + ", ".join(HASH_COLUMNS) + ")")
    return df[name]
