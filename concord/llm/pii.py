"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Spark expressions only. A pattern's matches come from `regexp_extract_all` and the text around them
from `split` by the same pattern; the lengths of both give the places, in code points. The patterns
take linear time: repetitions are possessive or, where a match may give back what it took too much, at
most 30 steps long, and a match starts where its run of characters starts or where the last match ended.
A span's context is what stands before and behind it, as far as the next matches of its kind.

NULL text counts as empty and has no spans. Rows are kept one for one, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the kinds, in the order in which spans are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
# What a text must hold for a pattern to match at all.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
# Words that make a kind likelier when they stand near.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|server|host|address|adresse|dirección",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
# Score of a confirmed span without and with such a word.
CONFIRMED, SUPPORTED = 0.7, 0.95
BEFORE, AFTER = 40, 20
BLOCK = 256

_LUHN = """aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN (length(d) - i) % 2 = 0 THEN int(substr(d, i, 1))
 WHEN int(substr(d, i, 1)) > 4 THEN 2 * int(substr(d, i, 1)) - 9 ELSE 2 * int(substr(d, i, 1)) END) % 10 = 0"""
_MOD97 = """aggregate(filter(split(concat(substr(d, 5), substr(d, 1, 4)), ''), c -> c <> ''), 0,
 (s, c) -> CASE WHEN c <= '9' THEN (s * 10 + int(c)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END) = 1"""
# `m` is a match; true if it is what it looks like.
VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(concat('0', ltrim('0', p)) AS int), 256) <= 255)",
    "card": f"exists(array(translate(m, ' -', '')), d -> CASE WHEN length(d) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END)",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15",
    "iban": f"exists(array(translate(m, ' ', '')), d -> {_MOD97})",
}

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"


def _spans(kind: str, text: str) -> Column:
    """Confirmed spans of a kind, in order. Places are summed in blocks, so that a text with very many matches takes little longer than in proportion."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    parts = f"split(`{text}`, '{pattern}', -1)"
    pairs = (
        "zip_with(zip_with(slice(parts, 1, size(found)), found, (p, m) -> named_struct("
        f"'gap', bigint(length(p)), 'm', m, 'n', bigint(length(m)), 'before', right(p, {BEFORE}))), slice(parts, 2, size(found)),"
        f" (e, p) -> named_struct('gap', e.gap, 'm', e.m, 'n', e.n, 'context', concat(e.before, '|', left(p, {AFTER}))))"
    )
    blocks = f"transform(sequence(0, (size(pairs) - 1) div {BLOCK}), b -> slice(pairs, int(b * {BLOCK} + 1), {BLOCK}))"
    sizes = "transform(blocks, x -> aggregate(x, 0L, (s, e) -> s + e.gap + e.n))"
    placed = (
        "flatten(transform(blocks, (x, b) -> transform(x, (e, j) -> named_struct('m', e.m, 'context', e.context, 'start',"
        " aggregate(slice(sizes, 1, b), 0L, (s, y) -> s + y) + aggregate(slice(x, 1, j), 0L, (s, y) -> s + y.gap + y.n) + e.gap))))"
    )
    near = f"lower(e.context) RLIKE '(?<![a-z])(?:{CONTEXT[kind]})'"
    kept = (
        f"transform(filter(placed, e -> exists(array(e.m), m -> {VALID[kind]})), e -> named_struct('kind', '{kind}', 'start', e.start,"
        f" 'end', e.start + length(e.m), 'value', e.m, 'score', CASE WHEN {near} THEN {SUPPORTED}D ELSE {CONFIRMED}D END))"
    )
    # Each step is bound to a name by a transform over a list of one.
    steps = f"transform(array({parts}), parts -> transform(array({pairs}), pairs -> transform(array({blocks}), blocks -> transform(array({sizes}), sizes -> transform(array({placed}), placed -> {kept})[0])[0])[0])[0])[0]"
    none = f"cast(array() AS array<{SPAN}>)"
    found = f"regexp_extract_all(`{text}`, '{pattern}', 0)"
    if kind in NEEDED:
        found = f"CASE WHEN instr(`{text}`, '{NEEDED[kind]}') > 0 THEN {found} ELSE cast(array() AS array<string>) END"
    return F.expr(f"transform(array({found}), found -> CASE WHEN size(found) = 0 THEN {none} ELSE cast({steps} AS array<{SPAN}>) END)[0]")


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with a column `out`: the spans, an array of (kind, start, end, value, score) by kind as
    listed in PATTERNS, then by start; end is exclusive. A column of that name is replaced."""
    held = f"__{out}_text"
    frame = docs.withColumn(held, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    return frame.withColumn(out, F.concat(*(_spans(kind, held) for kind in PATTERNS))).drop(held)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in square brackets. Overlapping spans are
    replaced as one, under the kind that starts first. NULL stays NULL; rows and columns stay."""
    spans = "__mask_spans"
    frame = find(docs, text, spans)
    # Spans in order of start; a span that begins inside the one before it extends it.
    merged = f"""aggregate(array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
        cast(array() AS array<struct<start:bigint,end:bigint,kind:string>>),
        (a, s) -> CASE WHEN size(a) > 0 AND s.start < element_at(a, -1).end
            THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind)))
            ELSE concat(a, array(s)) END)"""
    pieces = f"""concat_ws('', transform(merged, (s, i) -> concat(
        substring(`{text}`, int(CASE WHEN i = 0 THEN 1 ELSE merged[i - 1].end + 1 END), int(s.start - CASE WHEN i = 0 THEN 0 ELSE merged[i - 1].end END)),
        '[', s.kind, ']')), substring(`{text}`, int(element_at(merged, -1).end + 1)))"""
    new = f"CASE WHEN size({spans}) = 0 THEN `{text}` ELSE transform(array({merged}), merged -> {pieces})[0] END"
    return frame.withColumn(text, F.expr(new)).drop(spans)
