"""The SQL each registered query is checked against, in DuckDB's dialect."""

from __future__ import annotations

ORDERS = """
src AS (
  SELECT o_orderkey AS k, o_custkey AS f1, CAST(o_totalprice AS DECIMAL(19,4)) AS f2,
         o_orderdate AS f3, o_orderstatus AS f4
  FROM orders),
tgt AS (
  SELECT CASE WHEN k % 50 = 9 THEN -1 - k ELSE k END AS k, f1,
         CASE k % 20 WHEN 3 THEN CAST(f2 * 1.005 AS DECIMAL(19,4))
                     WHEN 4 THEN CAST(f2 * 1.100 AS DECIMAL(19,4))
                     WHEN 5 THEN NULL
                     ELSE f2 END AS f2,
         f3, CASE WHEN k % 20 = 6 THEN 'Z' ELSE f4 END AS f4
  FROM src)"""

ORDER_NAMES = ["o_custkey", "price", "o_orderdate", "o_orderstatus"]

CUSTOMERS = """
src AS (
  SELECT c_custkey AS k, c_name AS f1, c_nationkey AS f2, c_acctbal AS f3, c_mktsegment AS f4,
         c_name AS c1, CAST(c_nationkey AS DECIMAL(38,0)) AS c2,
         CAST(c_acctbal AS DOUBLE) AS c3, c_mktsegment AS c4
  FROM customer),
tgt AS (
  SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS f1, CAST(c_nationkey AS DECIMAL(10,0)) AS f2,
         CAST(CASE WHEN c_nationkey = 7 THEN c_acctbal * 1.1 ELSE c_acctbal END AS DECIMAL(19,4)) AS f3,
         lower(c_mktsegment) AS f4, f1 AS c1, CAST(f2 AS DECIMAL(38,0)) AS c2, CAST(f3 AS DOUBLE) AS c3,
         f4 AS c4
  FROM customer)"""

DOCUMENTS = """
src AS (SELECT doc_id AS k, text AS f1, lang AS f2, n_chars AS f3 FROM documents),
tgt AS (
  SELECT k, CASE WHEN f2 = 'de' THEN f1 || chr(10) || '--' ELSE f1 END AS f1, f2,
         CASE WHEN f2 <> 'fr' THEN f3 END AS f3
  FROM src)"""

LINEITEMS = """
src AS (
  SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS f1,
         CAST(l_extendedprice AS DECIMAL(19,4)) AS f2, l_returnflag AS f3
  FROM lineitem),
tgt AS (
  SELECT k, CASE WHEN f1 % 25 = 3 THEN k2 + 100 ELSE k2 END AS k2, f1, f2,
         CASE WHEN f1 % 10 = 1 THEN 'X' ELSE f3 END AS f3
  FROM src)"""


def hash_of(columns: list[str], function: str = "md5") -> str:
    texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in columns)
    return f"{function}(concat_ws('|', {texts}))"


def aligned(
    base: str,
    n: int,
    on: str = "s.k = t.k",
    keys: str = "coalesce(s.k, t.k) AS k_1",
    src_hash: str | None = None,
    tgt_hash: str | None = None,
    prefix: str = "f",
) -> str:
    """CTEs up to `j`: one row per joined pair with hashes, status and the field pairs."""
    columns = [f"{prefix}{i}" for i in range(1, n + 1)]
    pairs = ", ".join(f"s.f{i} AS s{i}, t.f{i} AS t{i}" for i in range(1, n + 1))
    return f"""WITH {base.strip()},
s AS (SELECT *, {src_hash or hash_of(columns)} AS h, TRUE AS present FROM src),
t AS (SELECT *, {tgt_hash or hash_of(columns)} AS h, TRUE AS present FROM tgt),
j AS (
  SELECT {keys}, s.h AS src_hash, t.h AS tgt_hash,
         coalesce(s.present, FALSE) AS src_present, coalesce(t.present, FALSE) AS tgt_present,
         CASE WHEN t.present IS NULL THEN 'SOURCE_ONLY' WHEN s.present IS NULL THEN 'TARGET_ONLY'
              WHEN s.h = t.h THEN 'MATCH' ELSE 'MISMATCH' END AS status, {pairs}
  FROM s FULL OUTER JOIN t ON {on})"""


def judged(base: str, n: int, slo: float = 95.0, threshold: float = 1.0, **options) -> str:
    """CTEs up to `v`: aligned rows with variance type and percentage per pair, and both verdicts."""
    kinds, pcts = [], []
    for i in range(1, n + 1):
        s, t = f"CAST(s{i} AS VARCHAR)", f"CAST(t{i} AS VARCHAR)"
        kinds.append(
            f"CASE WHEN s{i} IS NULL AND t{i} IS NULL THEN 'EXACT_MATCH' "
            f"WHEN s{i} IS NULL OR t{i} IS NULL THEN 'NULL_MISMATCH' WHEN {s} = {t} THEN 'EXACT_MATCH' "
            f"WHEN TRY_CAST({s} AS DOUBLE) IS NOT NULL AND TRY_CAST({t} AS DOUBLE) IS NOT NULL THEN 'NUMERIC' "
            f"ELSE 'TEXT' END AS type{i}, TRY_CAST({s} AS DOUBLE) AS x{i}, TRY_CAST({t} AS DOUBLE) AS y{i}"
        )
        pcts.append(
            f"CASE type{i} WHEN 'EXACT_MATCH' THEN 0.0::DOUBLE WHEN 'NULL_MISMATCH' THEN 100.0::DOUBLE "
            f"WHEN 'NUMERIC' THEN CASE WHEN x{i} = 0 AND y{i} = 0 THEN 0.0::DOUBLE "
            f"ELSE abs(x{i} - y{i}) / abs(CASE WHEN x{i} = 0 THEN y{i} ELSE x{i} END) * 100.0::DOUBLE END "
            f"END AS pct{i}"
        )
    within = " + ".join(f"CASE WHEN pct{i} > {threshold} THEN 0 ELSE 1 END" for i in range(1, n + 1))
    over = " + ".join(f"CASE WHEN pct{i} > 1.0 THEN 1 ELSE 0 END" for i in range(1, n + 1))
    largest = f"greatest({', '.join(f'pct{i}' for i in range(1, n + 1))})" if n > 1 else "pct1"
    return aligned(base, n, **options) + f""",
jt AS (SELECT *, {', '.join(kinds)} FROM j),
jp AS (SELECT *, {', '.join(pcts)} FROM jt),
jf AS (
  SELECT *, CASE WHEN status = 'MISMATCH' THEN {n} ELSE 0 END AS total_fields,
         CASE WHEN status = 'MISMATCH' THEN {within} ELSE 0 END AS matching_fields,
         CASE WHEN status = 'MISMATCH' THEN {over} ELSE 0 END AS excessive_fields,
         CASE WHEN status = 'MISMATCH' THEN {largest} END AS max_variance
  FROM jp),
v AS (
  SELECT *, CAST(matching_fields AS DOUBLE) / {n}.0::DOUBLE * 100.0::DOUBLE AS field_match_pct,
         CASE WHEN status = 'MATCH' THEN 'PRISTINE'
              WHEN status = 'MISMATCH' AND CAST(matching_fields AS DOUBLE) / {n}.0::DOUBLE * 100.0::DOUBLE >= {slo}
              THEN 'NOISY' ELSE 'MATERIAL' END AS verdict,
         CASE WHEN status IN ('MATCH', 'MISMATCH') AND coalesce(src_hash, '') = coalesce(tgt_hash, '') THEN 'PRISTINE'
              WHEN status IN ('MATCH', 'MISMATCH') AND excessive_fields = 0 THEN 'NOISY'
              ELSE 'MATERIAL' END AS strict_verdict,
         CASE status WHEN 'MISMATCH' THEN 'HASH_MISMATCH' WHEN 'SOURCE_ONLY' THEN 'MISSING_IN_TARGET'
                     WHEN 'TARGET_ONLY' THEN 'MISSING_IN_SOURCE' END AS discrepancy_type,
         CASE status WHEN 'MISMATCH' THEN 'Record hash differs between source and target'
                     WHEN 'SOURCE_ONLY' THEN 'Record exists only in source'
                     WHEN 'TARGET_ONLY' THEN 'Record exists only in target' END AS details
  FROM jf)"""


SUMMARY = """
SELECT '{name}' AS domain, total_source, total_target, matched, mismatched, source_only, target_only,
       pristine, noisy, material, match_pct, mismatched + source_only + target_only AS total_discrepancies,
       material = 0 AS passed, match_pct >= 99.0 AS acceptable,
       material > 0 OR match_pct < 95.0 AS needs_approval
FROM (
  SELECT *, CASE WHEN greatest(total_source, total_target) = 0 THEN 100.0::DOUBLE
                 ELSE CAST(matched AS DOUBLE) * 100.0::DOUBLE / greatest(total_source, total_target) END AS match_pct
  FROM (SELECT (SELECT count(*) FROM src) AS total_source, (SELECT count(*) FROM tgt) AS total_target,
               count(*) FILTER (WHERE status = 'MATCH') AS matched,
               count(*) FILTER (WHERE status = 'MISMATCH') AS mismatched,
               count(*) FILTER (WHERE status = 'SOURCE_ONLY') AS source_only,
               count(*) FILTER (WHERE status = 'TARGET_ONLY') AS target_only,
               count(*) FILTER (WHERE verdict = 'PRISTINE') AS pristine,
               count(*) FILTER (WHERE verdict = 'NOISY') AS noisy,
               count(*) FILTER (WHERE verdict = 'MATERIAL') AS material
        FROM v))"""


def summary(base: str, n: int, name: str, **options) -> str:
    return judged(base, n, **options) + SUMMARY.format(name=name)


def listed(where: str) -> str:
    return judged(ORDERS, 4) + f"""
SELECT k_1, discrepancy_type, details, max_variance, strict_verdict, count(*) AS copies FROM v
WHERE status <> 'MATCH' AND {where} GROUP BY ALL"""


def verdicts(**thresholds) -> str:
    return judged(ORDERS, 4, **thresholds) + """
SELECT k_1, status, matching_fields, total_fields, field_match_pct, excessive_fields, max_variance,
       verdict, strict_verdict, count(*) AS copies
FROM v WHERE status <> 'MATCH' GROUP BY ALL"""


def scoped(where: str) -> str:
    base = ORDERS.replace("FROM orders)", f"FROM orders WHERE {where})")
    return aligned(base, 4) + "\nSELECT k_1, src_hash, tgt_hash, status, count(*) AS copies FROM j GROUP BY ALL"


def enriched(how: str) -> str:
    """Both sides joined with all customers, which one order in ten does not find; the segment is the fifth field."""
    sides = ORDERS.replace("o_custkey AS f1", "CASE WHEN o_custkey % 10 = 3 THEN -o_custkey ELSE o_custkey END AS f1")
    sides = sides.replace("src AS (", "o AS (", 1).replace("tgt AS (", "p AS (", 1).replace("FROM src)", "FROM o)")
    base = f"""{sides},
ref AS (SELECT c_custkey, c_mktsegment FROM customer),
src AS (SELECT o.*, c_mktsegment AS f5 FROM o {how} JOIN ref ON f1 = c_custkey),
tgt AS (SELECT p.*, c_mktsegment AS f5 FROM p {how} JOIN ref ON f1 = c_custkey)"""
    return aligned(base, 5) + """
SELECT k_1, s5 AS src_c_mktsegment, t5 AS tgt_c_mktsegment, src_hash, tgt_hash, status, count(*) AS copies FROM j
GROUP BY ALL"""


CUSTOMER_KEYS = {"on": "CAST(s.k AS VARCHAR) = t.k", "keys": "coalesce(CAST(s.k AS VARCHAR), t.k) AS k_1", "prefix": "c"}
LINE_KEYS = {"on": "s.k = t.k AND s.k2 = t.k2", "keys": "coalesce(s.k, t.k) AS k_1, coalesce(s.k2, t.k2) AS k_2"}

VARIANCES = " UNION ALL ".join(
    f"SELECT k_1, '{name}' AS field_name, CAST(s{i} AS VARCHAR) AS source_value, CAST(t{i} AS VARCHAR) AS target_value, "
    f"pct{i} AS variance_pct, type{i} AS variance_type, count(*) AS copies FROM v WHERE status = 'MISMATCH' GROUP BY ALL"
    for i, name in enumerate(ORDER_NAMES, start=1)
)

STORED_HASH = "CASE WHEN {k} % {m} <> 1 THEN md5(CAST(f1 AS VARCHAR) || '|' || f4) END"

ORDER_TOTALS = """
src AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(19,4)) AS f1 FROM orders),
tgt AS (
  SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(19,4))) AS DECIMAL(19,4)) AS f1
  FROM lineitem GROUP BY l_orderkey)"""

SHIP_DATES = """
src AS (SELECT l_orderkey AS k, CAST(min(l_shipdate) AS DATE) AS f1 FROM lineitem GROUP BY l_orderkey),
tgt AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS f1 FROM orders)"""

NULL_KEYS = """
src0 AS (
  SELECT o_orderkey AS k0, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS k, o_custkey AS f1,
         CAST(o_totalprice AS DECIMAL(19,4)) AS f2, o_orderdate AS f3, o_orderstatus AS f4
  FROM orders),
tgt0 AS (
  SELECT CASE WHEN k0 % 50 = 9 THEN -1 - k0 ELSE k0 END AS key, f1,
         CASE k0 % 20 WHEN 3 THEN CAST(f2 * 1.005 AS DECIMAL(19,4))
                      WHEN 4 THEN CAST(f2 * 1.100 AS DECIMAL(19,4))
                      WHEN 5 THEN NULL
                      ELSE f2 END AS f2,
         f3, CASE WHEN k0 % 20 = 6 THEN 'Z' ELSE f4 END AS f4
  FROM src0),
src AS (SELECT k, f1, f2, f3, f4 FROM src0),
tgt AS (SELECT CASE WHEN f4 <> 'O' THEN key END AS k, f1, f2, f3, f4 FROM tgt0)"""

PLAIN_HASH = "SELECT o_orderkey, {hash} AS record_hash FROM orders"
ORDER_COLUMNS = ["o_custkey", "CAST(o_totalprice AS DECIMAL(19,4))", "o_orderdate", "o_orderstatus"]
SHORT_PRICE = r"regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS VARCHAR), '\.?0+$', '')"

STATUS = "\nSELECT k_1, src_hash, tgt_hash, status, count(*) AS copies FROM j GROUP BY ALL"


def with_copies(sql: str) -> str:
    """Equal lines as one, with their number."""
    return f"SELECT *, count(*) AS copies FROM ({sql}) GROUP BY ALL"


SMALL = """
src AS (SELECT o_orderkey AS k, {x} AS f1 FROM orders),
tgt AS (SELECT k, CASE WHEN k % 20 = 3 THEN {step} ELSE f1 END AS f1 FROM src)"""
VERDICTS = "\nSELECT k_1, status, verdict FROM v"

FLOAT_KEYS = """
src AS (SELECT CAST(o_orderkey * 0.00001 AS DECIMAL(20,5)) AS k, o_orderstatus AS f1 FROM orders),
tgt AS (
  SELECT CAST(CASE WHEN o_orderkey % 50 = 9 THEN -1 - o_orderkey ELSE o_orderkey END AS DOUBLE) / 100000.0::DOUBLE AS k,
         CASE WHEN o_orderkey % 20 = 6 THEN 'Z' ELSE o_orderstatus END AS f1
  FROM orders)"""
FLOAT_KEY_PAIRS = {"on": "CAST(s.k AS DOUBLE) = t.k", "keys": "coalesce(CAST(s.k AS DOUBLE), t.k) AS k_1"}
BY_ORDER = {"on": "s.k = t.k"}

TYPED_ORDERS = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 4 THEN CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS DECIMAL(15,2)) END AS amount,
       CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS DOUBLE) / 8 AS ratio, CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS DOUBLE) * 1152921504606846976.0 AS large,
       CAST(o_orderdate AS TIMESTAMP) + to_milliseconds(o_orderkey % 1000) AS placed, CAST(o_orderdate AS DATE) AS day,
       CASE WHEN o_orderkey % 13 <> 5 THEN o_orderstatus = 'O' END AS open, hex(o_orderstatus) AS code
FROM orders"""


def database_hash(amount: str, ratio: str, large: str, placed: str, open_: str, code: str) -> str:
    texts = ", ".join(f"coalesce({c}, 'NULL')" for c in ("CAST(o_custkey AS VARCHAR)", amount, ratio, large, placed, "CAST(day AS VARCHAR)", open_, code))
    return f"SELECT o_orderkey, md5(concat_ws('|', {texts})) AS record_hash FROM ({TYPED_ORDERS})"


PLAIN_DOUBLE = "regexp_replace(CAST(ratio AS VARCHAR), '\\.0$', '')"
FOUR_PLACES = "CAST(CAST(amount AS DECIMAL(19,4)) AS VARCHAR)"
BIT = "CAST(CAST(open AS INT) AS VARCHAR)"
# The plain text of a large double: always a point, `E` and no plus sign.
LARGE = "CAST(large AS VARCHAR)"
SPARK_LARGE = f"replace(CASE WHEN {LARGE} LIKE '%.%' THEN {LARGE} ELSE replace({LARGE}, 'e', '.0e') END, 'e+', 'E')"

ORACLE: dict[str, str] = {
    "recon_summary": summary(ORDERS, 4, "orders"),
    "record_hash": PLAIN_HASH.format(hash=hash_of(ORDER_COLUMNS)),
    "record_hash_sha256": PLAIN_HASH.format(hash=hash_of(ORDER_COLUMNS, "sha256")),
    "record_hash_oracle": PLAIN_HASH.format(
        hash=hash_of(
            ["o_custkey", SHORT_PRICE, "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "lower(o_orderstatus)"]
        )
    ),
    "document_hash": f"SELECT doc_id, {hash_of(['text', 'lang', 'n_chars'])} AS record_hash FROM documents",
    "canonical_text": f"""
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS integer_text,
       CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS VARCHAR) AS decimal_text, {SHORT_PRICE} AS short_decimal_text,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp_text,
       strftime(o_orderdate, '%Y-%m-%d') AS date_text,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d 00:00:00') AS oracle_date_text,
       md5(o_orderstatus) AS uuid_text
FROM orders""",
    "aligned_status": aligned(ORDERS, 4) + STATUS,
    "precomputed_hash_status": judged(
        ORDERS.replace(
            "SELECT CASE WHEN k % 50",
            "SELECT k AS k0, CASE WHEN k % 50",
        ),
        4,
        src_hash=STORED_HASH.format(k="k", m=30),
        tgt_hash=STORED_HASH.format(k="k", m=15),
    )
    + "\nSELECT k_1, src_hash, tgt_hash, status, verdict, strict_verdict, count(*) AS copies FROM v GROUP BY ALL",
    "composite_key_status": aligned(LINEITEMS, 3, **LINE_KEYS)
    + "\nSELECT k_1, k_2, status, count(*) AS pairs FROM j GROUP BY k_1, k_2, status",
    "composite_key_tally": aligned(LINEITEMS, 3, **LINE_KEYS)
    + """,
sc AS (SELECT k, k2, count(*) AS n FROM src GROUP BY k, k2),
tc AS (SELECT k, k2, count(*) AS n FROM tgt GROUP BY k, k2)
SELECT k_1, k_2, coalesce(min(sc.n), 0) AS source_rows, coalesce(min(tc.n), 0) AS target_rows,
       count(*) FILTER (WHERE status = 'MATCH') AS matched,
       count(*) FILTER (WHERE status = 'MISMATCH') AS mismatched,
       count(*) FILTER (WHERE status = 'SOURCE_ONLY') AS source_only,
       count(*) FILTER (WHERE status = 'TARGET_ONLY') AS target_only
FROM j LEFT JOIN sc ON sc.k = k_1 AND sc.k2 = k_2 LEFT JOIN tc ON tc.k = k_1 AND tc.k2 = k_2
GROUP BY k_1, k_2""",
    "composite_key_summary": summary(LINEITEMS, 3, "lineitems", **LINE_KEYS),
    "match_counts": f"""
SELECT domain, total_source, total_target, matched, mismatched, source_only, target_only, match_pct,
       total_discrepancies
FROM ({summary(LINEITEMS, 3, "lineitems", **LINE_KEYS)})""",
    "cross_type_key_status": aligned(CUSTOMERS, 4, **CUSTOMER_KEYS)
    + "\nSELECT k_1, s3 AS src_c_acctbal, t3 AS tgt_balance, status, count(*) AS copies FROM j GROUP BY ALL",
    "null_key_status": aligned(NULL_KEYS, 4)
    + "\nSELECT k_1, src_present, tgt_present, src_hash, tgt_hash, status, count(*) AS copies FROM j GROUP BY ALL",
    "record_hash_mysql": database_hash(
        FOUR_PLACES, PLAIN_DOUBLE, f"replace({LARGE}, 'e+', 'e')", "strftime(placed + INTERVAL 500 MILLISECONDS, '%Y-%m-%d %H:%M:%S')", BIT, "code"
    ),
    "record_hash_sqlserver": database_hash(
        FOUR_PLACES, "CAST(ratio AS VARCHAR)", SPARK_LARGE, "strftime(placed, '%Y-%m-%d %H:%M:%S.%f') || '0'", BIT, "'0x' || code"
    ),
    "record_hash_postgres": database_hash(
        "CAST(amount AS VARCHAR)", PLAIN_DOUBLE, LARGE, "CAST(placed AS VARCHAR)", "CAST(open AS VARCHAR)", "'\\x' || lower(code)"
    ),
    "digest_line_statuses": aligned(LINEITEMS, 3, **LINE_KEYS)
    + "\nSELECT k_1, k_2, status, count(*) AS pairs FROM j WHERE status <> 'MATCH' GROUP BY k_1, k_2, status",
    "digest_unique_counts": f"""
SELECT domain, total_source, total_target, matched, mismatched, source_only, target_only, match_pct,
       total_discrepancies
FROM ({summary(ORDERS, 4, "orders")})""",
    "late_documents": judged(DOCUMENTS, 3)
    + "\nSELECT k_1, status, md5(s1) AS src_text_md5, md5(t1) AS tgt_text_md5, verdict, count(*) AS copies FROM v WHERE status <> 'MATCH' GROUP BY ALL",
    "missing_either_way": f"""WITH {ORDERS.strip()}
SELECT k AS k_1, 'MISSING_IN_TARGET' AS discrepancy_type FROM src WHERE k NOT IN (SELECT k FROM tgt)
UNION ALL
SELECT k, 'MISSING_IN_SOURCE' FROM tgt WHERE k NOT IN (SELECT k FROM src)""",
    "enriched_left": enriched("LEFT"),
    "enriched_inner": enriched("INNER"),
    "order_vs_lineitem_total": judged(ORDER_TOTALS, 1)
    + "\nSELECT k_1, s1 AS order_price, t1 AS lines_price, status, max_variance, verdict, count(*) AS copies FROM v GROUP BY ALL",
    "name_mapped_pairs": aligned(CUSTOMERS, 4, **CUSTOMER_KEYS) + STATUS,
    "case_insensitive": aligned(
        CUSTOMERS.replace("c_mktsegment AS c4", "lower(c_mktsegment) AS c4")
        .replace("c_name AS c1", "lower(c_name) AS c1")
        .replace("f1 AS c1", "lower(f1) AS c1"),
        4,
        **CUSTOMER_KEYS,
    )
    + STATUS,
    "date_vs_timestamp": aligned(SHIP_DATES, 1) + STATUS,
    "small_decimals": with_copies(
        judged(
            SMALL.format(x="CAST(CAST(o_totalprice AS DECIMAL(19,4)) * 0.000001 AS DECIMAL(20,8))", step="CAST(f1 + 0.00000001 AS DECIMAL(20,8))"),
            1,
        )
        + VERDICTS
    ),
    "double_values": with_copies(
        judged(
            SMALL.format(
                x="CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS DOUBLE) / 1000000.0::DOUBLE",
                step="f1 * (1.0::DOUBLE + pow(2.0::DOUBLE, -52))",
            ),
            1,
        )
        + VERDICTS
    ),
    "float_keys": with_copies(aligned(FLOAT_KEYS, 1, **FLOAT_KEY_PAIRS) + "\nSELECT k_1, status FROM j"),
    "number_words": """
SELECT o_orderkey AS k_1, CASE WHEN o_orderkey % 7 IN (3, 4, 5) THEN 'NUMERIC' ELSE 'TEXT' END AS variance_type,
       CASE WHEN o_orderkey % 7 IN (4, 5) THEN 'MATERIAL' ELSE 'NOISY' END AS verdict,
       CASE WHEN o_orderkey % 7 IN (4, 5) THEN 'MATERIAL' ELSE 'NOISY' END AS strict_verdict, 1 AS copies
FROM orders WHERE o_orderkey % 7 <> 0""",
    "hot_key_status": aligned(LINEITEMS, 3, **BY_ORDER) + "\nSELECT k_1, status, count(*) AS pairs FROM j GROUP BY k_1, status",
    "hot_key_summary": summary(LINEITEMS, 3, "by-order", **BY_ORDER),
    "field_variances": judged(ORDERS, 4) + f"\n{VARIANCES}",
    "verdicts": verdicts(),
    "verdicts_loose": verdicts(slo=75.0),
    "verdicts_strict": verdicts(slo=99.0, threshold=0.4),
    "document_verdicts": judged(DOCUMENTS, 3)
    + "\nSELECT k_1, status, matching_fields, max_variance, verdict, strict_verdict, count(*) AS copies FROM v GROUP BY ALL",
    "record_fields": aligned(ORDERS, 4)
    + """
SELECT k_1, CASE WHEN tgt_present THEN CAST(k_1 AS VARCHAR) END AS id, tgt_hash AS record_hash,
       CASE WHEN tgt_present THEN 'target' END AS side, CAST(t2 AS VARCHAR) AS price, t4 AS o_orderstatus,
       CASE WHEN tgt_present THEN 'o_custkey,o_orderdate,o_orderstatus,price' END AS field_names, count(*) AS copies
FROM j GROUP BY ALL""",
    "status_breakdown": aligned(ORDERS, 4) + "\nSELECT status, count(*) AS records FROM j GROUP BY status",
    "verdict_breakdown": judged(ORDERS, 4) + "\nSELECT verdict, count(*) AS records FROM v GROUP BY verdict",
    "type_breakdown": judged(ORDERS, 4)
    + """
SELECT discrepancy_type, count(*) AS discrepancies FROM v WHERE status <> 'MATCH' GROUP BY discrepancy_type""",
    "multi_domain_summary": " UNION ALL ".join(
        f"SELECT * FROM ({q})"
        for q in (
            summary(ORDERS, 4, "orders"),
            summary(CUSTOMERS, 4, "customers", **CUSTOMER_KEYS),
            summary(DOCUMENTS, 3, "documents"),
        )
    ),
    "multi_domain_strict": " UNION ALL ".join(
        f"SELECT * FROM ({q})"
        for q in (
            summary(ORDERS, 4, "orders", slo=75.0),
            summary(ORDERS, 4, "strict", slo=99.0, threshold=0.4),
            summary(LINEITEMS, 3, "lineitems", **LINE_KEYS),
        )
    ),
    "summary_text": f"""
SELECT domain, format('Reconciliation: {{}}/{{}} matched ({{:.1f}}%), {{}} pristine, {{}} noisy, {{}} material',
       matched, greatest(total_source, total_target), match_pct, pristine, noisy, material) AS summary_line
FROM ({summary(ORDERS, 4, "orders")})""",
    "material_only": listed("strict_verdict = 'MATERIAL'"),
    "noisy_only": listed("strict_verdict = 'NOISY'"),
    "missing_in_target": listed("discrepancy_type = 'MISSING_IN_TARGET'"),
    "missing_in_source": listed("discrepancy_type = 'MISSING_IN_SOURCE'"),
    "high_variance": listed("max_variance > 5"),
    "discrepancy_report": judged(ORDERS, 4)
    + """
SELECT CAST(k_1 AS VARCHAR) AS record_id, src_hash, tgt_hash, discrepancy_type,
       CASE discrepancy_type WHEN 'HASH_MISMATCH' THEN 'Record hashes differ between source and target'
            WHEN 'MISSING_IN_TARGET' THEN 'Record exists in source but not in target'
            ELSE 'Record exists in target but not in source' END AS type_description,
       details, verdict,
       CASE verdict WHEN 'NOISY' THEN 'Noisy - Minor differences (variance <= 1% on all fields)'
            ELSE 'Material - Significant differences (variance > 1% on some fields)' END AS verdict_description,
       count(*) AS copies
FROM v WHERE status <> 'MATCH' GROUP BY ALL""",
    "rare_discrepancies": listed("TRUE"),
    "discrepancy_json": with_copies(
        judged(ORDERS, 4)
        + """
SELECT discrepancy_type, verdict, details, CASE WHEN src_present THEN CAST(k_1 AS VARCHAR) END AS source_id,
       src_hash AS source_hash, CASE WHEN tgt_present THEN CAST(k_1 AS VARCHAR) END AS target_id, tgt_hash AS target_hash
FROM v WHERE status <> 'MATCH'"""
    ),
    "discrepancy_second_page": judged(ORDERS, 4)
    + """
SELECT k_1, status, discrepancy_type, count(*) AS copies FROM v WHERE status <> 'MATCH'
GROUP BY k_1, status, discrepancy_type ORDER BY k_1 LIMIT 100 OFFSET 100""",
    "discrepancy_page": judged(ORDERS, 4)
    + """
SELECT k_1, status, discrepancy_type, count(*) AS copies FROM v WHERE status <> 'MATCH'
GROUP BY k_1, status, discrepancy_type ORDER BY k_1 LIMIT 100""",
    "scope_period": scoped("CAST(o_orderdate AS DATE) = DATE '1996-09-17'"),
    "scope_entity": scoped("o_custkey = 605"),
    "scope_other_column": aligned(
        ORDERS.replace("src AS (", "src0 AS (", 1).replace("FROM src)", "FROM src0)").replace("tgt AS (", "tgt0 AS (")
        + ", src AS (SELECT * FROM src0 WHERE f4 = 'F'), tgt AS (SELECT * FROM tgt0 WHERE f4 = 'F')",
        4,
    )
    + STATUS,
    "scope_range": scoped("CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"),
    "key_audit": """
SELECT l_orderkey, l_linenumber, count(*) AS row_count,
       l_orderkey IS NULL OR l_linenumber IS NULL AS null_key
FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "type_conformance": """
WITH e AS (
  SELECT *, json_extract_string(props, '$.k') AS kk, CAST(value AS VARCHAR) AS amount, md5(CAST(event_id AS VARCHAR)) AS d,
         CASE WHEN event_id % 3 = 0
              THEN concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4), substr(d, 21, 12))
              ELSE d END AS ref
  FROM events)
SELECT 'k' AS field_name, 'INT' AS declared_type, count(kk) AS present,
       count(*) FILTER (WHERE kk IS NOT NULL AND TRY_CAST(kk AS INTEGER) IS NULL) AS nonconforming FROM e
UNION ALL
SELECT 'event_type', 'DECIMAL', count(event_type),
       count(*) FILTER (WHERE NOT regexp_full_match(event_type, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)')) FROM e
UNION ALL
SELECT 'event_id', 'SMALLINT', count(event_id),
       count(*) FILTER (WHERE event_id IS NOT NULL AND TRY_CAST(CAST(event_id AS VARCHAR) AS SMALLINT) IS NULL) FROM e
UNION ALL
SELECT 'props', 'DATE', count(props),
       count(*) FILTER (WHERE props IS NOT NULL AND TRY_CAST(props AS DATE) IS NULL) FROM e
UNION ALL
SELECT 'ref', 'UUID', count(ref),
       count(*) FILTER (WHERE NOT regexp_full_match(ref, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')) FROM e
UNION ALL
SELECT 'amount', 'DECIMAL', count(amount),
       count(*) FILTER (WHERE amount IS NOT NULL AND coalesce(TRY_CAST(amount AS DECIMAL(4,2)) = TRY_CAST(amount AS DECIMAL(38,16)), FALSE) IS FALSE)
FROM e
UNION ALL
SELECT 'event_type', 'STRING', count(event_type), 0 FROM e""",
}

TYPED_EVENTS = """
e AS (
  SELECT *, json_extract_string(props, '$.k') AS k, CAST(value AS VARCHAR) AS amount, md5(CAST(event_id AS VARCHAR)) AS d,
         CASE WHEN event_id % 3 = 0
              THEN concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4), substr(d, 21, 12))
              ELSE d END AS ref
  FROM events)"""


def sliced(table: str, key: str) -> str:
    return f"SELECT count(*) AS row_count, CAST(sum({key}) AS BIGINT) AS key_sum, TRUE AS fair FROM {table}"


ORACLE |= {
    "audit_keys": """
SELECT count(*) AS row_count, count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys, TRUE AS near
FROM lineitem""",
    "value_offenders": f"""
WITH {TYPED_EVENTS},
bad AS (
  SELECT 'k' AS field_name, 'INT' AS declared_type, k AS value FROM e WHERE k IS NOT NULL AND TRY_CAST(k AS INTEGER) IS NULL
  UNION ALL
  SELECT 'event_type', 'DECIMAL', event_type FROM e WHERE NOT regexp_full_match(event_type, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)')
  UNION ALL
  SELECT 'event_id', 'SMALLINT', CAST(event_id AS VARCHAR) FROM e
  WHERE event_id IS NOT NULL AND TRY_CAST(CAST(event_id AS VARCHAR) AS SMALLINT) IS NULL
  UNION ALL
  SELECT 'props', 'DATE', props FROM e WHERE props IS NOT NULL AND TRY_CAST(props AS DATE) IS NULL
  UNION ALL
  SELECT 'ref', 'UUID', ref FROM e
  WHERE NOT regexp_full_match(ref, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')),
counted AS (SELECT field_name, declared_type, value, count(*) AS occurrences FROM bad GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY field_name ORDER BY occurrences DESC, value) AS INTEGER) AS rank FROM counted
QUALIFY rank <= 3""",
    "slices_by_price": sliced("orders", "o_orderkey"),
    "slices_by_length": sliced("documents", "doc_id"),
}

# The same results by another way.
ORACLE |= {
    "audit_fields": ORACLE["type_conformance"],
    "digest_drilldown": ORACLE["match_counts"],
    "digest_missing": ORACLE["missing_either_way"],
    "late_field_variances": ORACLE["field_variances"],
    "late_report": ORACLE["discrepancy_report"],
    "listing_page": ORACLE["discrepancy_page"],
    "listing_second_page": ORACLE["discrepancy_second_page"],
}

SAME = ORDERS[: ORDERS.index("tgt AS (")] + "tgt AS (SELECT * FROM src)"
EMPTY = ORDERS.replace("FROM orders)", "FROM orders WHERE o_orderstatus = 'none')")
ORACLE |= {
    "empty_sides": summary(EMPTY, 4, "orders"),
    "csv_lines": judged(ORDERS, 4)
    + "\nSELECT discrepancy_type, CAST(k_1 AS VARCHAR) AS record_id, details, count(*) AS copies FROM v WHERE status <> 'MATCH' GROUP BY ALL",
    "view_counts": judged(ORDERS, 4)
    + "\nSELECT discrepancy_type, strict_verdict, count(*) AS records, max(max_variance) AS largest FROM v WHERE status <> 'MATCH' GROUP BY ALL",
    "run_trend": f"""
WITH runs AS (
  SELECT '1' AS run_id, * FROM ({summary(ORDERS, 4, "orders")}) UNION ALL
  SELECT '2', * FROM ({summary(SAME, 4, "orders")}) UNION ALL
  SELECT '3', * FROM ({summary(ORDERS, 4, "orders")}))
SELECT domain, run_id, CAST(row_number() OVER w AS INT) AS run, match_pct, match_pct - lag(match_pct) OVER w AS match_change, total_discrepancies,
       total_discrepancies - lag(total_discrepancies) OVER w AS discrepancy_change,
       passed AND NOT lag(passed) OVER w AS mended, NOT passed AND lag(passed) OVER w AS broken
FROM runs WINDOW w AS (ORDER BY run_id)""",
}
