"""WARC archives, written and read through Spark's text source, so that any store it reaches will do.

Writing: one record per row. Of the rows with equal payloads of at least `least` bytes, that with the
smallest id (then the first row) is a response, the others are revisits without a payload.

Reading: files are split at the magic line wherever it occurs, also inside payloads. Every piece is a
candidate record whose header gives the offset of its successor; pieces tile the file, so that their
offsets are sums of lengths. Pointer jumping from offset 0 keeps the records on the chain; all other
candidates are part of a payload. A candidate without a readable header has no successor.

NULL payloads count as empty. NULL ids and URLs leave their header lines out and come back as NULL; a NULL id
counts as larger than any other. Line breaks in URLs are escaped. Repeated rows are a record each. An
empty table makes an empty archive. A row is told apart by its place in a Parquet file, or by a number that is stored with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.storage import numbered, saved
from concord.operators.locate import FILE, ROW, located

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID = "urn:page:"
RESPONSE, REVISIT = "response", "revisit"
RECORDS_PER_FILE = 10_000


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str = "2000-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write one WARC record per row to the folder `path`. Only digests are grouped; payloads move once. Rows
    of Parquet scans are read where they are, others are stored with numbers first.
    Archives are compressed whole, or with `compression="none"` may be read in parts."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    placed = located(rows)
    placed = numbered(rows.withColumn(FILE, F.lit("")), ROW, "warc-rows") if placed is None else placed
    rows = placed.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    order = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), F.col(FILE), F.col(ROW))
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    typed = rows.join(shared, "digest", "left").withColumn("again", F.col("first").isNotNull() & ((F.col(f"first.{FILE}") != F.col(FILE)) | (F.col(f"first.{ROW}") != F.col(ROW))))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    def name(file: str, row: str) -> Column:
        return F.concat(F.lit("<urn:row:"), F.md5(F.concat_ws(":", file, row)), F.lit(">"))

    known = F.when(F.col("first.id") != 2**63 - 1, F.col("first.id"))
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("again"), REVISIT).otherwise(RESPONSE)),
        line("WARC-Record-ID", name(FILE, ROW)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Page-ID", F.concat(F.lit(f"<{ID}"), F.col("id"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        line("WARC-Refers-To", F.when(F.col("again"), name(f"first.{FILE}", f"first.{ROW}"))),
        line("WARC-Refers-To-Page", F.when(F.col("again"), F.concat(F.lit(f"<{ID}"), known, F.lit(">")))),
        line("WARC-Profile", F.when(F.col("again"), PROFILE)),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit(END[:-1]),  # the line separator of the writer is the last character
    )
    typed.select(record).write.option("lineSep", END[-1]).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path, compression=compression)


# ---- reading

def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magic lines. `seq` gives their order within a block of a file, as this frame is read: it and
    the blocks may differ the next time."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("value"),
        F.substring_index("value", END, 1).alias("header"),
    )


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*+)", 1)
    return F.when(found != "", found)


def _reachable(candidates: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a file that are on the chain or inside a record on it, with the `seq` of that record.
    Offsets only, some 50 bytes a record, so that a file is a small group: 2^k steps along the chain are
    taken at once."""
    c = candidates.sort_values("offset", kind="stable")
    offset, successor = c["offset"].to_numpy(), c["successor"].to_numpy()
    n = len(c)
    jump = np.searchsorted(offset, successor)
    jump = np.where((jump < n) & (offset[np.minimum(jump, n - 1)] == successor), jump, n)
    jump = np.append(jump, n)
    on = np.zeros(n + 1, bool)
    on[0] = offset[0] == 0
    while (jump[:n] < n).any():
        on[jump[on]] = True
        jump = jump[jump]
    on[jump[on]] = True
    on = on[:n]
    owner = np.where(on, np.arange(n), -1)
    owner = np.maximum.accumulate(owner)
    size = int(c["file_size"].iloc[0])
    whole = (owner >= 0) & (successor[np.maximum(owner, 0)] <= size)
    own = on & c["complete"].to_numpy(bool)
    c = c.assign(record=c["seq"].to_numpy()[np.maximum(owner, 0)], own=own)
    return c.loc[whole, ["seq", "record", "own"]]


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives under `path`: page_id, url, record_type, payload_bytes and payload_digest (of
    the full payload: a revisit's come from its header), refers_to, and on request `payload` (NULL for a
    revisit). What the headers say and the digests are taken where a piece is read, and stored with the number that the chain
    names a piece by. Values are read again, by their SHA-256, only for payloads that hold the magic line or are asked for."""
    head = F.octet_length("header") + len(END)
    declared = F.when(F.expr(f"instr(header, '\r\n') > 0 AND octet_length(header) + {len(END)} <= bytes"), F.expr("try_cast(length AS bigint)"))
    parsed = (
        _pieces(spark, path)
        .withColumn("bytes", F.octet_length("value").cast("long"))
        .withColumn("length", _field("Content-Length"))
        .withColumn("declared", declared)
        .withColumn("span", F.when(F.col("declared") >= 0, head + F.col("declared") + len(END)))
    )
    # Of a value that holds more than one piece the payload is cut from all of them.
    payload = F.expr(f"substring(value, octet_length(header) + {len(END) + 1}, int(declared))")
    fields = [
        F.regexp_extract(F.coalesce(_field("WARC-Page-ID"), F.lit("")), rf"<{ID}(-?\d+)>", 1).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Payload-Digest").alias("digest_said"),
        _field("WARC-Payload-Length").alias("length_said"),
        F.regexp_extract(F.coalesce(_field("WARC-Refers-To-Page"), F.lit("")), rf"<{ID}(-?\d+)>", 1).alias("refers_to"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    ]
    whole = [payload.alias("payload")] if with_payload else []
    key = F.unhex(F.sha2("value", 256)).alias("key")
    narrow = saved(parsed.select("file", "block", "seq", "bytes", "span", "declared", key, *fields), "warc-pieces")
    chain = saved(_chain(narrow.select("file", "block", "seq", "bytes", "span")), "warc-chain")
    found = narrow.join(chain, ["file", "seq"])
    values = parsed.select(key, "value", "header", "declared")
    names = [f for f in narrow.columns if f not in ("file", "block", "seq", "bytes", "span", "declared", "key")]
    records = found.where("own").select("key", *names)
    if with_payload:
        records = records.join(values.groupBy("key").agg(F.first(payload).alias("payload")), "key")
    records = records.drop("key")
    if not chain.where("NOT own").isEmpty():
        pieces = found.where("NOT own").select("file", "record", "seq", "key")
        wanted = saved(pieces.select("key").distinct(), "warc-keys")
        again = values.join(wanted, "key", "left_semi").groupBy("key").agg(F.first(F.struct("value", "header", "declared")).alias("piece"))
        parts = pieces.join(again, "key").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: p["piece"]["value"].cast("string")), MAGIC).cast("binary")
        lead = F.col("parts")[0]["piece"]
        long = parts.select(joined.alias("value"), lead["header"].alias("header"), lead["declared"].alias("declared"))
        records = records.unionByName(long.select(*fields, *whole))
    revisit = F.col("record_type") == REVISIT
    return records.select(
        F.expr("try_cast(page_id AS bigint)").alias("page_id"),
        "url",
        "record_type",
        F.when(revisit, F.expr("try_cast(length_said AS bigint)")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest_said", ":", -1)).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(revisit, F.expr("try_cast(refers_to AS bigint)")).alias("refers_to"),
        *([F.when(~revisit, F.col("payload")).alias("payload")] if with_payload else []),
    )


def _chain(narrow: DataFrame) -> DataFrame:
    """Pieces that belong to a record on the chain: (file, seq, record, own); `own` is a record of one piece.

    The pieces of a block tile it, and the blocks tile the file: offsets are sums of lengths. The first
    piece of a file is what stands before its first magic line.
    """
    blocks = narrow.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size"), F.min("seq").alias("first"))
    by_file = Window.partitionBy("file")
    based = blocks.select(
        "file",
        "block",
        "first",
        (F.sum("size").over(by_file.orderBy("block")) - F.col("size")).alias("base"),
        (F.sum("size").over(by_file) - len(MAGIC)).alias("file_size"),
        (F.row_number().over(by_file.orderBy("block")) == 1).alias("lead"),
    )
    # The magic line ahead of a piece is counted with the piece before.
    within = Window.partitionBy("file", "block").orderBy("seq")
    candidates = (
        narrow.withColumn("before", F.sum(F.col("bytes") + len(MAGIC)).over(within) - F.col("bytes") - len(MAGIC))
        .join(based, ["file", "block"])
        .where("NOT (lead AND seq = first)")
        .withColumn("offset", F.col("base") + F.col("before") - len(MAGIC))
        .withColumn("successor", F.coalesce(F.col("offset") + len(MAGIC) + F.col("span"), F.lit(-1)))
        .select("file", "seq", "offset", "successor", "file_size", F.coalesce(F.col("bytes") == F.col("span"), F.lit(False)).alias("complete"))
    )
    return candidates.groupBy("file").applyInPandas(
        lambda key, c: _reachable(c).assign(file=key[0]), "file string, seq long, record long, own boolean"
    )
