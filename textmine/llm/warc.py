"""Content-addressed web archive.

``write_archive`` stores two tables below one folder of shared storage: *payloads*
holds the bytes of every distinct payload once, under its SHA-256; *headers*
holds the exact header block of every WARC record and the payload's digest.
``records`` reads them back and rebuilds the original records by a join: a
response record's block is the stored payload, a revisit record has an empty
block and names the record that it refers to.  ``read_records`` verifies the
digest and the lengths and parses the header blocks again.

Of the records with equal payloads of ``least`` bytes or more, the one with the
smallest key is the response, the others revisit it; smaller payloads are
always stored with a response record of their own.

Defined cases: a null payload is empty (0 bytes, response); a null url gives an
empty target URI; rows without a key are responses of their own and never
referred to; rows that repeat the smallest key of a payload are all responses;
other columns are not read; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table, stage_path

LEAST_BYTES = 100
_CRLF = "\r\n"
_DATE = "2000-01-01T00:00:00Z"  # records carry a fixed date: the table has none


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def plan_records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                 least: int = LEAST_BYTES) -> DataFrame:
    """(key, url, digest, n_bytes, refers_to): the record of every row, without its payload."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    d = df.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "").alias("url"),
                  F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    first = d.filter(F.col("n_bytes") >= least).groupBy("digest").agg(
        F.min("key").alias("first"), F.count("key").alias("n")).filter("n > 1").drop("n")
    d = d.join(first, "digest", "left")
    return d.withColumn("refers_to", F.when(F.col("key") > F.col("first"), F.col("first"))).drop("first")


def header_block(plan: DataFrame) -> DataFrame:
    """(key, digest, header): exact header block of every planned record, its empty line included."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("key"))),
        _header("WARC-Date", F.lit(_DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _header("WARC-Refers-To", _record_id(F.col("refers_to"))),
            _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
        .otherwise(F.lit("")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(_CRLF))
    return plan.select("key", "digest", block.alias("header"))


def write_archive(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  least: int = LEAST_BYTES) -> None:
    """Write the payload store and the header table of ``df`` below ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    # Grouped before the shuffle: a hot payload leaves each task once.
    store = df.select(F.sha2(body, 256).alias("digest"), body.alias("payload")).groupBy("digest").agg(
        F.first("payload").alias("payload"))
    store.write.parquet(f"{path}/payloads")
    header_block(plan_records(df, key, url, payload, least)).write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    """Value of a header line, null when the block lacks it."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").contains(f"{_CRLF}{name}: "), found)


def parsed_headers(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """Fields read back from the stored header blocks, one row a record."""
    def number(value: Column) -> Column:
        return F.regexp_extract(value, r"^<urn:record:(.*)>$", 1).try_cast(key_type)

    h = spark.read.parquet(f"{path}/headers")
    return h.select(
        number(_field("WARC-Record-ID")).alias("key"), _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        number(_field("WARC-Refers-To")).alias("refers_to"),
        _field("Content-Length").cast("long").alias("content_length"), "header")


def records(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """The original records as bytes: header block, block, two line ends; one row a record."""
    head = parsed_headers(spark, path, key_type)
    store = spark.read.parquet(f"{path}/payloads")
    end = F.lit(_CRLF * 2).cast("binary")
    full = head.filter("record_type = 'response'").join(store, "digest", "left")
    full = full.withColumn("record", F.concat(F.col("header").cast("binary"), F.col("payload"), end)).drop("payload")
    bare = head.filter("record_type = 'revisit'").withColumn("record", F.concat(F.col("header").cast("binary"), end))
    return full.unionByName(bare)


def read_records(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) from the rebuilt records.

    A response's digest and length are computed from the rebuilt record's own
    bytes; a revisit's come from the verified store entry of its digest.  A
    record that does not fit its header, or whose payload is missing, fails the
    job.
    """
    made = records(spark, path, key_type)
    block = F.substring("record", F.octet_length("header") + 1, F.col("content_length").cast("int"))
    made = made.withColumn("block", block)
    sound = (F.octet_length("record") == F.octet_length("header") + F.col("content_length") + 4)
    sound = sound & ((F.col("record_type") == "revisit") | (F.sha2("block", 256) == F.col("digest")))
    made = made.withColumn("ok", F.coalesce(sound, F.lit(False)))
    made = made.select("key", "record_type", "digest", "refers_to", "ok", F.octet_length("block").cast("long").alias("n"))
    store = spark.read.parquet(f"{path}/payloads").select(
        "digest", F.octet_length("payload").cast("long").alias("stored"),
        (F.sha2("payload", 256) == F.col("digest")).alias("true_digest"))
    seen = made.filter("record_type = 'revisit'").join(store, "digest", "left")
    seen = seen.select("key", "record_type", "digest", "refers_to",
                       (F.col("ok") & F.coalesce("true_digest", F.lit(False))).alias("ok"), F.col("stored").alias("n"))
    both = made.filter("record_type <> 'revisit'").unionByName(seen)
    checked = F.when(F.col("ok"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("record does not fit its payload: "), F.coalesce(F.col("digest"), F.lit("?")))))
    return both.select("key", F.col("n").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def export_files(spark: SparkSession, path: str, out: str, key_type: str = "bigint") -> None:
    """Write the rebuilt records as plain .warc text files (each record ends with two line ends)."""
    made = records(spark, path, key_type)
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    made.select(body.alias("value")).write.option("lineSep", _CRLF * 2).text(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    return read_records(spark, path).withColumnRenamed("key", "page_id")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS f FROM d WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id > f.f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > f.f THEN f.f END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
