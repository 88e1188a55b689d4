"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text, the
*blob*).  The ledger is a table ``(blob, rule_version, spans)``: a blob is
scanned once for each version of the rules, however many paths and versions
hold it.  ``scan_unseen`` scans only the pairs that the ledger lacks, and
``findings`` joins the ledger back to all paths.  Only built-in expressions,
joins, aggregates and windows; no Python.

Spans are code points, start inclusive, end exclusive.  A kind's matches are
leftmost and do not overlap; its positions come from the lengths of the
matches and of the pieces between them, summed in a window over one blob.

Defined cases: a null text is an empty text (no findings); equal texts share
a blob, so copies cost one scan and repeated rows get equal results; a null
key is passed on; an empty table gives an empty result; further columns of the
input are not read (``redact`` passes them on untouched).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmine.llm.common import read_table, staged


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds a secret; with ``group`` set, that group must have ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds first, in the order that breaks ties of start,
# then the kinds that this scan adds.
BASE = (
    Kind("assign",
         r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
         r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}"),  # 16 characters or more
    Kind("hex", r"[0-9a-f]{32,}"),  # maximal runs of 32 or more
)
ADDED = (
    Kind("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
KINDS = BASE + ADDED
RULE_VERSION = "2"

LEDGER = "blob string, rule_version string, spans array<struct<start:int,kind:int,end:int>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _matches(kind: Kind, no: int) -> Column:
    """Array of (kind, k, length with the gap before, length, holds) of all matches in ``t``."""
    found = F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))
    part = F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    # The gap before match k is piece k of the text split at the matches.
    zipped = F.arrays_zip(found.alias("m"), part.alias("g"), F.split("t", kind.pattern, -1).alias("gap"))
    return F.when(
        F.regexp_like("t", F.lit(kind.pattern)),
        F.transform(zipped, lambda x, i: F.struct(
            F.lit(no).alias("kind"), i.alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("n"),
            (F.length(x["g"]) >= kind.least).alias("holds")))).otherwise(
        F.array().cast("array<struct<kind:int,k:int,gap:int,n:int,holds:boolean>>"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, kinds=KINDS,
                rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """New ledger rows: one for every blob of ``versions`` not yet scanned under ``rule_version``."""
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    # Map-side first: a group of copies sends one text per task, not per copy.
    blobs = blobs.groupBy("blob").agg(F.first("t").alias("t"))
    no_spans = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    hit = F.concat(*[_matches(k, i) for i, k in enumerate(kinds)])
    d = blobs.select("blob", hit.alias("hits"))
    rows = d.select("blob", F.explode_outer("hits").alias("x")).select("blob", "x.*").filter("kind is null or n is not null")
    upto = Window.partitionBy("blob", "kind").orderBy("k")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto).cast("int"))
    span = F.when(F.col("holds"), F.struct((F.col("end") - F.col("n")).alias("start"), F.col("kind"), F.col("end")))
    out = rows.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return out.select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", no_spans).alias("spans"))


def update_ledger(versions: DataFrame, path: str, kinds=KINDS, rule_version: str = RULE_VERSION,
                  text: str = "text") -> DataFrame:
    """Append what is unseen to the ledger at ``path`` (made when missing) and return the whole ledger."""
    spark = versions.sparkSession
    empty_ledger(spark).write.mode("append").parquet(path)
    ledger = spark.read.schema(LEDGER).parquet(path)
    new = staged(scan_unseen(versions, ledger, kinds, rule_version, text), "secret-new")
    new.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, key: str = "doc_id", text: str = "text",
             rule_version: str = RULE_VERSION) -> DataFrame:
    """(key, blob, spans) of every row of ``versions``; no findings: empty array."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    paths = versions.select(F.col(key), blob_of(F.col(text)).alias("blob"))
    # Most blobs are clean, so only those with findings take part in the join.
    # A pair that two writers have appended counts once: its spans are the same.
    dirty = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    return paths.join(dirty, "blob", "left").select(key, "blob", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column, kinds) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, ledger: DataFrame, text: str = "text", mark: str = "[SECRET]",
           rule_version: str = RULE_VERSION) -> DataFrame:
    """The rows of ``df`` with every found span replaced by ``mark``; overlapping spans become one."""
    dirty = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    spans = dirty.select("blob", F.posexplode("spans").alias("i", "s")).select("blob", "i", "s.start", "s.end")
    before = Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(-1)))
    upto = Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("part", F.sum((F.col("start") > F.col("reach")).cast("int")).over(upto))
    cuts = spans.groupBy("blob", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = cuts.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), blob_of(F.col(text)).alias("blob"))
    t = F.col(f"row.`{text}`")
    pieces = F.transform("cuts", lambda c, i: F.substring(
        t, F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0)) + 1,
        c["start"] - F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))))
    rest = F.substring(t, F.element_at("cuts", -1)["end"] + 1, F.length(t))
    clean = F.when(F.col("cuts").isNull(), t).otherwise(F.concat(F.array_join(pieces, mark), F.lit(mark), rest))
    joined = row.join(cuts, "blob", "left").withColumn("clean", clean)
    return joined.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def digest(found: DataFrame, key: str = "doc_id", kinds=KINDS) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    def number(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")

    counts = [number(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return found.select(key, *counts, F.sha2(_joined(base, kinds), 256).alias("base_sha256"),
                        _joined(F.col("spans"), kinds).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ledger = staged(scan_unseen(docs), "secret-ledger")
    return digest(findings(docs, ledger))


def _sql(relation: str) -> str:
    parts = []
    for no, k in enumerate(KINDS):
        p = k.pattern.replace("'", "''")
        parts.append(f"""SELECT rid, {no} AS kind, '{k.name}' AS name,
    unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(regexp_extract_all(t, '{p}', {k.group})) AS g,
    unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}', 0)))) AS gap,
    unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS k, {k.least} AS least
  FROM d WHERE regexp_matches(t, '{p}')""")
    union = "\n  UNION ALL ".join(parts)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {relation}),
h AS ({union}),
e AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS stop FROM h),
s AS (SELECT rid, kind, name, (stop - length(m))::BIGINT AS start, name || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span
      FROM e WHERE length(g) >= least),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base,
        string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.rid = a.rid
"""


SQL = _sql("documents")
