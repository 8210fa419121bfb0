"""WARC archives: writing with revisit records, and reading by verified chains.

Writing is plain DataFrame work: a record is one string, Spark's text writer
puts the blank lines behind it, and binary payloads pass unchanged.

A reader that splits archives cannot know whether the magic at some place starts
a record or stands inside a payload. Each task therefore emits every magic it
finds as a candidate, with the place of its successor if it were a record: the
header states the length. The true records are those that are reachable from
the start of their file. Pointer jumping finds them in as many rounds as the
logarithm of the longest chain: each round doubles the pointers and marks what
marked candidates point at. Payloads are digested where they are read; only
records whose payload holds a magic are put together in a second pass.

Defined results: a null html is the empty payload; a null or empty URL is
``about:blank``; rows that repeat a page id are one record each, and responses
alike if they repeat the payload too; rows without an id get a record without a
number, which revisits the largest id of its payload or, where there is none, is a
response; extra columns play no part. Archives are cut between records, so an unfinished last record of a
file is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch_folder, stored

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Records of one file, which bounds a file's length and the rounds of a chain.
FILE_RECORDS = 4096


def base32(digest_hex: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 5 of them are 4 letters."""
    parts = []
    for start in range(1, 41, 5):
        number = F.conv(F.substring(digest_hex, start, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1
            parts.append(F.substr(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*parts)


def payload_digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record): the text of each page's record, from its magic to the end of its block.

    Of equal payloads of at least ``least_bytes``, the largest id is the response.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    url = F.when(F.coalesce(F.trim(url_col), F.lit("")) == "", F.lit("about:blank")).otherwise(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "_"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), url.alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("bytes")
    )
    # Thin rows find the response of each digest that occurs again. These are written, so that
    # the planner knows their size, and payloads move only where they are too many to send around.
    firsts = rows.filter(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n"))
    several = stored(firsts.filter("n > 1").select(F.unhex("sha").alias("digest"), "response"), "warc-repeated")
    marked = rows.join(several, F.unhex("sha") == F.col("digest"), "left")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.encode(http, "utf-8")).otherwise(F.concat(F.encode(http, "utf-8"), F.col("payload")))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("response").cast("string"), F.lit(">\r\n"))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("sha")),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    return marked.withColumn("block", block).select(F.concat(F.encode(header, "utf-8"), F.col("block")).cast("string").alias("record"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    records(pages, **options).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _field(header: Column, name: str) -> Column:
    """The value of a named header line, or the empty string."""
    return F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, body): what follows each magic up to the next one, with the byte where the magic begins.

    Spark splits files anywhere. Within a split places follow from the lengths
    of its pieces; the splits' lengths, one row each, give where each begins.
    """
    pieces = spark.read.option("lineSep", MAGIC).text(path)
    pieces = pieces.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("body")
    )
    return pieces.withColumn("bytes", F.octet_length("body") + len(MAGIC))


def placed(pieces: DataFrame) -> DataFrame:
    """Thin rows (file, split, row, bytes, ...) with ``at``, where the magic before the piece begins.

    A file has few enough pieces (its records and what magic their payloads hold)
    for one window; the first piece of a file is what stands before its first magic.
    """
    order = Window.partitionBy("file").orderBy("split", "row")
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("at", before - len(MAGIC)).filter("at IS NOT NULL")


def parsed(pieces: DataFrame) -> DataFrame:
    """Thin rows: header values, and the digest of the payload if the piece holds the whole record."""
    text = F.col("body").cast("string")
    cut = F.locate("\r\n\r\n", text)
    header = F.when(cut > 0, F.substring_index(text, "\r\n\r\n", 1))
    rows = pieces.withColumn("header", header)
    head_bytes = F.octet_length("header") + 4
    stated = F.regexp_extract(_field(F.col("header"), "Content-Length"), r"^(\d{1,18})\s*$", 1)
    rows = rows.withColumn("length", stated.try_cast("long"))
    rows = rows.withColumn("head", head_bytes).withColumn("span", F.lit(len(MAGIC)) + F.col("head") + F.col("length") + len(RECORD_END))
    whole = F.col("bytes") == F.col("span")
    content = F.when(whole, F.substring(F.col("body"), F.col("head") + 1, F.col("length").cast("int")))
    return rows.select("file", "split", "row", "bytes", "span", *record_values(F.col("header"), content), whole.alias("whole"))


def record_values(header: Column, content: Column) -> list[Column]:
    """Header values of a record, and length and digest of its payload (HTTP header left out)."""
    http_end = F.locate("\r\n\r\n", content.cast("string"))
    http = F.substring_index(content.cast("string"), "\r\n\r\n", 1)
    skip = F.octet_length(http) + 4
    payload = F.when(http_end > 0, F.substring(content, skip + 1, F.octet_length(content))).otherwise(content)
    return [
        F.regexp_extract(_field(header, "WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).alias("id"),
        _field(header, "WARC-Type").alias("type"),
        _field(header, "WARC-Payload-Digest").alias("stated"),
        F.regexp_extract(_field(header, "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).alias("refers"),
        _field(http, "Content-Length").alias("http_length"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        payload_digest(payload).alias("digest"),
    ]


def reachable(links: DataFrame) -> DataFrame:
    """Rows (file, at) of ``links`` (file, at, to) that the start of their file leads to."""
    known = links.select("file", F.col("at").alias("to"))
    now = stored(
        links.join(known, ["file", "to"], "left_semi")
        .unionByName(links.join(known, ["file", "to"], "left_anti").withColumn("to", F.lit(None).cast("long")))
        .select("file", "at", "to", (F.col("at") == 0).alias("marked")),
        "warc-chain",
    )
    while not now.filter("to IS NOT NULL").isEmpty():
        target = now.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        jumped = now.join(target, ["file", "to"], "left").select("file", "at", F.col("next").alias("to"), "marked")
        reached = now.filter("marked AND to IS NOT NULL").select("file", F.col("to").alias("at"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("marked"))
        now = stored(jumped.unionByName(reached).groupBy("file", "at").agg(F.max("to").alias("to"), F.max("marked").alias("marked")), "warc-chain")
    return now.filter("marked").select("file", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, refers, payload_bytes, digest, stated, http_length) of every true record."""
    thin = stored(placed(parsed(candidates(spark, path))), "warc-candidates")
    # A record reaches as far as its header says; the last one may lack its blank lines.
    reached = stored(reachable(thin.filter("span IS NOT NULL").select("file", "at", (F.col("at") + F.col("span")).alias("to"))), "warc-true")
    marked = thin.join(reached.withColumn("reached", F.lit(True)), ["file", "at"], "left")
    owner = F.max(F.when(F.col("reached"), F.col("at"))).over(Window.partitionBy("file").orderBy("at"))
    owned = stored(marked.withColumn("owner", owner), "warc-owned")
    values = ["id", "type", "stated", "refers", "http_length", "payload_bytes", "digest"]
    single = owned.filter("reached AND whole").select(*values)
    # Records in several pieces: their files are read again, and the pieces put together.
    split = stored(owned.filter("reached AND NOT whole AND span IS NOT NULL").select("file", F.col("at").alias("owner"), "span"), "warc-split")
    files = split.select("file").distinct()
    if files.isEmpty():
        return single
    pieces = owned.select("file", "at", "owner").join(split, ["file", "owner"])
    again = candidates(spark, path).join(files, "file", "left_semi")
    bodies = placed(again).select("file", "at", "body").join(pieces, ["file", "at"])
    glued = bodies.groupBy("file", "owner").agg(
        F.max("span").alias("span"), F.sort_array(F.collect_list(F.struct("at", "body"))).alias("parts")
    )
    joined = F.aggregate(
        F.slice(F.col("parts"), 2, F.size("parts")), F.col("parts")[0]["body"], lambda acc, p: F.concat(acc, F.encode(F.lit(MAGIC), "utf-8"), p["body"])
    )
    whole = glued.withColumn("body", joined).withColumn("header", F.substring_index(F.col("body").cast("string"), "\r\n\r\n", 1))
    head = F.octet_length("header") + 4
    content = F.substring(F.col("body"), head + 1, (F.col("span") - len(MAGIC) - len(RECORD_END) - head).cast("int"))
    complete = whole.filter(F.octet_length("body") + len(MAGIC) >= F.col("span") - len(RECORD_END))
    return single.unionByName(complete.select(*record_values(F.col("header"), content)))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    found = read_archives(spark, path)
    revisit = F.col("type") == "revisit"
    return found.select(
        F.col("id").try_cast("long").alias("page_id"),
        F.when(revisit, F.col("http_length").try_cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, F.col("refers").try_cast("long")).alias("refers_to"),
    )


OP3_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), t AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
         1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM t
"""
