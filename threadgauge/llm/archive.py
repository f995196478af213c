"""Content-addressed WARC archive.

Two Parquet tables: payloads (one row per distinct content under its SHA-256,
the bytes stored once) and records (the exact header block of every record and
the digest it points to). Original records come back through a join. On the way
in, equal digests are checked to have equal length and SHA-1; on the way out,
each payload is hashed again and must have the digest it is stored under.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgauge.llm.common import lookup, written

LEAST_REVISIT = 0
# The base-32 alphabet, the revisit profile and the line ends of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(content: Column) -> Column:
    """SHA-1 of bytes in upper-case base 32: each five hex digits are four letters."""
    digits = F.sha1(content)
    letters = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(digits, at + 1, 5), 16, 10).cast("int")
        for bits in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(number, bits).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _header(kind: str) -> Column:
    """The header block of a record; a revisit has no block of its own and names the record it repeats."""
    uid = F.format_string("<urn:warc:page:%d:%d>", F.col("page_id"), F.col("copy"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), uid), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
    ]
    if kind == "revisit":
        lines += [F.lit(f"WARC-Profile: {PROFILE}"), F.format_string("WARC-Refers-To: <urn:warc:page:%d:%d>", F.col("target_id"), F.col("target_copy"))]
    size = F.col("bytes") if kind == "response" else F.lit(0)
    lines += [F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), size.cast("string"))]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(LINE + LINE))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write the archive of ``pages`` below ``folder``.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest page_id is the response (null ids first; of repeated rows the last)
    and the others revisit it; shorter payloads are all responses. Null html is
    an empty payload, a null url an empty one; line breaks and other control
    characters in a url are percent-encoded. A null page_id is written as 0 with
    its own mark and comes back null. Other columns are ignored; no rows give an
    empty archive.
    """
    content = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    for code in (*range(0x20), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), url.alias("uri"), F.unhex(F.sha2(content, 256)).alias("digest"),
        F.octet_length(content).cast("bigint").alias("bytes"), base32_sha1(content).alias("sha1"), F.monotonically_increasing_id().alias("row"),
    )
    known = written(rows, "warc-in")
    repeats = known.groupBy("digest", "page_id").agg(
        F.max("row").alias("row"), F.count(F.lit(1)).alias("n"), F.min("bytes").alias("least"), F.max("bytes").alias("most"),
        F.min("sha1").alias("first_sha1"), F.max("sha1").alias("last_sha1"),
    )
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "row", F.col("n").alias("same")))
    sound = (F.min("least") == F.max("most")) & (F.min("first_sha1") == F.max("last_sha1"))
    groups = written(repeats.groupBy("digest").agg(last.alias("last"), F.sum("n").alias("n"), sound.alias("sound")), "warc-groups")
    if not groups.filter(~F.col("sound")).isEmpty():
        raise ValueError("different payloads under one digest")
    # The bytes travel under digest and id, so a group of copies is spread; only repeated rows can meet there.
    bodies = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("payload"))
    keepers = groups.select("digest", F.col("last.page_id").alias("keep_id"), F.col("last.same").alias("same"))
    once = keepers.filter("same = 1")
    on = (bodies["digest"] == once["digest"]) & bodies["page_id"].eqNullSafe(once["keep_id"])
    stored = bodies.join(once.hint("merge"), on, "left_semi").select("digest", "payload")
    more = keepers.filter("same > 1")
    if not more.isEmpty():
        on = (bodies["digest"] == more["digest"]) & bodies["page_id"].eqNullSafe(more["keep_id"])
        stored = stored.unionByName(bodies.join(more, on, "left_semi").select("digest", "payload").dropDuplicates(["digest"]))
    stored.write.parquet(f"{folder}/payloads")
    placed = lookup(known, groups.select("digest", "last", "n"), "digest", "n")
    placed = placed.withColumns({
        "copy": F.col("row"), "target_id": F.col("last.page_id"), "target_copy": F.col("last.row"),
        "kind": F.when((F.col("bytes") >= least) & (F.col("row") != F.col("last.row")), "revisit").otherwise("response"),
    }).withColumns({"null_id": F.col("page_id").isNull(), "null_target": F.col("target_id").isNull()})
    placed = placed.withColumns({"page_id": F.coalesce("page_id", F.lit(0)), "target_id": F.coalesce("target_id", F.lit(0))})
    header = F.when(F.col("kind") == "revisit", _header("revisit")).otherwise(_header("response"))
    placed.select(header.cast("binary").alias("header"), "digest", "bytes", "null_id", "null_target").write.parquet(f"{folder}/records")


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"\n{name}: {pattern}\r\n", 1)
    return F.when(found == "", None).otherwise(found)


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload, payload_bytes, payload_digest) of the store, each checked against its digest."""
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{folder}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return stored.select("digest", checked.alias("payload")).select(
        "digest", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, header, digest) of every record, from its header block."""
    stored = spark.read.schema("header binary, digest binary, bytes bigint, null_id boolean, null_target boolean").parquet(f"{folder}/records")
    page, target = r"<urn:warc:page:(-?\d+):\d+>", r"<urn:warc:page:(-?\d+):\d+>"
    return stored.select(
        F.when(~F.col("null_id"), _field("WARC-Record-ID", page).cast("bigint")).alias("page_id"),
        F.coalesce(_field("WARC-Target-URI", "(.*)"), F.lit("")).alias("url"), _field("WARC-Type", r"(\w+)").alias("record_type"),
        F.when(~F.col("null_target"), _field("WARC-Refers-To", target).cast("bigint")).alias("refers_to"), "header", "digest",
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, joined to its payload's figures."""
    heads = written(read_headers(spark, folder).drop("header", "url"), "warc-heads")
    sizes = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    figures = written(read_payloads(spark, folder).drop("payload").join(sizes, "digest"), "warc-figures")
    return lookup(heads, figures, "digest", "n").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record): the exact bytes of every record, header block, payload (none for a revisit) and record end."""
    heads = read_headers(spark, folder)
    end = F.lit(LINE + LINE).cast("binary")
    full = heads.filter("record_type = 'response'").join(read_payloads(spark, folder), "digest")
    return full.select("page_id", F.concat("header", "payload", end).alias("record")).unionByName(
        heads.filter("record_type = 'revisit'").select("page_id", F.concat("header", end).alias("record"))
    )
