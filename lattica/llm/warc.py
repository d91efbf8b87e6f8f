"""Content-addressed web archive: payload bytes once, exact record headers apart, records by a join.

``write_archive`` stores two tables: ``headers`` has one row per record with the exact header bytes,
``payloads`` has the bytes of each distinct payload once under its SHA-256.  ``records`` joins them
back into original records and refuses a payload whose bytes do not hash to their address.
``export_warc`` writes plain WARC 1.1 files and ``read_warc`` reads such files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
RECORDS = "header string, payload binary"


#: Characters that may not stand in a header line: controls, and what some readers take for a line's end.
BREAKS = r"[\x00-\x1F\x7F\u0085\u2028\u2029]"


def one_line(text: Column) -> Column:
    """The text with controls and line ends percent-encoded as UTF-8."""
    encoded = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(BREAKS), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(text.rlike(BREAKS), F.array_join(encoded, "")).otherwise(text)


def page_uri(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">")), F.lit("<urn:page-without-id>"))


def header_block(page_id: Column, url: Column, digest: Column, full_bytes: Column, stored_bytes: Column, refers_to: Column) -> Column:
    """The header lines of a response or, where ``refers_to`` is not null, of a revisit record."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), page_uri(page_id)),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), one_line(F.coalesce(url, F.lit("")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("WARC-Payload-Length: "), full_bytes.cast("string")),
        F.when(refers_to.isNotNull(), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), page_uri(refers_to))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), stored_bytes.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF))


def header_field(header: Column, name: str) -> Column:
    """Value of a header line, null where there is none. Lines end in CRLF alone, as in the format."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\r\n){name}: ?([^\r\n]*)", 1), F.lit(""))


def write_archive(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write ``path/headers`` and ``path/payloads`` from pages (page_id, url, html).

    Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id is the
    response and the others revisit it; shorter ones are all responses.  A null html is an empty
    payload.  Null page_ids come after all others; rows that share the smallest page_id of their
    payload (repeats of one record) are all responses.  Controls and line ends of a url are
    percent-encoded in its header line.  An empty table gives an empty archive.  Extra columns are
    not read.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("full_bytes", F.octet_length("payload").cast("long"))
    heads = rows.drop("payload")
    # One payload a digest: partial aggregation leaves each task's first before the shuffle. Rows of
    # one address that differ in size or in a second, independent hash would show a collision.
    rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("full_bytes").alias("full_bytes"), F.max("full_bytes").alias("most"), F.min(F.xxhash64("payload")).alias("check"), F.max(F.xxhash64("payload")).alias("check_most")).select(
        "digest", F.when((F.col("full_bytes") == F.col("most")) & (F.col("check") == F.col("check_most")), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("payload"), "full_bytes"
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    first = heads.where(F.col("full_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    known = heads.join(first, "digest", "left")
    refers_to = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    known = known.withColumn("refers_to", refers_to)
    known.select(
        "digest",
        header_block(F.col("page_id"), F.col("url"), F.col("digest"), F.col("full_bytes"), F.when(F.col("refers_to").isNull(), F.col("full_bytes")).otherwise(F.lit(0)), F.col("refers_to")).alias("header"),
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: (header, payload, full_bytes, digest), payloads in full for revisits too.

    The digest is computed anew, once for each stored payload, and a payload that does not match its
    address stops the read.
    """
    payloads = spark.read.schema("digest string, payload binary, full_bytes long").parquet(f"{path}/payloads")
    sound = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))))
    return spark.read.schema("digest string, header string").parquet(f"{path}/headers").join(sound, "digest")


def page_rows(recs: DataFrame, page_id: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), parsed from the records' headers; ids become of type ``page_id``.

    The digest is the one by which the payload was found and checked, where ``recs`` has it, else the
    header's. A null id stays null; one that is no value of the type stops the read. A url that was
    null is empty, and its controls and line ends stay percent-encoded.
    """
    h = F.col("header")
    number = lambda name: F.when(header_field(h, name).startswith("<urn:page:"), F.url_decode(F.regexp_extract(header_field(h, name), "<urn:page:([^>]*)>", 1)).cast(page_id))
    digest = F.col("digest") if "digest" in recs.columns else F.regexp_extract(header_field(h, "WARC-Payload-Digest"), "sha256:([0-9a-f]+)", 1)
    return recs.select(
        number("WARC-Record-ID").alias("page_id"),
        F.coalesce(header_field(h, "WARC-Target-URI"), F.lit("")).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        header_field(h, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )


def export_warc(spark: SparkSession, archive: str, path: str, records_per_file: int = 2000) -> None:
    """Write the archive's records as WARC files: each record ends in two CRLFs, which serve as the text writer's separator. Revisits have no body, an empty archive gives no records; payloads must be UTF-8, as those of ``write_archive`` are."""
    recs = records(spark, archive)
    block = F.concat(F.col("header"), F.lit(CRLF), F.when(header_field(F.col("header"), "WARC-Type") == "response", F.col("payload").cast("string")).otherwise(""))
    recs.select(block.alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of every record in plain WARC files, cut by Content-Length; a file is one task's unit.

    An empty file has no records. A file that ends inside a record, or a header without a whole number
    as Content-Length, stops the read with an error: what follows in the file cannot be trusted.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data, at, out = content.as_buffer().to_pybytes(), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    head = data[at : end + 2].decode()
                    size = int(next((x.split(":", 1)[1] for x in head.split(CRLF) if x.lower().startswith("content-length:")), "missing"))
                    if end + 4 + size > len(data) or size < 0:
                        raise ValueError(f"a WARC file ends inside a record of {size} bytes")
                    out.append((head, data[end + 4 : end + 4 + size]))
                    at = end + 4 + size + 4
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["header", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORDS)
