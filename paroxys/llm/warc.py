"""WARC archives whose repeated payloads are stored once.

Digests and ids alone are grouped to find the original of each payload; the rows then
learn their part by an equality join on the digest, which Spark can split where one
payload is held by many pages. Originals become ``response`` records, the others
``revisit`` records with fresh headers and no block. Reading an archive back joins each
revisit to its original by digest and id.

A record is one value of Spark's text writer, which ends it with the two blank lines of
the format, so any file system Spark knows can hold archives and tasks can fail and be
repeated. Every archive draws a new warcinfo id; ``WARC/1.1`` and that id's header open
each record and no payload can foresee them, so the reader cuts records there and checks
each block against its length and digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys.llm.common import fresh, written
from paroxys.session import shared_folder

MIN_REVISIT_BYTES = 100
END = "\r\n\r\n"
#: Fixed value: profile of revisits with an identical payload (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _opening(archive: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"


def resolve(
    pages: DataFrame, page_id: str = "page_id", payload: str = "html", min_bytes: int = MIN_REVISIT_BYTES
) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``pages`` plus ``size``, ``digest`` and ``origin`` under fresh names.

    ``origin`` is the smallest id among rows with an equal payload of at least
    ``min_bytes`` bytes, and null on that row itself and on smaller payloads. Null
    payloads are empty. A null id counts as larger than any other. Rows that repeat the
    original's id and payload are originals too. An empty table stays empty.
    """
    size, digest, origin = fresh(pages, "size", "digest", "origin")
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.withColumns({size: F.length(body).cast("bigint"), digest: F.sha2(body, 256)})
    headers = rows.where(F.col(size) >= min_bytes).select(digest, page_id)
    first = headers.groupBy(digest).agg(F.min(page_id).alias(origin), F.count("*").alias(size))
    # Only digests held more than once; stored, so that Spark can split hot ones in the join.
    first = written(first.where(F.col(size) > 1).drop(size), "origins")
    joined = rows.join(first, digest, "left")
    small = (F.col(size) < min_bytes) | F.col(page_id).eqNullSafe(F.col(origin))
    part = F.when(small, F.lit(None)).otherwise(F.col(origin))
    return joined.select(*pages.columns, size, digest, part.alias(origin)), {
        "size": size,
        "digest": digest,
        "origin": origin,
    }


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line breaks cannot enter it."""
    clean = F.regexp_replace(value.cast("string"), "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_bytes: int = MIN_REVISIT_BYTES,
) -> str:
    """Write the deduplicated archive to ``folder``; returns the archive's id.

    A null url leaves out the target header. ``date`` stands for the unknown time of
    capture of every record.
    """
    archive = str(uuid.uuid4())
    rows, names = resolve(pages, page_id, payload, min_bytes)
    revisit = F.col(names["origin"]).isNotNull()
    block = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    origin_id = F.when(revisit, F.col(names["origin"]).cast("string"))
    record = F.concat(
        F.lit(_opening(archive)),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col(url)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col(names["digest"]))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), origin_id, F.lit(">"))),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("Content-Type", F.when(~revisit, "text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col(names["size"]))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(block),
    )
    rows.select(record.alias("value")).write.text(folder, compression="gzip", lineSep=END)
    return archive


def read_archive(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """``(record_type, page_id, url, digest, refers_to, length, block)`` of every record.

    Fails on a record whose block does not have the length its header tells, or, for
    responses, the digest. An empty archive has no rows.
    """
    lines = spark.read.schema("value string").text(folder, lineSep=_opening(archive))
    raw, blank = F.col("value"), F.instr("value", END)
    head = F.concat(F.lit("\r\n"), F.substring(raw, F.lit(1), blank + 1))

    def field(name: str) -> Column:
        found = F.regexp_extract(head, f"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1), F.lit(""))

    records = lines.where(F.length(raw) > 0).select(
        field("WARC-Type").alias("record_type"),
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        page("WARC-Refers-To").alias("refers_to"),
        field("Content-Length").cast("bigint").alias("length"),
        # Between the blank line after the headers and the two that end the record.
        F.substring(raw, blank + len(END), F.length(raw) - blank - 2 * len(END) + 1).alias("block"),
    )
    bytes_ = F.col("block").cast("binary")
    sound = (F.length(bytes_) == F.col("length")) & (
        (F.col("record_type") == "revisit") | (F.sha2(bytes_, 256) == F.col("digest"))
    )
    broken = F.raise_error(F.concat(F.lit("broken record "), F.coalesce("page_id", F.lit("without id"))))
    return records.withColumn("block", F.when(sound, F.col("block")).otherwise(broken.cast("string")))


def archived_pages(records: DataFrame, with_block: bool = False) -> DataFrame:
    """Each record with its full payload's size (and text): revisits join their original.

    A revisit whose original is not in the archive keeps a null size.
    """
    whole = records.where("record_type = 'response'").select(
        F.col("digest"),
        F.col("page_id").alias("refers_to"),
        F.col("length").alias("whole"),
        *([F.col("block").alias("whole_block")] if with_block else []),
    )
    # An original listed twice has equal records; one of them answers.
    whole = whole.dropDuplicates(["digest", "refers_to"])
    base = records.where("record_type = 'revisit'").drop("length", "block")
    found = base.join(whole, ["digest", "refers_to"], "left").select(
        "page_id",
        "url",
        "digest",
        "record_type",
        "refers_to",
        F.col("whole").alias("payload_bytes"),
        *([F.col("whole_block").alias("payload")] if with_block else []),
    )
    own = records.where("record_type = 'response'").select(
        "page_id",
        "url",
        "digest",
        "record_type",
        "refers_to",
        F.col("length").alias("payload_bytes"),
        *([F.col("block").alias("payload")] if with_block else []),
    )
    return own.unionAll(found)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archive to the shared folder and report every page as read back."""
    kind = dict(pages.dtypes)[page_id]
    folder = shared_folder(pages.sparkSession, "warc")
    archive = write_archive(pages.select(page_id, url, payload), folder, page_id, url, payload)
    rows = archived_pages(read_archive(pages.sparkSession, folder, archive))
    return rows.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
