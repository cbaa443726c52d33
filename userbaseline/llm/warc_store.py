"""A content-addressed archive of WARC records: payloads once, headers apart, records by a join.

``headers`` holds each record's exact header block, ``payloads`` each distinct payload once under its
SHA-256. Of records whose payloads are equal and have at least ``REVISIT_BYTES`` bytes, the one with the
largest page_id is the ``response`` and the others are ``revisit`` records that name it; records of
smaller payloads are all responses, though their payload is stored once too. A payload is addressed by
its digest only after the digests of all its copies were found to agree with a second one (SHA-1) and
the length; reading recomputes both from the stored bytes. A mismatch raises.

A null html is an empty payload, a null url leaves its header line out, CR and LF in a url are
percent-encoded. Rows that share a page_id are records of their own; with the largest page_id they are
all responses. A null page_id sorts below all others and is written without a number. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from userbaseline.session import cut

REVISIT_BYTES = 1000
NEWLINE = "\r\n"
#: the profile that the WARC standard names for records of equal payloads
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url and the digests of every page; no payloads."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(
        "page_id", "url",
        F.octet_length(payload).cast("long").alias("n_bytes"),
        F.sha2(payload, 256).alias("digest"),
        F.sha1(payload).alias("sha1"),
    )


def write(pages: DataFrame, path: str) -> None:
    """Write the archive of ``pages`` below ``path``, which must be new."""
    rows = cut(records(pages))
    first = rows.groupBy("digest").agg(
        F.max("page_id").alias("newest"),
        F.min(F.struct("n_bytes", "sha1")).alias("low"),
        F.max(F.struct("n_bytes", "sha1")).alias("high"),
    )
    agreed = F.when(F.col("low") == F.col("high"), F.col("newest")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest")))
    )
    first.select("digest", agreed.alias("newest")).write.parquet(f"{path}/index")
    index = pages.sparkSession.read.parquet(f"{path}/index")

    met = rows.join(index, "digest")
    revisit = (F.col("n_bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    kind = F.when(revisit, "revisit").otherwise("response")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{NEWLINE}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("newest")))),
        ).otherwise(F.lit("")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(NEWLINE),
    )
    met.select("digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")

    # the page that gives the payload: the newest of its digest; rows that repeat it give the same bytes
    chosen = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    chosen = chosen.withColumn("digest", F.sha2("payload", 256))
    wanted = (F.col("c.digest") == F.col("i.digest")) & F.col("c.page_id").eqNullSafe(F.col("i.newest"))
    stored = chosen.alias("c").join(index.alias("i"), wanted, "left_semi")
    # only a page_id given more than once can repeat here, with the same digest
    once = stored.dropDuplicates(["digest"]) if _repeats(index, rows) else stored
    once.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _repeats(index: DataFrame, rows: DataFrame) -> bool:
    wanted = rows.join(index, (rows.digest == index.digest) & rows.page_id.eqNullSafe(index.newest), "left_semi")
    return wanted.count() > index.count()


def read(spark, path: str) -> DataFrame:
    """header, payload (bytes, checked against its digest) of every record, revisits with the payload
    they refer to."""
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    checked = payloads.select(
        "digest",
        F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"),
        F.sha1("payload").alias("sha1"),
    )
    return spark.read.parquet(f"{path}/headers").join(checked, "digest")


def record_bytes(header: Column, payload: Column) -> Column:
    """The record as it stands in a WARC file: header block, block, two line ends."""
    block = F.when(_field(header, "WARC-Type") == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(header, block, F.lit(b"\r\n\r\n"))


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return found


def parsed(rows: DataFrame) -> DataFrame:
    """The fields of the records that `read` gave. Each record is put together as it stands in a file and taken apart
    again: header lines, a block of the length they tell, the end. A record of another length raises, and so does a
    payload (the block, or what a revisit refers to) of another digest than its header tells."""
    made = rows.select("payload", record_bytes(F.col("header"), F.col("payload")).alias("record"))
    # bytes up to the first empty line; a cast leaves them as they are
    split = made.select("*", F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1).alias("lines"))
    header = F.encode(F.concat("lines", F.lit(NEWLINE)), "UTF-8")
    fields = split.select(
        "payload", "record", F.octet_length("lines").alias("head"),
        *[_field(header, name).alias(name) for name in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Refers-To")],
        _field(header, "Content-Length").cast("int").alias("length"),
    )
    block = F.substring(F.col("record"), F.col("head") + 5, F.col("length"))
    end = F.octet_length("record") == F.col("head") + 4 + F.col("length") + 4
    kind = F.col("WARC-Type")
    bodies = fields.withColumn("body", F.when(kind == "revisit", F.col("payload")).otherwise(block)).withColumn("end", end)
    page = lambda name: F.nullif(F.regexp_extract(F.col(name), "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    told = F.substring(F.col("WARC-Payload-Digest"), len("sha1:") + 1, 40)
    same = F.col("end") & (told == F.sha1("body"))
    return bodies.select(
        page("WARC-Record-ID").alias("page_id"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.when(same, told).otherwise(F.raise_error(F.concat(F.lit("payload and header differ: "), told))).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", page("WARC-Refers-To")).alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )
