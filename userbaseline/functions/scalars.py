"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space and as a digit when a text is cleaned.
WHITE_SPACE = r"[ \t\r\n\f\x0B]+"
DIGITS = "[0-9]+"
# Fixed value: the shortest term that is counted.
MIN_TERM_CHARS = 3


def day_text(stamp: Column) -> Column:
    """The day part of an hour stamp ``yyyyMMddHH``."""
    return F.substring(stamp, 1, 8)


def day_from_stamp(stamp: Column) -> Column:
    return F.try_to_date(day_text(stamp), "yyyyMMdd")


def _start(stamp: Column, time_created: Column, second: Column) -> Column:
    """The start built from its parts: no zoned timestamp in between, so no zone can shift it."""
    part = lambda at, n: F.substring(stamp, at, n).try_cast("int")
    parts = [part(1, 4), part(5, 2), part(7, 2), part(9, 2), F.minute(time_created)]
    built = F.try_make_timestamp_ntz(*parts, second)
    return F.when(stamp.rlike("^[0-9]{10}$"), built)


def session_start(stamp: Column, time_created: Column) -> Column:
    """Start to the second: the hour from ``stamp``, minute and second from ``time_created``."""
    return _start(stamp, time_created, F.second(time_created).cast("decimal(16,6)"))


def session_start_minute(stamp: Column, time_created: Column) -> Column:
    """Start truncated to the minute, the precision at which opt-in periods are tested."""
    zero = F.when(time_created.isNotNull(), F.lit(0).cast("decimal(16,6)"))
    return _start(stamp, time_created, zero)


def _interval_seconds(interval: Column) -> Column:
    """A day-time interval as exact seconds with six decimals."""
    part = lambda name: F.extract(F.lit(name), interval).cast("decimal(38,6)")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end: signed, truncated towards zero, NULL if either is.

    Both are times without a zone; their difference is that of the clock readings.
    """
    return _interval_seconds(end - start).cast("long")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def as_instant(clock: Column) -> Column:
    """A time without a zone as the instant with that reading in UTC, whatever the session's zone."""
    return F.timestamp_micros((_interval_seconds(clock - _epoch()) * 1_000_000).cast("long"))


def as_clock(instant: Column) -> Column:
    """The inverse of :func:`as_instant`."""
    micros = F.unix_micros(instant)
    return _epoch() + F.make_dt_interval(secs=(micros.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def trim_commas(text: Column) -> Column:
    return F.btrim(text, F.lit(","))


def aes_key(key_hex: Column) -> Column:
    """The 16-byte key that MySQL makes of a key of any length: pieces of 16 bytes, the last one
    filled up with zeros, combined by exclusive or. Bad hex gives NULL."""
    digits = F.hex(F.unhex(key_hex))
    pieces = F.greatest(F.ceil(F.length(digits) / 32), F.lit(1)).cast("int")
    padded = F.rpad(digits, pieces * 32, F.lit("0"))

    def half(start: int) -> Column:
        def fold(folded: Column, piece: Column) -> Column:
            part = F.substring(padded, piece * 32 + start, F.lit(16))
            return folded.bitwiseXOR(F.conv(part, 16, -10).cast("long"))

        whole = F.aggregate(F.sequence(F.lit(0), pieces - 1), F.lit(0).cast("long"), fold)
        return F.lpad(F.hex(whole), 16, "0")

    return F.unhex(F.concat(half(1), half(17)))


def decrypt_text(value: Column, key: Column) -> Column:
    """AES-ECB bytes to text. A missing key or damaged bytes give NULL."""
    return F.try_aes_decrypt(value, key, F.lit("ECB"), F.lit("PKCS")).cast("string")


def clean_text(text: Column) -> Column:
    """Lower case, digits removed, each run of white space made one space, ends kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), DIGITS, ""), WHITE_SPACE, " ")


def terms(text: Column) -> Column:
    """The terms of a cleaned text: split at white space, short ones left out."""
    # the split takes a run of white space as one, so there is no need to collapse it first
    words = F.split(F.regexp_replace(F.lower(text), DIGITS, ""), WHITE_SPACE)
    return F.filter(words, lambda t: F.char_length(t) >= MIN_TERM_CHARS)


def text_similarity(a: Column, b: Column) -> Column:
    """1 − edit distance / length of the longer text; two empty texts are alike."""
    return similarity_of(F.levenshtein(a, b), F.char_length(a), F.char_length(b))


def similarity_of(distance: Column, chars_a: Column, chars_b: Column) -> Column:
    longer = F.greatest(chars_a, chars_b)
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.try_divide(distance, longer))
