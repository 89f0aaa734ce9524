"""Column helpers: times, urls, names, status and score text. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("indexing", "searchable", "deleted", "reindex_requested")
PLATFORM = "https://www.twitch.tv/videos/"
#: What a request's failure is reported as.
FAILURES = {"input": ("INVALID_SEARCH_INPUT", 400), "streamer": ("INVALID_STREAMER", 400), "duration": ("INPUT_DURATION_EXCEEDED", 400), "upload": ("INVALID_UPLOAD", 400), "url": ("INVALID_TIKTOK_URL", 400), "download": ("DOWNLOAD_ERROR", 400), "value": ("PROCESSING_ERROR", 400), "unexpected": ("PROCESSING_ERROR", 500)}


def squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    """Length plus 1e-10, so that a zero vector scores 0."""
    return F.sqrt(squares(v)) + F.lit(1e-10)


def l2_normalised(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def rounded_offset(x: Column) -> Column:
    """To the nearest whole number, halves to even."""
    return F.rint(x).cast("long")


def offset_text(seconds: Column) -> Column:
    """1h2m3s, 22m48s or 59s; null for null or negative seconds."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    text = F.when(h > 0, F.format_string("%dh%dm%ds", h, m, r)).when(m > 0, F.format_string("%dm%ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.when(s >= 0, text)


def _form_encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(F.try_url_decode(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def timestamp_url(url: Column, seconds: Column) -> Column:
    """The url with its ``t`` parameter replaced; null without scheme, host or a time of 0 or more."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & (F.try_url_decode(F.substring_index(p, "=", 1)) != "t"))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise(F.lit(""))
    kept = F.transform(pairs, lambda p: F.concat(_form_encoded(F.substring_index(p, "=", 1)), F.lit("="), _form_encoded(value(p))))
    query = F.array_join(F.concat(kept, F.array(F.concat(F.lit("t="), offset_text(seconds)))), "&")
    base = F.concat(F.lower(part(1)), F.lit("://"), part(2), part(3), F.lit("?"), query, F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise(""))
    return F.when((part(1) != "") & (part(2) != "") & (seconds >= 0), base)


def host_name(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(host, F.lit(""))


def duration_seconds(text: Column) -> Column:
    """Seconds of text such as 1h2m3s; other letters are skipped, a unit without a number counts nothing."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9hms]", "")
    parts = F.regexp_extract_all(clean, F.lit("([0-9]+[hms])"), F.lit(1))
    unit = lambda p: F.when(p.endswith("h"), 3600).when(p.endswith("m"), 60).otherwise(1)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + F.regexp_extract(p, "^([0-9]+)", 1).cast("long") * unit(p))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def name_key(x: Column) -> Column:
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def vod_url(vod_id: Column) -> Column:
    return F.concat(F.lit(PLATFORM), F.trim(vod_id))


def thumbnail(template: Column, width: int = 320, height: int = 180) -> Column:
    return F.replace(F.replace(blank_to_null(template), F.lit("%{width}"), F.lit(str(width))), F.lit("%{height}"), F.lit(str(height)))


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text, UTC where no zone is given; null where it is blank or bad."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def iso_text(ts: Column) -> Column:
    """ISO text that ends in Z; microseconds only where they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1000000
    return F.when(micros == 0, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.format_string(".%06dZ", micros)))


def input_type(filename: Column, url: Column) -> Column:
    has_file, has_url = blank_to_null(filename).isNotNull(), blank_to_null(url).isNotNull()
    return F.when(has_file & has_url, "both").when(has_file, "file").when(has_url, "tiktok_url")


def milliseconds(seconds: Column) -> Column:
    return F.greatest(F.rint(seconds * 1000).cast("int"), F.lit(0))


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS, floored and at least 0; null where not finite."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf")), text)


def processed_of(status: Column) -> Column:
    return status != "indexing"


def status_of(processed: Column) -> Column:
    return F.when(processed, "searchable").otherwise("indexing")


def normal_status(status: Column) -> Column:
    """Trimmed lower case if it is one of the four states, else null."""
    s = F.lower(F.trim(status))
    return F.when(s.isin(*STATUSES), s)


def default_title(title: Column, streamer: Column, live: bool = False) -> Column:
    return F.coalesce(blank_to_null(title), F.concat(F.lit("Live stream by " if live else "Stream by "), streamer))


def ratio_text(x: Column) -> Column:
    """Three decimals, halves to even."""
    return F.format_string("%.3f", F.bround(x, 3))


def failure_code(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (code, _) in FAILURES.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def failure_status(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (_, status) in FAILURES.items():
        out = F.when(kind == name, F.lit(status)).otherwise(out)
    return out
