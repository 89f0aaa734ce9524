"""Validation of search requests and the rows of the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.scalars import blank_to_null, failure_code, failure_status, host_name, input_type, milliseconds, name_key

#: Hosts that clips are taken from, and the largest download.
HOSTS = ("tiktok.com", "www.tiktok.com", "m.tiktok.com", "vm.tiktok.com", "vt.tiktok.com")
MAX_MB = 200
MAX_SECONDS = 180
#: Fixed value: the route that search requests are logged under.
SEARCH_ROUTE = "/api/search/clip"


def url_problem(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """What is wrong with a clip's url, or null."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    # fixed values: the texts that callers see
    return (
        F.when(u == "", "TikTok URL is required").when(~scheme.isin("http", "https"), "TikTok URL must use http or https")
        .when(~F.coalesce(host_name(u).isin(*hosts), F.lit(False)), "Only TikTok URLs are supported")
    )


def duration_problem(seconds: Column, most: float | None = MAX_SECONDS) -> Column:
    if most is None:
        return F.lit(None).cast("string")
    return F.when(seconds > most, F.format_string(f"Input video is %ds; maximum allowed is {most}s", F.ceil(seconds).cast("long")))


def probed_seconds(raw: Column) -> Column:
    """The seconds that a duration probe printed, or null where it printed no positive number."""
    seconds = F.trim(F.coalesce(raw, F.lit(""))).try_cast("double")
    return F.when(seconds > 0, seconds)


def probe_problem(raw: Column) -> Column:
    """What is wrong with a probe's answer, or null. The text is a fixed value."""
    return F.when(probed_seconds(raw).isNull(), "Could not determine input video duration")


def file_problem(filename: Column, size: Column) -> Column:
    """What is wrong with an uploaded file, or null. The texts are fixed values."""
    return F.when(blank_to_null(filename).isNull(), "Uploaded file must have a filename").when(F.coalesce(size, F.lit(0)) <= 0, "Uploaded file is empty")


def download_problem(size: Column, most_mb: int | None = MAX_MB) -> Column:
    """What is wrong with a downloaded file of ``size`` bytes (null: there is none), or null. The texts are fixed values."""
    problem = F.when(size.isNull(), "Downloaded file was not created").when(size <= 0, "Downloaded file is empty")
    return problem if most_mb is None else problem.when(size > most_mb * 1024 * 1024, f"Downloaded file exceeds {most_mb}MB limit")


def validate_requests(requests: DataFrame, searchable: DataFrame, max_seconds: float | None = MAX_SECONDS) -> DataFrame:
    """Each request with its failure (a kind), message, code and status, in the order of the checks.

    ``requests(request_id, source_app, filename, file_size, tiktok_url, streamer, duration_seconds)``; ``searchable(name)``.
    The public route takes urls alone; the other one a url or a file, and a file may come without a name. Where there is
    a column ``downloaded_bytes``, downloads are checked too.
    """
    known = searchable.select(name_key(F.col("name")).alias("key")).distinct().withColumn("searchable", F.lit(True))
    rows = requests.withColumn("key", name_key(F.col("streamer"))).join(known, "key", "left")
    public = F.col("source_app") == "public"
    has_url = blank_to_null(F.col("tiktok_url")).isNotNull()
    has_file = ~public & F.col("filename").isNotNull()
    from_url, from_file, long = url_problem(F.col("tiktok_url")), file_problem(F.col("filename"), F.col("file_size")), duration_problem(F.col("duration_seconds"), max_seconds)
    downloaded = download_problem(F.col("downloaded_bytes")) if "downloaded_bytes" in requests.columns else F.lit(None).cast("string")
    # fixed values: the texts that callers see
    checks = [
        (public & ~has_url, "input", F.lit("tiktok_url is required")),
        (~public & (has_file == has_url), "input", F.lit("Provide exactly one of file or tiktok_url")),
        (F.col("key").isNull(), "streamer", F.lit("streamer is required")),
        (F.col("searchable").isNull(), "streamer", F.concat(F.lit("Streamer is not searchable: "), F.col("key"))),
        (has_url & from_url.isNotNull(), "url", from_url),
        (has_file & from_file.isNotNull(), "upload", from_file),
        (has_url & downloaded.isNotNull(), "download", downloaded),
        (long.isNotNull(), "duration", long),
    ]
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bad, name, text in reversed(checks):
        kind, message = F.when(bad, name).otherwise(kind), F.when(bad, text).otherwise(message)
    judged = rows.withColumn("failure", kind).withColumn("error_message", message)
    return judged.select("request_id", "source_app", F.col("failure").isNull().alias("valid"), failure_code(F.col("failure")).alias("error_code"), failure_status(F.col("failure")).alias("http_status"), "error_message")


def answer_problem(embeddings: Column, timestamps: Column, stated: Column, width: int) -> Column:
    """What is wrong with an embedder's answer for a clip, or null: ``stated`` width, ``width`` of a row, ``length`` of the two lists, ``time`` that falls.

    An answer without rows and times is right if it states the right width.
    """
    falls = F.exists(F.transform(timestamps, lambda t, i: (i > 0) & (t < F.get(timestamps, i - 1))), lambda x: F.coalesce(x, F.lit(False)))
    empty = (F.size(embeddings) == 0) & (F.size(timestamps) == 0)
    return (
        F.when(~stated.eqNullSafe(F.lit(width)), "stated").when(empty, F.lit(None).cast("string")).when(F.exists(embeddings, lambda e: ~F.size(e).eqNullSafe(F.lit(width))), "width")
        .when(F.size(embeddings) != F.size(timestamps), "length").when(falls, "time")
    )


def request_log_rows(outcomes: DataFrame) -> DataFrame:
    """Log rows from request outcomes: names and hosts normalised, seconds as whole milliseconds.

    What a search measured (``meta_*``) comes before what it answered (``result_*``); columns that ``outcomes`` lacks
    are null.
    """
    has = set(outcomes.columns)
    given = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    either = lambda c, kind: F.coalesce(given(f"meta_{c}", kind), given(f"result_{c}", kind)).alias(c)
    stage = lambda c: (milliseconds(F.col(f"{c}_seconds")) if f"{c}_seconds" in has else F.lit(None).cast("int")).alias(f"{c}_duration_ms")
    said = F.when(given("meta_reason", "string") != "", given("meta_reason", "string"))  # an empty reason is none
    return outcomes.select(
        "created_at", "source_app", F.lit(SEARCH_ROUTE).alias("route"), input_type(F.col("filename"), F.col("tiktok_url")).alias("input_type"), name_key(F.col("streamer")).alias("streamer"),
        given("creator_id", "long").alias("creator_id"), "success", F.coalesce("http_status", F.lit(200)).alias("http_status"), given("error_code", "string").alias("error_code"), given("error_message", "string").alias("error_message"),
        F.coalesce(said, given("result_reason", "string")).alias("result_reason"), either("found_match", "boolean"), either("matched_video_id", "long"), either("matched_timestamp_seconds", "int"), either("score", "double"),
        blank_to_null(F.col("filename")).alias("clip_filename"), F.when(blank_to_null(F.col("tiktok_url")).isNotNull(), "tiktok").alias("download_source"), host_name(F.col("tiktok_url")).alias("download_host"),
        given("input_duration_seconds", "double").alias("input_duration_seconds"), stage("total"), stage("preprocess"), stage("embed"), stage("vector_query"), stage("alignment"),
    )


def monotonic_violations(segments: DataFrame, dim: int | None = None) -> DataFrame:
    """(clip_id, seg_ord, problem) of segments whose time falls, or whose vector has another width than ``dim``."""
    w = W.partitionBy("clip_id").orderBy("seg_ord")
    rows = segments.withColumn("before", F.lag("q_time").over(w))
    problem = F.when(F.col("q_time") < F.col("before"), "time")
    if dim is not None:
        problem = F.when(F.size("embedding") != dim, "width").otherwise(problem)
    return rows.withColumn("problem", problem).where("problem is not null").select("clip_id", "seg_ord", "problem")


def clip_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max(F.size("embedding")).alias("dim"), (F.max("q_time") - F.min("q_time") + 1).alias("duration_seconds"))


def largest_file(files: DataFrame, group: str) -> DataFrame:
    """The path of the largest file of each group, the first path on ties."""
    return files.groupBy(group).agg(F.min_by("path", F.struct(-F.col("length"), "path")).alias("path"), F.max("length").alias("length"))
