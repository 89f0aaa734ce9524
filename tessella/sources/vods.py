"""Landed pages of the platform's answers as rows: recordings and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import blank_to_null, duration_seconds, iso_time, thumbnail, vod_url
from tessella.operators.catalog import first_per
from tessella.schemas import VOD_PAGE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON pages, one object a line."""
    return spark.read.schema(VOD_PAGE).json(path)


def page_rows(pages: DataFrame) -> DataFrame:
    """The recordings of all pages with where they stood: (user_id, page, ord, id, title, duration, ...)."""
    return pages.select("user_id", "page", F.posexplode("data").alias("ord", "v")).select("user_id", "page", "ord", "v.*")


def _order() -> Column:
    """When a recording was made; blank or bad times count as before all others."""
    return F.coalesce(iso_time(F.col("created_at")), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def normalised(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user_id", F.trim("id").alias("vod_id"), vod_url(F.col("id")).alias("url"), F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled stream")).alias("title"), duration_seconds(F.col("duration")).alias("duration_seconds"),
        F.coalesce(F.col("created_at"), F.lit("")).alias("created_at"), thumbnail(F.col("thumbnail_url")).alias("thumbnail_url"), F.coalesce(blank_to_null(F.col("viewable")), F.lit("public")).alias("viewable"),
    )


def vods_since(pages: DataFrame, cutoff: Column) -> DataFrame:
    """The recordings made at ``cutoff`` or later that have an id, newest first."""
    rows = page_rows(pages).withColumn("at", _order()).where((F.col("at") >= cutoff) & blank_to_null(F.col("id")).isNotNull())
    kept = rows.orderBy(F.desc("at"), "page", "ord")
    return normalised(kept)


def latest_vod(pages: DataFrame) -> DataFrame:
    """Each user's newest recording, the first on ties; none if that one has no id."""
    rows = first_per(page_rows(pages).withColumn("at", _order()), ["user_id"], F.desc("at"), "page", "ord")
    return normalised(rows.where(blank_to_null(F.col("id")).isNotNull()))


def user_profiles(raw: DataFrame) -> DataFrame:
    """(id, login, display_name, profile_image_url, problem) from ``raw(id, login, display_name, profile_image_url)``."""
    login = F.lower(F.trim("login"))
    return raw.select(
        blank_to_null(F.col("id")).alias("id"), login.alias("login"), F.coalesce(blank_to_null(F.col("display_name")), login).alias("display_name"),
        blank_to_null(F.col("profile_image_url")).alias("profile_image_url"), F.when(blank_to_null(F.col("id")).isNull(), "missing id").alias("problem"),
    )
