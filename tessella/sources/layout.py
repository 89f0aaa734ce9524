"""The vectors of the index laid out by creator, so that a search in some creators reads no others' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.schemas import EMBEDDINGS

#: The declared columns, the scope last, as it is a folder.
SCOPED = T.StructType([*[f for f in EMBEDDINGS if f.name != "creator_id"], EMBEDDINGS["creator_id"]])


def write_scoped(vectors: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "overwrite") -> None:
    """One folder a creator. Ranges over (creator, id) are written, so a large creator gets several files and a small one a single file."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in vectors.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCOPED]
    rows = vectors.where("creator_id > 0 and fingerprint_id is not null").select(*columns)
    rows.repartitionByRange("creator_id", "fingerprint_id").sortWithinPartitions("creator_id", "fingerprint_id").write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("creator_id").parquet(path)


def read_scoped(spark: SparkSession, path: str) -> DataFrame:
    """The vectors with their declared schema: no file is opened to find it."""
    return spark.read.schema(SCOPED).parquet(path)


def in_scopes(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The vectors of the creators in ``wanted(creator_id)``: where folders are creators, only theirs are read (found at run time)."""
    return vectors.join(wanted.select("creator_id").where("creator_id > 0").distinct(), "creator_id", "left_semi").select(*vectors.columns)
