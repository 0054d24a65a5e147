"""Readers for compressed JSON lines and CSV, with declared schemas and an explicit row number."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "parent_asin string, title string"
REVIEWS = "user_id string, parent_asin string, rating double, timestamp long"


def _guarded(read, path: str, role: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{role} not found: {path}") from e
        raise


def numbered(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """df with row_id in file order (gaps between splits), cut to the first max_rows rows."""
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    return df if max_rows is None else df.orderBy("row_id").limit(max_rows)


def read_json_lines(spark: SparkSession, path: str, schema: str = METADATA, max_rows: int | None = None, role: str = "JSON lines") -> DataFrame:
    """One object a line; a malformed line raises, a blank one is skipped. Only the columns of the schema are parsed."""
    return numbered(_guarded(lambda p: spark.read.schema(schema).option("mode", "FAILFAST").json(p), path, role), max_rows)


def read_csv(spark: SparkSession, path: str, schema: str = REVIEWS, role: str = "CSV", max_rows: int | None = None) -> DataFrame:
    """With a header, whose names are matched to the schema's whatever their order."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    raw = _guarded(lambda p: spark.read.option("header", True).option("mode", "FAILFAST").csv(p), path, role)
    kinds = dict(f.strip().split() for f in schema.split(","))
    return numbered(raw.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names]), max_rows)


def load_metadata_and_reviews(spark: SparkSession, metadata: str, reviews: str, max_rows_meta: int | None = None, max_rows_reviews: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both as JSON lines; what isn't used is never scanned."""
    return read_json_lines(spark, metadata, METADATA, max_rows_meta, "metadata"), read_json_lines(spark, reviews, REVIEWS, max_rows_reviews, "reviews")


def load_interactions(spark: SparkSession, reviews_csv: str, metadata: str) -> DataFrame:
    """Interaction table of one reviews file."""
    from ..operators.interactions import build_interactions

    return build_interactions(read_csv(spark, reviews_csv, role="reviews"), read_json_lines(spark, metadata, role="metadata"))


def load_splits(spark: SparkSession, train: str, valid: str, test: str, metadata: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mapped training, validation and test interactions."""
    from ..operators.interactions import map_eval_splits

    parts = [read_csv(spark, p, role=r) for p, r in ((train, "train"), (valid, "valid"), (test, "test"))]
    return map_eval_splits(*parts, read_json_lines(spark, metadata, role="metadata"))
