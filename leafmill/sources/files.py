"""File listings: intake candidates, parser artifacts and page images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.ordering import first_per_key


def scan_files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, length, modificationTime, content of matching files below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def base_name(path):
    return F.regexp_extract(path, r"[^/]+$", 0)


def hashed_files(files: DataFrame) -> DataFrame:
    """Content replaced by its hash inside the scan stage; the bytes never shuffle."""
    return files.select(
        "path", base_name(F.col("path")).alias("filename"), "length", F.sha2("content", 256).alias("sha256")
    )


def intake_by_hash(hashed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Files whose bytes are not catalogued yet, one row per distinct content.

    Among equal files the smallest (length, path) gives the name. The id is the hash.
    """
    fresh = hashed.join(catalogue.select("sha256"), "sha256", "left_anti")
    first = first_per_key(fresh, ["sha256"], ["length", "path"])
    return first.select(
        F.col("sha256").alias("id"),
        "filename",
        F.col("path").alias("file_path"),
        "sha256",
        F.lit(None).cast("int").alias("page_count"),
        F.col("length").cast("bigint").alias("bytes"),
        F.lit("uploaded").alias("parse_status"),
        F.lit(None).cast("string").alias("parse_error"),
    )


def intake_result(hashed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The catalogue after intake: old rows untouched, new ones added."""
    new = intake_by_hash(hashed, catalogue)
    old = catalogue.select(*new.columns)
    return old.unionByName(new)


def artifact_pick(listing: DataFrame) -> DataFrame:
    """Best markdown, content list and page tree per document.

    ``listing`` has document_id, path, length. Markdown: a name containing "full"
    first, then the shallower path, then the larger file.
    """
    name = F.lower(F.col("name"))
    kind = (
        F.when(F.col("name").endswith(".md"), "markdown")
        .when(F.col("name").rlike(r"content_list(_v2)?\.json$"), "content_list")
        .when(F.col("name").rlike(r"(^|_)middle\.json$"), "middle")
    )
    depth = F.size(F.split("path", "/"))
    priority = (
        F.when((F.col("kind") == "markdown") & F.contains(name, F.lit("full")), 0)
        .when(F.col("kind") == "markdown", 1)
        .when(F.col("name").endswith("content_list.json"), 0)
        .when(F.col("kind") == "content_list", 1)
        .when(F.col("name").endswith("_middle.json"), 0)
        .otherwise(1)
    )
    ranked = (
        listing.withColumn("name", base_name(F.col("path")))
        .withColumn("kind", kind)
        .filter("kind is not null")
        .withColumn("priority", priority)
        .withColumn("depth", depth)
    )
    best = first_per_key(ranked, ["document_id", "kind"], ["priority", "depth", F.col("length").desc(), "path"])
    return best.select("document_id", "kind", "path", "length")


def page_image_listing(listing: DataFrame) -> DataFrame:
    """PNG files of each document with the page number written in the name."""
    name = base_name(F.col("path"))
    digits = F.regexp_replace(name, r"[^0-9]", "")
    return listing.filter(F.col("path").endswith(".png")).select(
        "document_id",
        F.coalesce(digits.try_cast("int"), F.lit(0)).alias("page_no"),
        "path",
    )
