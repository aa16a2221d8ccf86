"""Format detection over binary columns, in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _bytes(hexadecimal: str) -> Column:
    return F.unhex(F.lit(hexadecimal))


def _text(value: str) -> Column:
    return F.lit(value).cast("binary")


def detect(content: Column) -> Column:
    """hwp5, hwpx, docx, pdf or unknown, by magic numbers and part names in the clear."""
    start = lambda n: F.substring(content, 1, n)
    zipped = start(4) == _bytes("504B0304")
    return (
        F.when(start(8) == _bytes("D0CF11E0A1B11AE1"), "hwp5")
        .when(zipped & (F.contains(start(512), _text("application/hwp+zip")) | F.contains(content, _text("Contents/header.xml"))), "hwpx")
        .when(zipped & F.contains(content, _text("word/document.xml")), "docx")
        .when(~zipped & F.contains(start(1024), _text("%PDF-")), "pdf")
        .otherwise("unknown")
    )


#: Images larger than this are refused.
IMAGE_BYTES = 24 << 20


def image_kind(content: Column) -> Column:
    """png, jpeg, bmp or gif, or why not: empty, too_large, unknown."""
    start = lambda n: F.substring(content, 1, n)
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(F.octet_length(content) > IMAGE_BYTES, "too_large")
        .when(start(8) == _bytes("89504E470D0A1A0A"), "png")
        .when(start(3) == _bytes("FFD8FF"), "jpeg")
        .when(start(2) == _text("BM"), "bmp")
        .when(start(4) == _text("GIF8"), "gif")
        .otherwise("unknown")
    )


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format, content) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", detect(F.col("content")).alias("format"), "content")
