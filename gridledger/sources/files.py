"""Files as rows: documents by their bytes, and the words that an OCR tool found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of document files by their endings.
KINDS = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image"}
OCR = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, name, kind (null: no document), bytes, sha256 and modification time of every file at or below path."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", name.alias("name"), kind.alias("kind"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """The words of OCR tables (tab-separated, with a header): path, page_num, left, top, width, height, conf, text. Rows that are no words, or empty, go."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(OCR).csv(path)
    words = rows.withColumn("path", F.col("_metadata.file_path")).where("level = 5 and trim(text) <> ''")
    return words.select("path", "page_num", "left", "top", "width", "height", "conf", F.trim("text").alias("text"))


def ocr_lines(words: DataFrame, of: list[str]) -> DataFrame:
    """Words of one page (`of` names it) whose tops lie within half the height of the word above, as lines from 1: of, line, left, top, text."""
    down = Window.partitionBy(*of).orderBy("top", "left")
    step = F.coalesce(F.col("top") - F.lag("top").over(down) > F.lag("height").over(down) / 2, F.lit(True))
    lined = words.withColumn("_step", step.cast("int")).withColumn("line", F.sum("_step").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda w: w["text"])
    return lined.groupBy(*of, "line").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.array_join(parts, " ").alias("text"))
