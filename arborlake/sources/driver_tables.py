"""Trees derived from the ``documents`` and ``pages`` tables.

Both are plain expressions over the whole table, so SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTORIES = (
    "src", "src/core", "src/util", "tests", "docs", "target/debug", "node_modules/pkg",
    "vendor/lib", "third_party/dep", ".cache", "config", "build",
)
EXTENSIONS = (
    "rs", "py", "md", "json", "toml", "txt", "lock", "pem", "log", "tsx", "yml", "sql", "png",
)


def _nth(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def document_path() -> Column:
    doc = F.col("doc_id")
    folder = _nth(DIRECTORIES, (doc + 5 * F.call_function("div", doc, F.lit(20))) % len(DIRECTORIES))
    ext = _nth(EXTENSIONS, doc % len(EXTENSIONS))
    source, number, slash = F.col("source"), doc.cast("string"), F.lit("/")
    return (
        F.when(doc % 101 == 0, F.concat(source, F.lit("/.env."), number))
        .when(doc % 97 == 0, F.concat(F.lit(".env."), number))
        .when(doc % 89 == 0, F.concat(F.lit("id_"), number))
        .when(doc % 23 == 0, F.concat(source, slash, folder, F.lit("/d"), number, F.lit("/Dockerfile")))
        .when(doc % 29 == 0, F.concat(source, slash, folder, F.lit("/d"), number, F.lit("/LICENSE")))
        .when(doc % 31 == 0, F.concat(source, slash, folder, F.lit("/test_"), number, F.lit("."), ext))
        .otherwise(F.concat(source, slash, folder, F.lit("/f"), number, F.lit("."), ext))
    )


def indented(text: Column) -> Column:
    """Every line prefixed with four blanks times its position modulo four."""
    return F.array_join(
        F.transform(
            F.split(text, "\n"), lambda line, i: F.concat(F.repeat(F.lit("    "), i % 4), line)
        ),
        "\n",
    )


def files_from_documents(spark: SparkSession, sf_dir: str, indent: bool = False) -> DataFrame:
    """One corpus per language, one file per document."""
    text = indented(F.col("text")) if indent else F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("lang").alias("corpus_id"),
        document_path().alias("path"),
        F.lit(False).alias("is_dir"),
        F.octet_length(text).cast("bigint").alias("size_bytes"),
        text.alias("content"),
    )


def repository_marks(files: DataFrame) -> DataFrame:
    """``.git`` files that turn two directories of every corpus into repositories."""
    paths = F.explode(
        F.array(F.lit("src3/third_party/dep/.git"), F.lit("src7/third_party/dep/.git"))
    )
    return files.select("corpus_id").distinct().select("corpus_id", paths.alias("path"))


def with_repository_marks(files: DataFrame) -> DataFrame:
    marks = repository_marks(files).select(
        "corpus_id",
        "path",
        F.lit(False).alias("is_dir"),
        F.lit(0).cast("bigint").alias("size_bytes"),
        F.lit("").alias("content"),
    )
    return files.unionByName(marks)


def files_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus per host, one file per page.

    A path that is empty or ends with ``/`` is the page ``index`` in that directory. Of
    equal paths the lowest page keeps the name; the others carry ``~`` and their id before
    the extension. These are found on narrow columns and meet the content by page.
    """
    url = F.coalesce("url", F.lit(""))
    path = F.regexp_extract(url, "^https?://[^/?#]+/([^?#]*)", 1)
    stem = F.regexp_replace(path, r"/+\z", "")
    named = F.when(stem == "", "index").when(stem != path, F.concat(stem, F.lit("/index"))).otherwise(stem)
    located = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id",
        F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("corpus_id"),
        named.alias("path"),
        F.lit(False).alias("is_dir"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        F.col("html").alias("content"),
    )
    place = ["corpus_id", "path"]
    first = located.groupBy(*place).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    later = located.select("page_id", *place).join(first, place).where("page_id > first").select("page_id", F.lit(True).alias("later"))
    ext = F.regexp_extract("path", r"[^/](\.[^./]*)\z", 1)
    apart = F.concat(F.left("path", F.length("path") - F.length(ext)), F.lit("~"), F.col("page_id").cast("string"), ext)
    joined = located.join(later.distinct(), "page_id", "left")
    return joined.withColumn("path", F.when(F.col("later"), apart).otherwise(F.col("path"))).drop("page_id", "later")
