"""Relations that the analyses read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources.trees import source_tree

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """A row per line, numbered from 1, of each text."""
    split = F.posexplode(F.split("text", "\n")).alias("at", "line")
    return docs.select("doc_id", "source", "lang", split).withColumn("line_no", F.col("at") + 1).drop("at")


def repository(spark: SparkSession, root: str) -> DataFrame:
    """Files of a tree as ``(rel_path, ext, size, content)``, in byte order of paths."""
    ext = F.lower(F.regexp_extract("rel_path", r"[^/](\.[^./]+)$", 1))
    return source_tree(spark, root).select("rel_path", ext.alias("ext"), "size", "content").orderBy("rel_path")


def requirements(files: DataFrame) -> DataFrame:
    """Dependencies of requirements.txt files."""
    line = F.explode(F.split("content", r"\r?\n")).alias("line")
    rows = files.filter(F.col("rel_path").rlike(r"(^|/)requirements\.txt$")).select("rel_path", line)
    rows = rows.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return rows.select(
        F.lit("python").alias("ecosystem"), F.lit("runtime").alias("dep_type"),
        F.regexp_extract("line", r"^([a-zA-Z0-9_-]+)", 1).alias("name"), F.col("line").alias("version_spec"), F.col("rel_path").alias("source"),
    )


def package_json(files: DataFrame) -> DataFrame:
    """Dependencies of package.json files; broken JSON has none."""
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.filter(F.col("rel_path").rlike(r"(^|/)package\.json$")).select("rel_path", parsed.alias("p"))

    def kind(field: str, name: str) -> DataFrame:
        return rows.select("rel_path", F.explode(f"p.{field}").alias("name", "version_spec")).select(
            F.lit("javascript").alias("ecosystem"), F.lit(name).alias("dep_type"), "name", "version_spec", F.col("rel_path").alias("source")
        )

    return kind("dependencies", "runtime").unionByName(kind("devDependencies", "dev"))


def pom_xml(files: DataFrame) -> DataFrame:
    """Dependencies of pom.xml files."""
    found = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("d")
    rows = files.filter(F.col("rel_path").rlike(r"(^|/)pom\.xml$")).select("rel_path", found)
    tag = lambda t: F.regexp_extract("d", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1)
    version = tag("version")
    return rows.select(
        F.lit("java").alias("ecosystem"), F.lit("runtime").alias("dep_type"), F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"),
        F.when(version == "", "unknown").otherwise(version).alias("version_spec"), F.col("rel_path").alias("source"),
    )
