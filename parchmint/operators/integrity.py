"""Manifests of file digests: building, verifying, reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(files: DataFrame, exclude: DataFrame, key: str = "path") -> DataFrame:
    """Files that are not excluded."""
    return files.join(exclude.select(key), key, "left_anti")


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.sha2(F.col(content), 256).alias("sha256"))


def manifest_json(files: DataFrame, version: str, url: str, exclude: DataFrame | None = None) -> DataFrame:
    """One row: the manifest of (path, sha256) as JSON with sorted paths, two-space indents and a final line feed.

    A manifest lists a release's files, so it is one value by nature.
    """
    if exclude is not None:
        files = without(files, exclude)
    entries = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    lines = F.transform(entries, lambda e: F.concat(F.lit("    "), F.to_json(F.struct(e["path"].alias("p"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["path"].alias("p")))) - 6), F.lit(': "'), e["sha256"], F.lit('"')))
    head = f'{{\n  "version": "{version}",\n  "releaseUrl": "{url}",\n  "algorithm": "SHA-256",\n  "files": {{\n'
    return files.agg(F.concat(F.lit(head), F.array_join(lines, ",\n"), F.lit("\n  }\n}\n")).alias("manifest"))


def read_manifest(spark, path: str) -> DataFrame:
    """Rows (path, expected) of a manifest file."""
    read = spark.read.schema("version string, releaseUrl string, algorithm string, files map<string,string>").option("multiLine", True).json(path)
    return read.select(F.explode("files").alias("path", "expected"))


def verify(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (path, ok, shown) of a manifest (path, expected) against digests (path, sha256); unreadable files say so."""
    joined = manifest.join(actual, "path", "left")
    ok = F.coalesce(F.col("expected") == F.col("sha256"), F.lit(False))
    shown = F.when(F.col("sha256").isNull(), F.concat("path", F.lit(" (unreadable)"))).otherwise(F.col("path"))
    return joined.select("path", ok.alias("ok"), shown.alias("shown"))


def verify_report(checked: DataFrame, top: int = 12) -> DataFrame:
    """One row: counts, whether all match (not so for an empty manifest), and the first mismatches, which alone are gathered."""
    first = checked.where("NOT ok").orderBy("path", "shown").limit(top).agg(F.array_sort(F.collect_list(F.struct("path", "shown"))).alias("_bad"))
    counts = checked.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad"), (F.coalesce(F.bool_and("ok"), F.lit(False))).alias("all_match"))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one").select(
        "n_ok", "n_bad", "all_match",
        F.concat(F.array_join(F.transform(F.slice("_bad", 1, top), lambda b: b["shown"]), ", "), F.when(F.col("n_bad") > top, F.format_string(" (+%d more)", F.col("n_bad") - top)).otherwise("")).alias("mismatched"),
    )
