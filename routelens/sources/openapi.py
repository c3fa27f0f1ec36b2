"""OpenAPI documents as rows."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.schemas import SPEC_VERBS


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    import yaml

    def convert(text: str) -> str:
        try:
            return json.dumps(yaml.safe_load(text), default=str)
        except yaml.YAMLError:
            return text  # not JSON either, so it counts as unreadable

    for batch in batches:
        yield batch.assign(spec_json=[convert(t) for t in batch["spec_json"]])


def read_specs(spark: SparkSession, paths: str | list[str], host: str | None = None) -> DataFrame:
    """Spec files, JSON or YAML by suffix, as ``(host, spec_url, spec_json)``."""
    files = spark.read.text(paths, wholetext=True).select(
        F.lit(host).cast("string").alias("host"),
        F.col("_metadata.file_path").alias("spec_url"),
        F.col("value").alias("spec_json"),
    )
    is_yaml = F.col("spec_url").rlike(r"\.ya?ml$")
    converted = files.filter(is_yaml).mapInPandas(_yaml_to_json, files.schema)
    return files.filter(~is_yaml).unionByName(converted)


def _is_object(text: Column) -> Column:
    """Whether a text is one JSON object; a truncated one is not."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def unreadable_specs(specs: DataFrame) -> DataFrame:
    """The documents that are no JSON object, with the start of their text."""
    return specs.filter(~_is_object(F.col("spec_json"))).withColumn("start", F.substring("spec_json", 1, 80)).drop("spec_json")


def spec_operations(specs: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """``(host, method, path, deprecated)`` rows; only the seven HTTP verbs count as operations.

    Path items that are no objects, like ``x-`` members, lists and nulls, hold no operations and do not
    disturb the others.  An unreadable document fails the job, as its absence would look like the removal of all its
    routes; with ``skip_unreadable`` it is left out, and ``unreadable_specs`` tells which.
    """
    text = F.col("spec_json")
    readable = specs.filter(_is_object(text)) if skip_unreadable else specs.withColumn(
        "spec_json",
        F.when(_is_object(text), text).otherwise(F.raise_error(F.concat(F.lit("spec is no JSON object: "), F.coalesce(F.substring(text, 1, 80), F.lit("null"))))),
    )
    doc = F.from_json("spec_json", "paths map<string,string>")
    paths = readable.select("host", F.explode(doc["paths"]).alias("path", "item"))
    members = paths.select("host", "path", F.explode(F.from_json("item", "map<string,string>")).alias("verb", "operation"))
    operations = members.filter(F.col("verb").isin(*SPEC_VERBS))
    flag = F.get_json_object("operation", "$.deprecated")
    return operations.select(
        "host",
        F.upper("verb").alias("method"),
        "path",
        F.coalesce(flag == "true", F.lit(False)).alias("deprecated"),
    )


def spec_endpoints(specs: DataFrame) -> DataFrame:
    return spec_operations(specs).select("method", "path").distinct()


def deprecated_endpoints(specs: DataFrame) -> DataFrame:
    return spec_operations(specs).filter("deprecated").select("method", "path").distinct()


def declared_endpoints(specs: DataFrame) -> DataFrame:
    """Endpoint rows a spec found on a host declares."""
    status = F.when(F.col("deprecated"), "deprecated").otherwise("active")
    return spec_operations(specs).select(
        "method", F.col("path").alias("path_pattern"), "host", status.alias("status"),
        F.lit(True).alias("declared_in_spec"), F.lit("scan_openapi").alias("discovery_source"),
    ).distinct()
