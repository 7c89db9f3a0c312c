"""Declared dependencies from the four manifest kinds."""

from typing import Iterator
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .. import rules
from ..functions import paths, text as tx, versions

KEYS = ["repo_id", "path"]


def of_kind(manifests: DataFrame, name: str) -> DataFrame:
    return manifests.where(F.lower(paths.base_name(F.col("path"))) == name)


def _as_dependencies(rows: DataFrame, ecosystem: str) -> DataFrame:
    return rows.select(
        "repo_id",
        F.col("path").alias("manifest_path"),
        F.lit(ecosystem).alias("ecosystem"),
        "name",
        "version",
    )


def _first_wins(rows: DataFrame) -> DataFrame:
    """Keep the first entry per name by ``rank``; combines before the shuffle."""
    return rows.groupBy(*KEYS, "name").agg(F.min_by("version", "rank").alias("version"))


def parse_requirements(manifests: DataFrame) -> DataFrame:
    name = r"^([A-Za-z0-9_.-]+)"
    pinned = name + r"\s*(?:==|>=|<=|~=|>|<)\s*([A-Za-z0-9.*+!-]+)"
    lines = (
        manifests.select(*KEYS, F.explode(tx.split_lines(F.col("content"))).alias("raw"))
        .select(*KEYS, tx.trimmed(F.col("raw")).alias("raw"))
        .where((F.col("raw") != "") & ~F.col("raw").startswith("#") & ~F.col("raw").startswith("-"))
        .select(*KEYS, tx.trimmed(F.substring_index("raw", "#", 1)).alias("line"))
        .where(F.col("line").rlike(name))
    )
    version = F.nullif(F.regexp_extract("line", pinned, 2), F.lit(""))
    return _as_dependencies(
        lines.select(
            *KEYS,
            F.regexp_extract("line", name, 1).alias("name"),
            F.coalesce(version, F.lit(rules.UNSPECIFIED)).alias("version"),
        ),
        "PyPI",
    )


def parse_package_json(manifests: DataFrame) -> DataFrame:
    """Four sections in order; the first section naming a package wins.

    Versions are kept as VARIANT until their type is checked: only strings
    can carry a version. A section that is no object is NULL and skipped.
    """
    shape = ", ".join(f"{s} map<string, variant>" for s in rules.PACKAGE_JSON_SECTIONS)
    doc = F.from_json("content", f"struct<{shape}>")
    sections = F.array(
        *[
            F.struct(F.lit(i).alias("section"), F.col(f"doc.{s}").alias("packages"))
            for i, s in enumerate(rules.PACKAGE_JSON_SECTIONS)
        ]
    )
    well_formed = F.get_json_object("content", "$").isNotNull()
    entries = (
        manifests.where(well_formed).select(*KEYS, doc.alias("doc"))
        .select(*KEYS, F.explode(sections).alias("s"))
        .select(*KEYS, F.col("s.section"), F.posexplode("s.packages").alias("pos", "name", "v"))
    )
    is_text = F.schema_of_variant("v") == "STRING"
    text = F.when(is_text, F.try_variant_get("v", "$", "string"))
    # a key repeated inside one object: its last value counts
    return _as_dependencies(
        _first_wins(
            entries.select(
                *KEYS,
                "name",
                versions.clean_npm_version(text).alias("version"),
                F.struct("section", -F.col("pos")).alias("rank"),
            )
        ),
        "npm",
    )


def _pom_entries(text: str) -> list:
    """(group, artifact, version) of every dependency element of one POM."""

    def child(node, wanted):
        for item in node:
            if item.tag.rpartition("}")[2] == wanted:
                return (item.text or "").strip()
        return ""

    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return []
    found = []
    for node in root.iter():
        if isinstance(node.tag, str) and node.tag.rpartition("}")[2] == "dependency":
            found.append(tuple(child(node, k) for k in ("groupId", "artifactId", "version")))
    return found


ENTRY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("grp", "artifact", "version")]
)


@F.pandas_udf(T.ArrayType(ENTRY))
def pom_entries(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: _pom_entries(t) if t else [])


def parse_pom(manifests: DataFrame) -> DataFrame:
    """XML needs a real parser: ``xpath`` loses the alignment of children."""
    version = F.col("d.version")
    unresolved = (version == "") | (version.startswith("${") & version.endswith("}"))
    return _as_dependencies(
        manifests.select(*KEYS, F.explode(pom_entries("content")).alias("d"))
        .where("d.grp <> '' AND d.artifact <> ''")
        .select(
            *KEYS,
            F.concat_ws(":", "d.grp", "d.artifact").alias("name"),
            F.when(unresolved, rules.UNSPECIFIED).otherwise(version).alias("version"),
        ),
        "Maven",
    )


def parse_gradle(manifests: DataFrame) -> DataFrame:
    part = "[A-Za-z0-9_.-]+"
    pattern = (
        rf"(?U)\b(?:{'|'.join(rules.GRADLE_CONFIGURATIONS)})\s*\(?\s*"
        rf"['\"]({part}):({part}):([A-Za-z0-9_.${{}}-]+)['\"]"
    )
    gone = lambda text, sign, comment: F.when(text.contains(sign), F.regexp_replace(text, comment, "")).otherwise(text)
    # the text is read once; the parts of a declaration are found in what matched
    part_of = lambda g: F.regexp_extract("hit", pattern, g)
    found = (
        manifests.select(*KEYS, gone(F.col("content"), "//", r"//[^\n]*").alias("bare"))
        .select(*KEYS, gone(F.col("bare"), "/*", r"(?s)/\*.*?\*/").alias("bare"))
        .select(*KEYS, F.posexplode(F.regexp_extract_all("bare", F.lit(pattern), F.lit(0))).alias("rank", "hit"))
        .select(*KEYS, "rank", F.struct(part_of(1).alias("g"), part_of(2).alias("a"), part_of(3).alias("v")).alias("z"))
        .select(
            *KEYS,
            "rank",
            F.concat_ws(":", "z.g", "z.a").alias("name"),
            F.when(F.col("z.v").startswith("$"), rules.UNSPECIFIED)
            .otherwise(F.col("z.v")).alias("version"),
        )
    )
    return _as_dependencies(_first_wins(found), "Maven")


def dependencies(manifests: DataFrame) -> DataFrame:
    """All manifest kinds, deduplicated per manifest."""
    rows = (
        parse_requirements(of_kind(manifests, "requirements.txt"))
        .unionByName(parse_package_json(of_kind(manifests, "package.json")))
        .unionByName(parse_pom(of_kind(manifests, "pom.xml")))
        .unionByName(parse_gradle(of_kind(manifests, "build.gradle")))
    )
    return dedup_dependencies(rows)


def dedup_dependencies(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["repo_id", "ecosystem", "name", "version", "manifest_path"])
