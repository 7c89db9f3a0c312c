"""Work markers left in the text."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import paths
from ..functions.text import mentions, once, plain_lines

MARKER = rf"(?iU)\b({'|'.join(rules.MARKERS)})\b"


def marker_hits(content: Column, lowered: Column | None = None, plain: Column | None = None) -> Column:
    """``array<struct<line, marker>>``. A marker never spans lines, so they
    are searched one by one, and only those that have a stem of one. ``plain``
    are the text's ``plain_lines``, where a column has them."""
    numbered = F.transform(
        plain_lines(content) if plain is None else plain,
        lambda text, i: F.struct((i + 1).alias("line"), text.alias("text"), F.lower(text).alias("lowered")),
    )
    per_line = F.transform(
        F.filter(numbered, lambda l: mentions(l["text"], rules.MARKER_STEMS, l["lowered"])),
        lambda l: F.transform(
            F.regexp_extract_all(l["text"], F.lit(MARKER), F.lit(1)),
            lambda m: F.struct(l["line"].alias("line"), F.upper(m).alias("marker")),
        ),
    )
    return F.when(mentions(content, rules.MARKER_STEMS, lowered), F.flatten(per_line))


def work_markers(files: DataFrame) -> DataFrame:
    """One row per marker occurrence."""
    looked = files.where(paths.quality_category(F.col("path")) != "generated")
    return marker_findings(looked.select("repo_id", "path", once(markers=marker_hits(F.col("content")))))


def marker_findings(facts: DataFrame) -> DataFrame:
    """Findings from ``markers`` columns."""
    why, advice = rules.EXPLANATIONS["marker"]
    marker = F.col("marker")
    return facts.select("repo_id", "path", F.inline("markers")).select(
        "repo_id",
        F.lit("quality").alias("domain"),
        F.concat(marker, F.lit(" Marker")).alias("type"),
        F.col("path").alias("file"),
        "line",
        F.lit("LOW").alias("severity"),
        F.lit("LOW").alias("priority"),
        F.lit(100).alias("confidence"),
        F.format_string(rules.DETAILS["marker"], marker).alias("details"),
        F.lit(why).alias("why"),
        F.lit(advice).alias("recommendation"),
    )
