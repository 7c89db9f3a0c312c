"""Per-repository line thresholds."""

from pyspark.sql import DataFrame, functions as F

from .. import rules


def configured_thresholds(configs: DataFrame) -> DataFrame:
    """(repo_id, language_key, max_lines) from root configuration files.

    Anything but a positive integer (booleans, text, broken JSON, another
    root type) is ignored, so those keys keep their defaults.
    """
    doc = F.try_parse_json("content")
    entries = []
    for key in rules.THRESHOLD_DEFAULTS:
        path = f"$.thresholds.{key}"
        value = F.try_variant_get(doc, path, "variant")
        # whole numbers beyond 64 bits read as decimals; no file has more lines than the largest long
        whole = F.schema_of_variant(value).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
        limit = F.when(whole, F.least(F.try_variant_get(doc, path, "decimal(38,0)"), F.lit(2**63 - 1)).cast("long"))
        entries.append(F.struct(F.lit(key).alias("language_key"), limit.alias("max_lines")))
    return (
        configs.select("repo_id", F.inline(F.array(*entries)))
        .where("max_lines > 0")
    )


def resolve_thresholds(repos: DataFrame, configs: DataFrame) -> DataFrame:
    """All four thresholds of every repository, defaults filled in."""
    defaults = F.array(
        *[
            F.struct(F.lit(k).alias("language_key"), F.lit(v).alias("default_lines"))
            for k, v in rules.THRESHOLD_DEFAULTS.items()
        ]
    )
    return (
        repos.select("repo_id").distinct().select("repo_id", F.inline(defaults))
        .join(configured_thresholds(configs), ["repo_id", "language_key"], "left")
        .select(
            "repo_id", "language_key",
            F.coalesce("max_lines", F.col("default_lines").cast("long")).alias("max_lines"),
            F.col("max_lines").isNotNull().alias("is_custom"),
        )
    )
