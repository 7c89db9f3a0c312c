"""One pass over the texts for all rules.

Each detector has a part that needs the text and a part that needs only what
was found there. ``code_facts`` runs all first parts side by side, row by row;
written once, its table replaces the texts for every section of a report.
"""

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions import paths, text as tx
from . import duplicates, markers, modules, scripts, secrets


def code_facts(files: DataFrame, secret_overrides: DataFrame | None = None) -> DataFrame:
    """One row per file, without its text; columns are NULL where a rule does
    not look. ``secret_overrides``: see ``secrets.with_own_patterns``."""
    own = None
    if secret_overrides is not None:
        files, own = secrets.with_own_patterns(files, secret_overrides), F.col("secret_patterns")
    path, content = F.col("path"), F.col("content")
    looked = paths.quality_category(path) != "generated"
    script = looked & paths.extension(path).isin(rules.JS_EXTENSIONS)
    parsed = files.select(
        "repo_id",
        "path",
        "content",
        *(["secret_patterns"] if own is not None else []),
        modules.module_facts(F.when(looked & (paths.extension(path) == ".py"), content)).alias("python"),
        scripts.function_facts(F.when(script, content)).alias("script_functions"),
    )
    # behind generators, so that no expression over a text runs twice
    lowered, plain = F.col("lowered"), F.col("plain")
    cut = scripts.with_import_facts(parsed, F.when(script, content)).select(
        "*", tx.once(lowered=F.lower(content), plain=tx.plain_lines(content))
    )
    odd = F.col("odd")
    found = cut.select("*", tx.once(read_lines=tx.read_line_count_of(plain), odd=tx.uncommon(content))).select(
        "*",
        tx.once(
            lines=F.when(looked & (content != ""), tx.split_line_count(content, F.col("read_lines"), odd)),
            markers=F.when(looked, markers.marker_hits(content, lowered, plain)),
            secrets=F.when(paths.security_category(path) != "generated", secrets.secret_pieces(content, own, lowered)),
            l=F.when(looked, tx.normalized_lines(content, plain, odd)),
        ),
    )
    return found.select(
        "repo_id", "path", "python", "script_functions", "unused", "statements",
        "read_lines", "lines", "markers", "secrets", *duplicates.line_facts(F.col("l")),
    )


def python_facts(facts: DataFrame) -> DataFrame:
    return facts.where("python.parse_status IS NOT NULL").select("repo_id", "path", "python.*")


def script_functions(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "path", F.inline("script_functions"))
