"""Column functions over repo-relative paths (``/`` separated)."""

from pyspark.sql import Column, functions as F

from .. import rules


def lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup; NULL when the key is absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for ``x``, ``.x`` and ``x.``."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return lookup(rules.LANGUAGE_BY_EXTENSION, extension(path))


def file_type(path: Column) -> Column:
    ext = extension(path)
    fallback = F.nullif(F.upper(F.ltrim(ext, F.lit("."))), F.lit(""))
    return F.coalesce(lookup(rules.FILE_TYPE_BY_EXTENSION, ext), fallback, F.lit("Unknown"))


def threshold_key(path: Column) -> Column:
    return lookup(rules.THRESHOLD_KEY_BY_TYPE, file_type(path))


def default_threshold(path: Column) -> Column:
    return F.coalesce(
        lookup(rules.THRESHOLD_DEFAULTS, threshold_key(path)),
        F.lit(rules.DEFAULT_MAX_LINES),
    )


def _has_part(path: Column, parts) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), words(parts))


def quality_category(path: Column) -> Column:
    """test, then generated, then config, else source."""
    name = F.lower(base_name(path))
    test_name = (
        name.contains(".test.")
        | name.contains(".spec.")
        | name.endswith("_test.py")
        | name.startswith("test_")
    )
    return (
        F.when(_has_part(path, rules.TEST_PARTS) | test_name, "test")
        .when(_has_part(path, rules.GENERATED_PARTS), "generated")
        .when(name.isin(rules.QUALITY_CONFIG_NAMES), "config")
        .otherwise("source")
    )


def security_category(path: Column) -> Column:
    """generated wins over test here, and ``test_`` prefixes do not count."""
    name = F.lower(base_name(path))
    test_name = (
        name.contains(".test.") | name.contains(".spec.") | name.endswith("_test.py")
    )
    return (
        F.when(_has_part(path, rules.GENERATED_PARTS), "generated")
        .when(_has_part(path, rules.TEST_PARTS) | test_name, "test")
        .when(name.isin(rules.SECURITY_CONFIG_NAMES), "config")
        .otherwise("source")
    )


def in_ignored_directory(path: Column, fold_case: bool = False) -> Column:
    """True below an ignored directory.

    ``fold_case`` lower-cases the path only, as the manifest scan does, so the
    capitalised entry of the list never matches there.
    """
    dirs = directories(F.lower(path) if fold_case else path)
    return F.arrays_overlap(dirs, words(rules.IGNORED_DIRECTORIES))
