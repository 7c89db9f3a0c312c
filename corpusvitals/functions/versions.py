"""Version columns."""

from pyspark.sql import Column, functions as F

from .. import rules

_TRIPLE = r"(\d+)\.(\d+)\.(\d+)"


def clean_npm_version(version: Column) -> Column:
    """First ``d.d.d`` with optional suffix, else the unspecified sentinel."""
    found = F.regexp_extract(version, r"\d+\.\d+\.\d+(?:[-+][A-Za-z0-9.-]+)?", 0)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(rules.UNSPECIFIED))


def version_triple(version: Column) -> Column:
    """``struct<major, minor, patch>``; NULL when unparsable.

    A part is ``struct<n, digits>``: its digits without leading zeros and
    their number. Structs compare field by field, so ``<`` orders versions
    with numbers of any length.
    """
    def part(group):
        digits = F.regexp_replace(F.regexp_extract(version, _TRIPLE, group), "^0+(?=.)", "")
        return F.struct(F.length(digits).alias("n"), digits.alias("digits"))

    return F.when(
        version.rlike(_TRIPLE),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def is_checkable(name: Column, version: Column) -> Column:
    """Name and version present and the version pinned."""
    return (
        (F.coalesce(name, F.lit("")) != "")
        & (F.coalesce(version, F.lit("")) != "")
        & (version != rules.UNSPECIFIED)
    )


# --- keys that sort as versions do ------------------------------------------------
#
# Strings compared byte by byte. A number is its length and its digits; what a
# longer version goes on with sorts above or below the sign that ends a shorter one.

#: Below and above every key.
FIRST_KEY, LAST_KEY = "", "~"

_SEMVER = r"^[v=\s]*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
_PEP440 = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|rc|c)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
#: Qualifiers below the release itself, which is "6", and the one right above it.
_MAVEN_QUALIFIERS = {"alpha": "1", "beta": "2", "milestone": "3", "rc": "4", "cr": "4", "snapshot": "5", "": "6", "ga": "6", "final": "6", "release": "6", "sp": "7"}


def _number(digits: Column) -> Column:
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    plain = F.when(plain == "", "0").otherwise(plain)
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def _is_number(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def semver_key(version: Column) -> Column:
    """Semantic versions; absent parts are 0, build tags do not count."""
    part = lambda group: F.regexp_extract(version, _SEMVER, group)
    fields = F.transform(
        F.split(part(4), r"\."),
        lambda x: F.when(_is_number(x), F.concat(F.lit("1"), _number(x))).otherwise(F.concat(F.lit("2"), x)),
    )
    tail = F.when(part(4) == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(fields, "!")))
    key = F.concat(_number(part(1)), _number(part(2)), _number(part(3)), tail)
    return F.when(version.rlike(_SEMVER), key)


def pep440_key(version: Column) -> Column:
    """Python versions: epoch, release without zeros at its end, pre, post, dev, local."""
    text = F.lower(version)
    part = lambda group: F.regexp_extract(text, _PEP440, group)
    epoch = F.when(part(1).rlike("[1-9]"), F.concat(F.lit("1"), _number(part(1)))).otherwise("0")
    release = F.split(F.regexp_replace(part(2), r"(?:\.0+)+$", ""), r"\.")
    release = F.array_join(F.transform(release, lambda x: F.concat(F.lit("."), _number(x))), "")
    has_post = (part(5) != "") | (part(6) != "")
    post = F.when(has_post, F.concat(F.lit("1"), _number(F.concat(part(5), part(7))))).otherwise("0")
    dev = F.when(part(8) != "", F.concat(F.lit("0"), _number(part(9)))).otherwise("z")
    pre = (
        F.when(part(3) != "", F.concat(F.when(part(3).isin("a", "alpha"), "a").when(part(3).isin("b", "beta"), "b").otherwise("r"), _number(part(4))))
        .when((part(8) != "") & ~has_post, "0")
        .otherwise("z")
    )
    fields = F.transform(
        F.split(part(10), "[-_.]"),
        lambda x: F.when(_is_number(x), F.concat(F.lit("2"), _number(x))).otherwise(F.concat(F.lit("1"), x)),
    )
    local = F.when(part(10) == "", "0").otherwise(F.concat(F.lit("1"), F.array_join(fields, "!")))
    return F.when(text.rlike(_PEP440), F.concat(epoch, release, F.lit("!"), pre, post, dev, local))


def maven_key(version: Column) -> Column:
    """Maven versions: numbers and qualifiers, cut at dots, hyphens and between digits and letters.

    Values that mean nothing (0, ga, final, release) go from the end and from
    before a hyphen. A number behind a dot is above one behind a hyphen, both
    above any qualifier.
    """
    text = F.lower(F.trim(version))
    for short, long in (("a", "alpha"), ("b", "beta"), ("m", "milestone")):
        text = F.regexp_replace(text, rf"(?<![a-z]){short}(?=[0-9])", long)
    text = F.regexp_replace(text, "_", "-")
    text = F.regexp_replace(text, "(?<=[0-9])(?=[^0-9.-])|(?<=[^0-9.-])(?=[0-9])", "-")
    text = F.regexp_replace(text, r"(?<=^|[.-])(?=[.-]|$)", "0")
    text = F.regexp_replace(text, r"(?:[.-](?:0+|ga|final|release))+(?=-|$)", "")
    tokens = F.regexp_extract_all(text, F.lit(r"(?:^|[.-])[^.-]+"), F.lit(0))

    def keyed(token: Column) -> Column:
        value = F.regexp_replace(token, "^[.-]", "")
        number = F.concat(F.when(token.startswith("-"), "a").otherwise("b"), _number(value))
        known = F.lit(None).cast("string")
        for name, sign in _MAVEN_QUALIFIERS.items():
            known = F.when(value == name, sign).otherwise(known)
        return F.when(_is_number(value), number).otherwise(F.coalesce(known, F.concat(F.lit("8"), value, F.lit("!"))))

    return F.when(F.trim(version) != "", F.concat(F.array_join(F.transform(tokens, keyed), ""), F.lit("6")))


def sort_key(ecosystem: Column, version: Column) -> Column:
    """Orders the versions of one package; NULL where the text is none."""
    return (
        F.when(ecosystem == "PyPI", pep440_key(version))
        .when(ecosystem == "Maven", maven_key(version))
        .otherwise(semver_key(version))
    )
