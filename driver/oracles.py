"""The same results in plain DuckDB SQL, written from the rules."""

from corpusvitals import rules
from . import adapters as a
from .adapters import for_duckdb


def values(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def mapping(expr: str, table: dict) -> str:
    arms = " ".join(
        f"WHEN '{k}' THEN " + (str(v) if isinstance(v, int) else f"'{v}'") for k, v in table.items()
    )
    return f"(CASE {expr} {arms} END)"


def having(view: str, name: str = "files") -> str:
    return f"{name} AS ({for_duckdb(view)})"


NAME = "regexp_extract(path, '[^/]*$')"
LOWER_NAME = f"lower({NAME})"
EXT = f"lower(regexp_extract({NAME}, '^.+([.][^.]+)$', 1))"
PARTS = "string_split(lower(path), '/')"
DIRS = "string_split(path, '/')[1:-2]"
NL = "chr(10)"


def nl_count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {NL}, '')))"


def any_part(parts: str, names) -> str:
    return f"list_has_any({parts}, [{values(names)[1:-1]}])"


_TEST_NAME = f"({LOWER_NAME} LIKE '%.test.%' OR {LOWER_NAME} LIKE '%.spec.%' OR {LOWER_NAME} LIKE '%\\_test.py' ESCAPE '\\'"
QUALITY_CATEGORY = f"""CASE
  WHEN {any_part(PARTS, rules.TEST_PARTS)} OR {_TEST_NAME} OR {LOWER_NAME} LIKE 'test\\_%' ESCAPE '\\') THEN 'test'
  WHEN {any_part(PARTS, rules.GENERATED_PARTS)} THEN 'generated'
  WHEN {LOWER_NAME} IN {values(rules.QUALITY_CONFIG_NAMES)} THEN 'config' ELSE 'source' END"""
SECURITY_CATEGORY = f"""CASE
  WHEN {any_part(PARTS, rules.GENERATED_PARTS)} THEN 'generated'
  WHEN {any_part(PARTS, rules.TEST_PARTS)} OR {_TEST_NAME}) THEN 'test'
  WHEN {LOWER_NAME} IN {values(rules.SECURITY_CONFIG_NAMES)} THEN 'config' ELSE 'source' END"""
FILE_TYPE = (
    f"coalesce({mapping(EXT, rules.FILE_TYPE_BY_EXTENSION)}, nullif(upper(ltrim({EXT}, '.')), ''), 'Unknown')"
)
LANGUAGE = mapping(EXT, rules.LANGUAGE_BY_EXTENSION)

# --- secrets ---------------------------------------------------------------------

_SECRETS = {
    kind: rf"""(?i)\b({words})\b\s*[:=]\s*["'']([^"'']+)["'']"""
    for kind, words in rules.SECRET_KEYWORDS.items()
}
_PLACEHOLDER = (
    f"(trim(lower(value)) IN {values(rules.PLACEHOLDER_WORDS)} OR regexp_matches(trim(lower(value)), "
    f"'^(({'|'.join(rules.PLACEHOLDER_PREFIXES)})[-_].*|x{{4,}}|0{{4,}})$'))"
)
_CONFIDENCE = f"""CASE WHEN {_PLACEHOLDER} THEN 15 WHEN length(value) < 8 THEN 20 ELSE least(100,
  50 + (length(value) >= 16)::INT * 15 + (length(value) >= 32)::INT * 10
  + regexp_matches(value, '[A-Z]')::INT * 5 + regexp_matches(value, '[a-z]')::INT * 5
  + regexp_matches(value, '[0-9]')::INT * 10 + regexp_matches(value, '[^A-Za-z0-9]')::INT * 5
  + (type IN {values(rules.STRUCTURED_SECRET_TYPES)})::INT * 5) END"""


def secret_ctes(source: str = "files", patterns: dict = _SECRETS, where: dict = {}, none: str = "FALSE") -> str:
    """raw matches with line, value and whether a touched line asks for input; ``where`` limits a pattern to
    some files, ``none`` says which values are placeholders besides"""
    found = " UNION ALL ".join(
        f"SELECT repo_id, path, category, '{kind}' AS type, content, "
        f"regexp_extract_all(content, '{p}') AS hits, string_split_regex(content, '{p}') AS gaps, '{p}' AS p "
        f"FROM scanned WHERE regexp_matches(content, '{p}') AND {where.get(kind, 'TRUE')}"
        for kind, p in patterns.items()
    )
    asks = " OR ".join(f"contains(lower(x), '{c}')" for c in rules.INPUT_CALLS)
    before = "list_sum(list_transform(range(1, i + 1), lambda k: {g} + CASE WHEN k < i THEN {h} ELSE 0 END))".format(
        g=nl_count("gaps[k]"), h=nl_count("hits[k]")
    )
    return f"""
scanned AS (SELECT * FROM (SELECT *, {SECURITY_CATEGORY} AS category FROM {source}) WHERE category <> 'generated'),
found AS ({found}),
matched AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
placed AS (SELECT *, 1 + {before} AS line, regexp_extract(hits[i], '["'']([^"'']+)["'']$', 1) AS value FROM matched),
raw AS (SELECT repo_id, path AS file, category, type, CAST(line AS INT) AS line, value,
  len(list_filter(string_split(content, {NL})[line : line + {nl_count('hits[i]')}], lambda x: {asks})) > 0 AS suppressed
  FROM placed),
judged AS (SELECT *, {_PLACEHOLDER} AS placeholder, CAST({_CONFIDENCE} AS INT) AS confidence FROM raw),
secrets AS (SELECT DISTINCT repo_id, type, file, line,
  CASE WHEN category = 'test' THEN CASE WHEN confidence >= 80 THEN 'MEDIUM' ELSE 'LOW' END
       WHEN confidence >= 80 THEN 'HIGH' WHEN confidence >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  confidence, 'Looks like a hard-coded ' || lower(type) || ', certainty ' || confidence || ' of 100.' AS details,
  category AS file_category
  FROM judged WHERE NOT suppressed AND NOT placeholder AND NOT ({none}) AND (category <> 'test' OR confidence >= 50))"""


_REPO_NUMBER = "CAST(substr(repo_id, 4) AS INT)"


def secret_query(view: str, tail: str) -> str:
    return f"WITH {having(view)}, {secret_ctes()} {tail}"


REPORT_KEYS = "repo_id, type, file, line, severity, confidence, details"
SECRET_TAIL = f"SELECT {REPORT_KEYS}, file_category FROM secrets"

# --- markers ------------------------------------------------------------------------

MARKERS = f"""
markers AS (
  SELECT repo_id, upper(m) || ' Marker' AS type, path AS file, CAST(i AS INT) AS line, 'LOW' AS severity,
         100 AS confidence, 'Unfinished work: ' || upper(m) || '.' AS details
  FROM (SELECT repo_id, path, i, unnest(regexp_extract_all(ls[i], '(?i)\\b(TODO|FIXME|XXX|HACK)\\b', 1)) AS m
        FROM (SELECT repo_id, path, ls, unnest(range(1, len(ls) + 1)) AS i
              FROM (SELECT *, string_split(content, {NL}) AS ls FROM files WHERE ({QUALITY_CATEGORY}) <> 'generated'))))"""

# --- duplicates -----------------------------------------------------------------------

LINES = f"""
cut AS (SELECT repo_id, path, string_split(content, {NL}) AS ls FROM files),
numbered AS (SELECT repo_id, path, i AS line_no,
    trim(regexp_replace(regexp_replace(regexp_replace(ls[i], '//.*$', ''), '#.*$', ''), '\\s+', ' ', 'g')) AS text
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
lines AS (SELECT repo_id, path, CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) - 1 AS INT) AS pos,
    CAST(line_no AS INT) AS line_no, text FROM numbered WHERE text <> '')"""

DUPLICATES = f"""{LINES},
texts AS (SELECT repo_id, path, list(text ORDER BY pos) AS t, list(line_no ORDER BY pos) AS nos
  FROM lines GROUP BY repo_id, path
  HAVING count(*) >= 8 AND ({QUALITY_CATEGORY}) <> 'generated'),
win AS (SELECT repo_id, path, p, t[p] || {NL} || t[p + 1] || {NL} || t[p + 2] AS sig, t[p : p + 7] AS w
  FROM (SELECT *, unnest(range(1, len(t) - 6)) AS p FROM texts)),
cand AS (SELECT x.repo_id, x.path AS a, y.path AS b, x.p AS pa, y.p AS pb,
    len(list_filter(range(1, 9), lambda k: x.w[k] = y.w[k])) AS m
  FROM win x JOIN win y ON x.repo_id = y.repo_id AND x.sig = y.sig AND x.path < y.path),
long AS (SELECT c.*, ta.nos[pa] AS la, tb.nos[pb] AS lb,
    8 + coalesce(list_filter(range(0, len(ta.t) + 1), lambda k: ta.t[pa + 8 + k] IS NULL OR tb.t[pb + 8 + k] IS NULL
                             OR ta.t[pa + 8 + k] <> tb.t[pb + 8 + k])[1], 0) AS n
  FROM cand c JOIN texts ta ON ta.repo_id = c.repo_id AND ta.path = a
              JOIN texts tb ON tb.repo_id = c.repo_id AND tb.path = b WHERE m >= 7),
dups AS (SELECT repo_id, a AS file, la AS line, b AS file_2, lb AS line_2,
    CAST(n AS INT) AS duplicate_lines, CAST(m AS INT) AS matching
  FROM long QUALIFY row_number() OVER (PARTITION BY repo_id, a, b ORDER BY n DESC, m DESC, pa, pb) = 1)"""

# copies are one class, named by its first path; a row per further member of a class and per pair of classes;
# the row of a class's first two files stands for the pairs that no other row names
CLASSES = """
cl AS (SELECT repo_id, path, min(path) OVER w AS cls, count(*) OVER w AS n, row_number() OVER (PARTITION BY repo_id, t, nos ORDER BY path) AS k
  FROM texts WINDOW w AS (PARTITION BY repo_id, t, nos)),
class_dups AS (SELECT dups.*, a.cls AS class, b.cls AS class_2,
    CAST(CASE WHEN a.cls <> b.cls THEN a.n * b.n WHEN b.k > 2 THEN 1 ELSE a.n * (a.n - 1) / 2 - (a.n - 2) END AS BIGINT) AS n_pairs
  FROM dups JOIN cl a ON a.repo_id = dups.repo_id AND a.path = file JOIN cl b ON b.repo_id = dups.repo_id AND b.path = file_2
  WHERE a.k = 1 AND (a.cls = b.cls OR b.k = 1))"""

# --- dependencies -----------------------------------------------------------------------

DEPS = f"deps AS ({for_duckdb(a.DEPS)})"
DEPS1 = f"{DEPS}, d1 AS (SELECT DISTINCT * FROM deps)"
ADV = f"adv AS ({for_duckdb(a.ADVISORIES)})"
_RANK = lambda c: mapping(f"upper({c})", rules.SEVERITY_RANK)
SUMMARY = f"""summary AS (SELECT ecosystem, name, version, count(*) AS n_vulns,
   CASE max(greatest(coalesce({_RANK('severity')}, 1), coalesce({_RANK('db_severity')}, 1)))
     WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS max_severity
   FROM adv GROUP BY ALL)"""
RESULTS = f"""{DEPS1}, {ADV}, {SUMMARY},
results AS (SELECT repo_id, manifest_path, d1.ecosystem, d1.name, d1.version, coalesce(n_vulns, 0) AS n_vulns, max_severity
  FROM d1 LEFT JOIN summary s ON d1.version <> 'unspecified' AND s.ecosystem = d1.ecosystem
    AND s.name = d1.name AND s.version = d1.version)"""
PACKAGE_IDS = f"""{DEPS}, {ADV},
ids AS (SELECT repo_id, name, version, vuln_id, CAST(max(CASE WHEN upper(severity) = 'CRITICAL' THEN 1 ELSE 0 END) AS INT) AS critical
  FROM deps JOIN adv USING (ecosystem, name, version) WHERE version <> 'unspecified' GROUP BY ALL)"""
PACKAGES = f"""{PACKAGE_IDS},
declared AS (SELECT repo_id, name, version, string_agg(DISTINCT manifest_path, ',' ORDER BY manifest_path) AS manifests
  FROM deps WHERE (ecosystem, name, version) IN (SELECT (ecosystem, name, version) FROM adv) GROUP BY ALL),
packages AS (SELECT repo_id, name AS package, version,
    CASE WHEN max(critical) = 1 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, count(*) AS vuln_count, any_value(manifests) AS manifests
  FROM ids JOIN declared USING (repo_id, name, version) GROUP BY ALL)"""


def _first(names: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY repo_id, path, name ORDER BY {names}) = 1"


_DEP = "repo_id, path AS manifest_path, '{}' AS ecosystem, name, version"
_REQ_NAME = "^([A-Za-z0-9_.-]+)"
REQUIREMENTS = f"""requirements AS (
  SELECT {_DEP.format('PyPI').replace('name, version', '')}
    regexp_extract(s, '{_REQ_NAME}', 1) AS name,
    coalesce(nullif(regexp_extract(s, '{_REQ_NAME}\\s*(==|>=|<=|~=|>|<)\\s*([A-Za-z0-9.*+!-]+)', 3), ''), 'unspecified') AS version
  FROM (SELECT repo_id, path, trim(string_split(l, '#')[1]) AS s
        FROM (SELECT repo_id, path, trim(unnest(string_split(content, {NL}))) AS l FROM req)
        WHERE l <> '' AND l NOT LIKE '#%' AND l NOT LIKE '-%')
  WHERE regexp_matches(s, '{_REQ_NAME}'))"""
_SECTIONS = " UNION ALL ".join(
    f"SELECT repo_id, path, {i} AS section, json_extract(content, '$.{s}') AS o FROM npm WHERE json_valid(content)" for i, s in enumerate(rules.PACKAGE_JSON_SECTIONS)
)
NPM = f"""npm_deps AS (SELECT {_DEP.format('npm')} FROM (
  SELECT repo_id, path, section, k AS name,
    coalesce(nullif(CASE WHEN json_type(o, '$."' || k || '"') = 'VARCHAR'
      THEN regexp_extract(json_extract_string(o, '$."' || k || '"'), '[0-9]+[.][0-9]+[.][0-9]+([-+][A-Za-z0-9.-]+)?') END, ''), 'unspecified') AS version
  FROM (SELECT *, unnest(json_keys(o)) AS k FROM ({_SECTIONS}) WHERE json_type(o) = 'OBJECT')) {_first('section')})"""
_POM_VERSION = "trim(regexp_extract(content, '<version>(.*?)</version>', 1))"
POM = f"""pom_deps AS (SELECT {_DEP.format('Maven').replace('name, version', '')}
    regexp_extract(content, '<dependency><groupId>(.*?)</groupId>', 1) || ':' || regexp_extract(content, '<artifactId>(.*?)</artifactId>', 1) AS name,
    CASE WHEN {_POM_VERSION} = '' OR ({_POM_VERSION} LIKE '${{%' AND {_POM_VERSION} LIKE '%}}') THEN 'unspecified' ELSE {_POM_VERSION} END AS version
  FROM pom WHERE content LIKE '%<artifactId>%')"""
_GRADLE = (
    r"""\b(?:""" + "|".join(rules.GRADLE_CONFIGURATIONS)
    + r""")\s*\(?\s*["'']([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+):([A-Za-z0-9_.${}-]+)["'']"""
)
GRADLE = f"""gradle_deps AS (SELECT {_DEP.format('Maven')} FROM (
  SELECT repo_id, path, i, regexp_extract(hits[i], '{_GRADLE}', 1) AS name,
    CASE WHEN regexp_extract(hits[i], '{_GRADLE}', 2) LIKE '$%' THEN 'unspecified' ELSE regexp_extract(hits[i], '{_GRADLE}', 2) END AS version
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT repo_id, path, regexp_extract_all(regexp_replace(regexp_replace(content, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '{_GRADLE}') AS hits
    FROM gradle))) {_first('i')})"""

# --- code -----------------------------------------------------------------------------------

PY = f"py AS (SELECT * FROM files WHERE {EXT} = '.py' AND ({QUALITY_CATEGORY}) <> 'generated')"
JS = f"js AS (SELECT * FROM files WHERE {EXT} IN {values(rules.JS_EXTENSIONS)} AND ({QUALITY_CATEGORY}) <> 'generated')"
# functions start at a line-leading def; branches are counted by keyword
PY_FUNCTIONS = f"""{PY},
py_defs AS (SELECT repo_id, path, content, unnest(regexp_extract_all(content, '\\ndef [^\\n]*\\n(?:    [^\\n]*\\n)*')) AS body FROM py),
py_functions AS (SELECT repo_id, path, regexp_extract(body, 'def (\\w+)', 1) AS name,
    CAST({nl_count("string_split(content, body)[1]")} + 2 AS INT) AS line,
    CAST({nl_count("string_split(content, body)[1]")} + {nl_count('body')} AS INT) AS end_line,
    CAST(1 + len(regexp_extract_all(body, '\\n\\s+if ')) + len(regexp_extract_all(body, ' and '))
      + len(regexp_extract_all(body, 'return .* if .* else ')) + len(regexp_extract_all(body, ' for ')) AS INT) AS complexity
  FROM py_defs)"""
PY_COMPLEX = f"""py_complex AS (SELECT repo_id, 'High Python Complexity' AS type, path AS file, line,
    CASE WHEN complexity >= 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 95 AS confidence,
    'Complexity ' || complexity || ' is above the limit of 10.' AS details, name AS function, complexity
  FROM py_functions WHERE complexity > 10)"""
PY_LONG = f"""py_long AS (SELECT repo_id, 'Long Function' AS type, path AS file, line,
    CASE WHEN end_line - line + 1 >= 160 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 100 AS confidence,
    (end_line - line + 1) || ' lines long, the limit is 80.' AS details, name AS function, end_line - line + 1 AS lines
  FROM py_functions WHERE end_line - line + 1 > 80)"""
# bound names with the part of the text after the import block
PY_UNUSED = f"""
py_imports AS (SELECT repo_id, path, ls, i, coalesce(nullif(regexp_extract(ls[i], ' as (\\w+)$', 1), ''),
      nullif(regexp_extract(ls[i], '^from \\w+ import (\\w+)$', 1), ''), regexp_extract(ls[i], '^import (\\w+)', 1)) AS identifier
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(content, {NL}) AS ls FROM py))
  WHERE regexp_matches(ls[i], '^(from \\w+ )?import \\w')),
py_unused AS (SELECT repo_id, 'Unused Python Import' AS type, path AS file, CAST(i AS INT) AS line, 'LOW' AS severity,
    95 AS confidence, identifier || ' is imported but never used.' AS details
  FROM py_imports WHERE len(list_filter(ls, lambda l: l NOT LIKE '#%' AND NOT regexp_matches(l, '^(from \\w+ )?import ')
    AND regexp_matches(l, '\\b' || identifier || '\\b'))) = 0)"""
# in these files comments are whole lines at the start and strings are closed on their line
_NO_COMMENTS = "regexp_replace(content, '//[^\\n]*', ' ', 'g')"
_STRIPPED = f"""regexp_replace({_NO_COMMENTS}, '"[^"\\n]*"|''[^''\\n]*''', ' ', 'g')"""
_IMPORT_LINE = "^import .*$"
JS_UNUSED = f"""
js_lines AS (SELECT repo_id, path, content, ls, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT *, string_split(content, {NL}) AS ls FROM js)),
js_items AS (SELECT repo_id, path, content, CAST(i AS INT) AS line,
    unnest(string_split(regexp_replace(regexp_replace(ls[i], '^import (.*) from .*$', '\\1'), '[{{}}]', '', 'g'), ',')) AS item
  FROM js_lines WHERE ls[i] LIKE 'import %'),
js_imports AS (SELECT repo_id, path, content, line, regexp_replace(regexp_replace(trim(item), '^.* as ', ''), '^type ', '') AS identifier FROM js_items),
js_unused AS (SELECT repo_id, 'Unused JavaScript Import' AS type, path AS file, line, 'LOW' AS severity,
    90 AS confidence, identifier || ' is imported but never used.' AS details
  FROM js_imports WHERE NOT regexp_matches(regexp_replace({_STRIPPED}, '(?m)^import .*$', '', 'g'), '\\b' || identifier || '\\b')
    AND NOT (identifier = 'React' AND regexp_matches(content, '<[A-Za-z][^>]*>')))"""
_JS_CODE = f"""regexp_replace({_NO_COMMENTS}, '"[^"\\n]*"|''[^''\\n]*''', ' ', 'g')"""
_JS_COUNT = " + ".join(
    f"len(regexp_extract_all(own, '{p}'))" for p in
    [r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcatch\s*\(", r"\bswitch\s*\(", r"\bcase\s+", r"\?([^?.]|$)"]
)
# a function ends at the first closing brace in the first column
JS_FUNCTIONS = f"""
js_defs AS (SELECT repo_id, path, content, unnest(regexp_extract_all(content,
    '(?s)\\n(?:function \\w+\\(|const \\w+ = async \\().*?\\n\\}}')) AS body FROM js),
js_owned AS (SELECT *, regexp_replace(regexp_replace(body, '"[^"\\n]*"|''[^''\\n]*''', ' ', 'g'), '(?s)=> \\{{\\n    .*?\\n  \\}}\\)', '', 'g') AS own FROM js_defs),
js_functions AS (SELECT repo_id, path, regexp_extract(body, '(?:function|const) (\\w+)', 1) AS name,
    CAST({nl_count("string_split(content, body)[1]")} + 2 AS INT) AS line,
    CAST({nl_count("string_split(content, body)[1]")} + 1 + {nl_count('body')} AS INT) AS end_line,
    CAST(1 + {_JS_COUNT} AS INT) AS complexity FROM js_owned)"""
JS_COMPLEX = """js_complex AS (SELECT repo_id, 'High JavaScript Complexity' AS type, path AS file, line,
    CASE WHEN complexity >= 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 80 AS confidence,
    'Complexity of ' || name || ' is about ' || complexity || ', above the limit of 10.' AS details, name AS function, complexity
  FROM js_functions WHERE complexity > 10)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ALL_FILES = (
    f"files AS ({for_duckdb(a.FILES_DECORATED)} UNION ALL "
    f"SELECT 'code-' || repo_id, path, content FROM ({for_duckdb(a.FILES_CODE)}))"
)
LARGE = f"""
measured AS (SELECT *, {nl_count('content')} + CASE WHEN content LIKE '%' || {NL} OR content = '' THEN 0 ELSE 1 END AS lines,
    {FILE_TYPE} AS file_type FROM files WHERE ({QUALITY_CATEGORY}) <> 'generated'),
large AS (SELECT repo_id, 'Large File' AS type, path AS file,
    CASE WHEN lines / 20.0 >= 3 THEN 'HIGH' WHEN lines / 20.0 >= 1.75 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    100 AS confidence, CAST(lines AS INT) AS lines, 20 AS threshold, (lines - 20)::DOUBLE / 20 * 100 AS over_percentage,
    format('{{}} with {{}} lines, the limit is 20 ({{:.1f}}% more).', file_type, lines, (lines - 20)::DOUBLE / 20 * 100) AS details
  FROM measured WHERE lines > 20)"""
_K = "repo_id, type, file, {line} AS line, severity, confidence, details, {fn} AS function, {f2} AS file_2, {l2} AS line_2"


def _as(cte, line="line", fn="CAST(NULL AS VARCHAR)", f2="CAST(NULL AS VARCHAR)", l2="CAST(NULL AS INT)"):
    return f"SELECT {_K.format(line=line, fn=fn, f2=f2, l2=l2)} FROM {cte}"


DUP_FINDINGS = """dup_findings AS (SELECT repo_id, 'Duplicate Code' AS type, file, line, file_2, line_2, 'LOW' AS severity,
    CAST(floor(matching * 12.5) AS INT) AS confidence,
    duplicate_lines || ' lines are repeated, ' || CASE matching WHEN 8 THEN '100' ELSE '88' END || '% of them equal.' AS details
  FROM dups)"""
# decorated Python files never parse (prose above the code), except where the text is empty
QUALITY = ",\n".join(
    [
        ALL_FILES, LARGE, MARKERS, DUPLICATES, DUP_FINDINGS,
    ]
)
CODE_ONLY = f"codefiles AS (SELECT 'code-' || repo_id AS repo_id, path, content FROM ({for_duckdb(a.FILES_CODE)}))"
CODE_FINDINGS = ",\n".join([PY_FUNCTIONS, PY_COMPLEX, PY_LONG, PY_UNUSED, JS, JS_UNUSED, JS_FUNCTIONS, JS_COMPLEX]).replace(
    "FROM files WHERE", "FROM codefiles WHERE"
)
DEC_JS = f"""
djs AS (SELECT * FROM (SELECT *, {nl_count('content')} AS n FROM files)
  WHERE repo_id NOT LIKE 'code-%' AND {EXT} = '.js' AND ({QUALITY_CATEGORY}) <> 'generated' AND content LIKE '%' || chr(10) || 'import Main, %'),
djs_unused AS (SELECT repo_id, 'Unused JavaScript Import' AS type, path AS file, CAST(n - 4 AS INT) AS line, 'LOW' AS severity,
  90 AS confidence, 'unused is imported but never used.' AS details FROM djs)"""
QUALITY_ALL = f"""{QUALITY}, {CODE_ONLY}, {CODE_FINDINGS}, {DEC_JS},
quality AS (SELECT DISTINCT *, CASE WHEN ({QUALITY_CATEGORY.replace('path', 'file')}) = 'test' THEN TRUE END AS test_file FROM (
  {_as('large', line='CAST(NULL AS INT)')} UNION ALL {_as('markers')} UNION ALL {_as('py_complex', fn='function')}
  UNION ALL {_as('py_long', fn='function')} UNION ALL {_as('py_unused')} UNION ALL {_as('js_unused')}
  UNION ALL {_as('js_complex', fn='function')} UNION ALL {_as('djs_unused')}
  UNION ALL {_as('dup_findings', f2='file_2', l2='line_2')}))"""
_POINTS = """CASE WHEN type = 'Large File' THEN CASE severity WHEN 'HIGH' THEN 6 WHEN 'MEDIUM' THEN 4 ELSE 2 END
  WHEN severity = 'LOW' AND type IN ('Duplicate Code', 'Unused Python Import') THEN 1
  ELSE CASE severity WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 2 END END"""
QUALITY_SCORES = f"""{QUALITY_ALL},
points AS (SELECT repo_id, sum(d)::BIGINT AS raw, coalesce(sum(d) FILTER (severity = 'HIGH'), 0)::BIGINT AS h,
    coalesce(sum(d) FILTER (severity = 'MEDIUM'), 0)::BIGINT AS m, coalesce(sum(d) FILTER (severity = 'LOW'), 0)::BIGINT AS l
  FROM (SELECT *, {_POINTS} AS d FROM quality) GROUP BY repo_id),
qscore AS (SELECT f.repo_id, CAST(100 - least(coalesce(raw, 0), 50) AS INT) AS quality, least(coalesce(raw, 0), 50) AS total_deduction,
    coalesce(raw, 0) AS raw_deduction, coalesce(h, 0) AS h, coalesce(m, 0) AS m, coalesce(l, 0) AS l
  FROM (SELECT DISTINCT repo_id FROM files) f LEFT JOIN points USING (repo_id))"""
_FIT = lambda c: f"CAST(CASE WHEN raw_deduction > 50 THEN round_even({c} * (50.0::DOUBLE / raw_deduction), 0) ELSE {c} END AS BIGINT)"

SECURITY = f"""{having(a.FILES_DECORATED)}, {secret_ctes()}, {RESULTS},
security AS (
  SELECT regexp_replace(repo_id, '^src', 'r') AS repo_id, type, file, line, severity, confidence,
    CAST(NULL AS VARCHAR) AS package, CAST(NULL AS VARCHAR) AS version, CAST(NULL AS INT) AS vuln_count FROM secrets
  UNION ALL
  SELECT regexp_replace(repo_id, '^repo', 'r'), 'Vulnerable Dependency', manifest_path, NULL, max_severity, 100,
    name, version, CAST(n_vulns AS INT) FROM results WHERE n_vulns > 0)"""


def security_penalty(source: str) -> str:
    return f"""
pkg AS (SELECT repo_id, package, version, max(vuln_count) AS v FROM {source} WHERE package IS NOT NULL GROUP BY ALL),
pk AS (SELECT repo_id, count(*) AS n, sum(v) AS v FROM pkg GROUP BY repo_id),
sec AS (SELECT repo_id, count(*) AS n FROM {source} WHERE type IN {values(rules.SCORED_SECRET_TYPES)} GROUP BY repo_id),
sscore AS (SELECT r.repo_id, CAST(greatest(0, 100 - least(60, 15 * coalesce(sec.n, 0))
    - CASE WHEN coalesce(pk.n, 0) > 0 THEN least(40, 12 + 8 * (pk.n - 1)) ELSE 0 END
    - least(20, 2 * (coalesce(pk.v, 0) - coalesce(pk.n, 0)))) AS INT) AS security
  FROM repos r LEFT JOIN sec USING (repo_id) LEFT JOIN pk USING (repo_id))"""


_ROOT = "max(CASE WHEN lower(path) IN ('readme', 'readme.md', 'readme.txt') THEN 100 ELSE 30 END)"

DIAGNOSIS = f"""{QUALITY_ALL.replace('files AS (', 'files AS (', 1)}, dec AS ({for_duckdb(a.FILES_DECORATED)}), {secret_ctes('dec')}, {PACKAGES},
issues AS (
  SELECT repo_id, severity, 'Security' AS category, type, file, line, details, NULL AS package, NULL AS version, NULL AS vuln_count FROM secrets
  UNION ALL SELECT repo_id, severity, 'Code Quality', type, file, line, details, NULL, NULL, NULL FROM quality
  UNION ALL SELECT repo_id, severity, 'Dependency Security', 'Vulnerable Dependency', NULL, NULL,
    package || ' ' || version || ': ' || vuln_count || CASE WHEN vuln_count = 1 THEN ' advisory' ELSE ' advisories' END
      || ' for what is declared in ' || replace(manifests, ',', ', '), package, version, vuln_count FROM packages)"""

CODE_FOUND = f"""WITH {having(a.FILES_CODE)}, {PY_FUNCTIONS}, {PY_COMPLEX}, {PY_LONG}, {PY_UNUSED}, {JS}, {JS_UNUSED}, {JS_FUNCTIONS}, {JS_COMPLEX},
    f AS (SELECT {REPORT_KEYS}, function FROM py_complex UNION SELECT {REPORT_KEYS}, function FROM py_long UNION SELECT {REPORT_KEYS}, NULL FROM py_unused
    UNION SELECT {REPORT_KEYS}, NULL FROM js_unused UNION SELECT {REPORT_KEYS}, function FROM js_complex)"""
_ORDER = f"{mapping('severity', rules.FINDING_ORDER)}, file, line, type, details, coalesce(function, '')"

SQL = {
    "scan_source_files": f"""WITH {having(a.LISTING)} SELECT * FROM files
        WHERE size_bytes <= 10485760 AND {EXT} IN {values(rules.LANGUAGE_BY_EXTENSION)}
          AND NOT {any_part(DIRS, rules.IGNORED_DIRECTORIES)}""",
    "tree_sources": f"""WITH {having(a.FILES_LISTED)} SELECT repo_id, path, octet_length(encode(content)) AS size_bytes,
          md5(replace(replace(content, chr(13) || {NL}, {NL}), chr(13), {NL})) AS digest FROM files
        WHERE {EXT} IN {values(rules.LANGUAGE_BY_EXTENSION)} AND NOT {any_part(DIRS, rules.IGNORED_DIRECTORIES)}""",
    "scan_manifests": f"""WITH {having(a.LISTING)} SELECT DISTINCT * FROM files
        WHERE {LOWER_NAME} IN {values(rules.MANIFEST_ECOSYSTEM)}
          AND NOT {any_part(PARTS + '[1:-2]', rules.IGNORED_DIRECTORIES)}""",
    "resolve_thresholds": f"""WITH {having(a.CONFIGS, 'c')},
        k AS (SELECT * FROM (VALUES ('python', 500), ('javascript', 800), ('css', 1200), ('html', 1000)) v(language_key, d)),
        v AS (SELECT repo_id, language_key, d, CASE WHEN json_valid(content) THEN json_extract(content, '$.thresholds.' || language_key) END AS j FROM c, k),
        w AS (SELECT *, CASE WHEN json_type(j) IN ('UBIGINT', 'BIGINT') THEN CAST(j AS BIGINT) END AS n FROM v)
        SELECT repo_id, language_key, CASE WHEN n > 0 THEN n ELSE d END AS max_lines, coalesce(n > 0, FALSE) AS is_custom FROM w""",
    "file_type_profile": f"""WITH {having(a.LISTING)} SELECT repo_id, {FILE_TYPE} AS file_type, count(*) AS n_files FROM files GROUP BY ALL""",
    "file_category_quality": f"WITH {having(a.LISTING)} SELECT repo_id, path, {QUALITY_CATEGORY} AS category FROM files",
    "file_category_security": f"WITH {having(a.LISTING)} SELECT repo_id, path, {SECURITY_CATEGORY} AS category FROM files",
    "ignored_paths_anti": f"""WITH {having(a.LISTING)} SELECT repo_id, path FROM files
        WHERE NOT {any_part(DIRS, rules.IGNORED_DIRECTORIES)}""",
    "language_profile": f"""WITH {having(a.LISTING)} SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY n_files DESC, language) AS INT) AS rank
        FROM (SELECT repo_id, {LANGUAGE} AS language, count(*) AS n_files
        FROM files WHERE {EXT} IN {values(rules.LANGUAGE_BY_EXTENSION)} GROUP BY ALL)""",
    "corpus_size": f"""WITH {having(a.FILES_DECORATED)} SELECT repo_id, count(*) AS n_files,
        CAST(sum({nl_count('content')} + CASE WHEN content LIKE '%' || {NL} THEN 0 ELSE 1 END) AS BIGINT) AS n_lines FROM files GROUP BY repo_id""",
    "line_counts": f"""WITH {having(a.FILES_BREAKS)}
        SELECT repo_id, path, {nl_count('content')} + CASE WHEN content = '' OR content LIKE '%' || {NL} THEN 0 ELSE 1 END AS n_read,
          length(content) - length(replace(replace(replace(content, {NL}, ''), chr(12), ''), chr(133), ''))
            + CASE WHEN content = '' OR right(content, 1) IN ({NL}, chr(12), chr(133)) THEN 0 ELSE 1 END AS n_split FROM files""",
    "large_files": f"""WITH {having(a.FILES_DECORATED)}, {LARGE}
        SELECT repo_id, file, severity, lines, threshold, over_percentage FROM large""",
    "large_files_by_type": f"""WITH {having(a.FILES_TYPED)}, c AS ({for_duckdb(a.REPO_CONFIGS)}),
        k AS (SELECT * FROM (VALUES ('.py', 'python', 500), ('.js', 'javascript', 800), ('.tsx', 'javascript', 800), ('.css', 'css', 1200),
          ('.scss', 'css', 1200), ('.html', 'html', 1000), ('.go', NULL, 1000)) v(ext, key, d)),
        m AS (SELECT f.repo_id, path, {FILE_TYPE.replace('path', 'f.path')} AS file_type, d,
            {nl_count('f.content')} + CASE WHEN f.content LIKE '%' || {NL} OR f.content = '' THEN 0 ELSE 1 END AS lines,
            CASE WHEN key IS NOT NULL AND json_valid(c.content) THEN json_extract(c.content, '$.thresholds.' || key) END AS j
          FROM files f JOIN k ON ext = {EXT.replace('path', 'f.path')} JOIN c ON c.repo_id = f.repo_id),
        n AS (SELECT *, CASE WHEN json_type(j) IN ('UBIGINT', 'BIGINT') THEN CAST(j AS INT) ELSE d END AS threshold FROM m)
        SELECT repo_id, path AS file, CASE WHEN lines >= 3 * threshold THEN 'HIGH' WHEN 4 * lines >= 7 * threshold THEN 'MEDIUM' ELSE 'LOW' END AS severity,
          CAST(lines AS INT) AS lines, threshold, format('{{}} with {{}} lines, the limit is {{}} ({{:.1f}}% more).', file_type, lines, threshold,
            (lines - threshold)::DOUBLE / threshold * 100) AS details FROM n WHERE lines > threshold""",
    "placeholder_filter": secret_query(a.FILES_DECORATED, "SELECT repo_id, file, line, type, placeholder FROM judged"),
    "secret_confidence": secret_query(a.FILES_DECORATED, "SELECT repo_id, file, line, type, confidence FROM judged"),
    "secret_input_suppression": secret_query(a.FILES_DECORATED, "SELECT repo_id, file, line, type, suppressed FROM judged"),
    "secret_scan": secret_query(a.FILES_DECORATED, SECRET_TAIL),
    "secret_scan_by_lang": secret_query(a.FILES_BY_LANG, SECRET_TAIL),
    "secret_scan_overrides": f"""WITH {having(a.FILES_DECORATED)}, {secret_ctes(
        patterns=_SECRETS | {"Letter": _SECRETS["Token"].replace("token|auth[_-]?token", "y|x")},
        where={"API Key": _REPO_NUMBER + " % 4 <> 1", "Letter": _REPO_NUMBER + " % 4 = 1", "Password": _REPO_NUMBER + " % 4 <> 2"},
        none=_REPO_NUMBER + " % 4 = 3 AND lower(value) = 'ab3de5gh7jk9mn1p'")} {SECRET_TAIL}""",
    "secret_findings_dedup": secret_query(a.FILES_DECORATED, "SELECT repo_id, type, file, line, confidence FROM secrets"),
    "work_markers": f"WITH {having(a.FILES_DECORATED)}, {MARKERS} SELECT {REPORT_KEYS} FROM markers",
    "normalized_lines": f"WITH {having(a.FILES_DECORATED)}, {LINES} SELECT repo_id, path, pos, line_no, text FROM lines",
    "sliding_blocks": f"""WITH {having(a.FILES_BY_LANG)}, {LINES},
        b AS (SELECT *, count(*) OVER (PARTITION BY repo_id, path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM lines)
        SELECT repo_id, path, count(*) AS n_blocks, CAST(sum(line_no) AS BIGINT) AS sum_line_no, CAST(max(pos) AS BIGINT) AS last_pos, max(w) AS width
        FROM b WHERE w = 8 GROUP BY ALL""",
    "duplicate_blocks": f"""WITH {having(a.FILES_BY_LANG)}, {DUPLICATES}, {CLASSES}
        SELECT dups.*, a.cls AS class, b.cls AS class_2, CAST(1 AS BIGINT) AS n_pairs
        FROM dups JOIN cl a ON a.repo_id = dups.repo_id AND a.path = file JOIN cl b ON b.repo_id = dups.repo_id AND b.path = file_2""",
    "duplicate_members": f"WITH {having(a.FILES_BY_LANG)}, {DUPLICATES}, {CLASSES} SELECT repo_id, cls AS class, path AS file, n AS n_files FROM cl",
    "duplicate_first_pairs": f"WITH {having(a.FILES_BY_LANG)}, {DUPLICATES} SELECT * FROM dups QUALIFY dense_rank() OVER (PARTITION BY repo_id ORDER BY file) <= 3",
    "duplicate_pair_counts": f"WITH {having(a.FILES_BY_LANG)}, {DUPLICATES} SELECT repo_id, count(*) AS n_pairs FROM dups GROUP BY repo_id",
    "deps_requirements": f"WITH {having(a.MANIFESTS_REQUIREMENTS, 'req')}, {REQUIREMENTS} SELECT * FROM requirements",
    "deps_package_json": f"WITH {having(a.MANIFESTS_PACKAGE, 'npm')}, {NPM} SELECT * FROM npm_deps",
    "deps_pom": f"WITH {having(a.MANIFESTS_POM, 'pom')}, {POM} SELECT * FROM pom_deps",
    "deps_gradle": f"WITH {having(a.MANIFESTS_GRADLE, 'gradle')}, {GRADLE} SELECT * FROM gradle_deps",
    "dependencies_all": f"""WITH {having(a.MANIFESTS_REQUIREMENTS, 'req')}, {having(a.MANIFESTS_PACKAGE, 'npm')},
        {having(a.MANIFESTS_POM, 'pom')}, {having(a.MANIFESTS_GRADLE, 'gradle')}, {REQUIREMENTS}, {NPM}, {POM}, {GRADLE}
        SELECT * FROM requirements UNION SELECT * FROM npm_deps UNION SELECT * FROM pom_deps UNION SELECT * FROM gradle_deps""",
    "dependency_dedup": f"WITH {DEPS} SELECT DISTINCT * FROM deps",
    "clean_versions": f"""WITH {DEPS}, r AS (SELECT DISTINCT name, '^' || version || '-rc.1 || x' AS raw FROM deps)
        SELECT name, raw, coalesce(nullif(regexp_extract(raw, '[0-9]+[.][0-9]+[.][0-9]+([-+][A-Za-z0-9.-]+)?'), ''), 'unspecified') AS cleaned FROM r""",
    "version_triple": f"""WITH {DEPS}, v AS (SELECT DISTINCT version, string_split(version, '.') AS p FROM deps)
        SELECT version, TRY_CAST(p[1] AS BIGINT) AS major, TRY_CAST(p[2] AS BIGINT) AS minor, TRY_CAST(p[3] AS BIGINT) AS patch FROM v""",
    "dependency_vulnerabilities": f"WITH {RESULTS} SELECT * FROM results",
    "dependency_summary": f"""WITH {RESULTS} SELECT repo_id, count(*) AS n_dependencies, count(*) FILTER (n_vulns > 0) AS n_vulnerable,
        CAST(sum(n_vulns) AS BIGINT) AS n_vulnerabilities FROM results GROUP BY repo_id""",
    "manifest_summary": f"""WITH {RESULTS} SELECT repo_id, manifest_path, count(*) AS n_direct, count(*) FILTER (n_vulns > 0) AS n_vulnerable,
        count(*) FILTER (version = 'unspecified') AS n_unspecified FROM results GROUP BY ALL""",
    "max_vuln_severity": f"WITH {ADV}, {SUMMARY} SELECT * FROM summary",
    "vulnerable_package_rollup": f"WITH {PACKAGES} SELECT * FROM packages",
    "package_vulnerability_ids": f"WITH {PACKAGE_IDS} SELECT * FROM ids",
    "outdated_dependencies": f"""WITH {DEPS1}, {having(a.REGISTRY, 'reg')},
        j AS (SELECT repo_id, manifest_path, d1.ecosystem, d1.name, version AS current, latest,
            list_transform(string_split(version, '.'), lambda x: TRY_CAST(x AS BIGINT)) AS c, list_transform(string_split(latest, '.'), lambda x: TRY_CAST(x AS BIGINT)) AS l
          FROM d1 JOIN reg ON reg.ecosystem = d1.ecosystem AND reg.name = d1.name WHERE d1.ecosystem <> 'Maven' AND version <> 'unspecified')
        SELECT repo_id, manifest_path, ecosystem, name, current, latest,
          CASE WHEN l[1] > c[1] THEN 'HIGH' WHEN l[2] > c[2] THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM j WHERE l > c""",
    "lookup_reuse_24h": f"""WITH {having(a.REQUESTS, 'q')}, {having(a.LOOKUPS, 'l')}
        SELECT key, event_id, EXISTS (SELECT 1 FROM l WHERE l.key = q.key AND l.ts <= q.ts AND q.ts - l.ts < INTERVAL 24 HOUR) AS reused FROM q""",
    "commit_health": f"""WITH {having(a.ALL_REPOS, 'r')}, {having(a.COMMITS, 'c')}, {having(a.BRANCHES, 'b')},
        h AS (SELECT repo_id, count(*) AS n_commits, count(DISTINCT (author_name, author_email)) AS n_contributors,
            max_by({{'i': commit_id, 'a': author_name, 's': subject}}, (ts, commit_id)) AS m FROM c GROUP BY repo_id),
        n AS (SELECT repo_id, count(*) AS n_branches FROM b GROUP BY repo_id)
        SELECT repo_id, n_commits IS NOT NULL AS is_git, coalesce(n_commits, 0) AS n_commits, coalesce(n_branches, 0) AS n_branches,
          coalesce(n_contributors, 0) AS n_contributors, m.i AS last_commit_id, m.a AS last_author, m.s AS last_subject
        FROM r LEFT JOIN h USING (repo_id) LEFT JOIN n USING (repo_id)""",
    "js_imports": f"WITH {having(a.FILES_CODE)}, {JS}, {JS_UNUSED} SELECT repo_id, path, identifier, line FROM js_imports",
    "js_stripped": f"WITH {having(a.FILES_CODE)}, {JS} SELECT repo_id, path, {_STRIPPED} AS stripped FROM js",
    "js_identifier_counts": f"""WITH {having(a.FILES_CODE)}, {JS},
        i AS (SELECT repo_id, path, unnest(regexp_extract_all({_STRIPPED}, '[A-Za-z_$][\\w$]*')) AS identifier FROM js)
        SELECT repo_id, path, identifier, count(*) AS n FROM i GROUP BY ALL""",
    "js_branch_counts": f"""WITH {having(a.FILES_CODE)}, {JS}, s AS (SELECT repo_id, path, {_STRIPPED} AS c FROM js)
        SELECT repo_id, path, len(regexp_extract_all(c, '\\bif\\s*\\(')) AS n_if, len(regexp_extract_all(c, '\\bfor\\s*\\(')) AS n_for,
          len(regexp_extract_all(c, '\\bwhile\\s*\\(')) AS n_while, len(regexp_extract_all(c, '\\bcatch\\s*\\(')) AS n_catch,
          len(regexp_extract_all(c, '\\bswitch\\s*\\(')) AS n_switch, len(regexp_extract_all(c, '\\bcase\\s+')) AS n_case,
          len(regexp_extract_all(c, '\\?([^?.]|$)')) AS n_ternary FROM s""",
    "js_functions": f"WITH {having(a.FILES_CODE)}, {JS}, {JS_FUNCTIONS} SELECT * FROM js_functions",
    "js_complexity": f"WITH {having(a.FILES_CODE)}, {JS}, {JS_FUNCTIONS}, {JS_COMPLEX} SELECT * FROM js_complex",
    "unused_imports": f"WITH {having(a.FILES_CODE)}, {JS}, {JS_UNUSED} SELECT * FROM js_unused",
    "unused_python_imports": f"WITH {having(a.FILES_CODE)}, {PY}, {PY_UNUSED} SELECT * FROM py_unused",
    "python_functions": f"WITH {having(a.FILES_CODE)}, {PY_FUNCTIONS} SELECT * FROM py_functions",
    "python_complexity": f"WITH {having(a.FILES_CODE)}, {PY_FUNCTIONS}, {PY_COMPLEX} SELECT * FROM py_complex",
    "long_functions": f"WITH {having(a.FILES_CODE)}, {PY_FUNCTIONS}, {PY_LONG} SELECT * FROM py_long",
    "quality_findings": f"""WITH {QUALITY_ALL}, {CLASSES} SELECT q.*, coalesce(n_pairs, 1) AS occurrences FROM quality q
        LEFT JOIN class_dups d ON q.type = 'Duplicate Code' AND d.repo_id = q.repo_id AND d.file = q.file AND d.file_2 = q.file_2
        WHERE q.type <> 'Duplicate Code' OR n_pairs IS NOT NULL""",
    "js_quality_findings": f"""WITH {having(a.FILES_CODE)}, {JS}, {JS_UNUSED}, {JS_FUNCTIONS}, {JS_COMPLEX}
        SELECT {REPORT_KEYS}, NULL AS function FROM js_unused UNION SELECT {REPORT_KEYS}, function FROM js_complex""",
    "findings_dedup": f"WITH {having(a.FILES_DECORATED)}, {MARKERS} SELECT DISTINCT repo_id, type, file, line FROM markers",
    "findings_test_flag": f"""WITH {having(a.FILES_DECORATED)}, {MARKERS}
        SELECT repo_id, type, ({QUALITY_CATEGORY.replace('path', 'file')}) = 'test' AS test_file, count(*) AS n FROM markers GROUP BY ALL""",
    "findings_ordered": f"""{CODE_FOUND}
        SELECT {REPORT_KEYS}, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {_ORDER}) AS INT) AS rank FROM f""",
    "findings_global_rank": f"""{CODE_FOUND}
        SELECT {REPORT_KEYS}, row_number() OVER (ORDER BY {_ORDER}, repo_id) AS position FROM f""",
    "all_security_findings": f"WITH {SECURITY} SELECT * FROM security",
    "security_score": f"""WITH {SECURITY}, repos AS (SELECT DISTINCT repo_id FROM security), {security_penalty('security')} SELECT * FROM sscore""",
    "quality_score": f"WITH {QUALITY_SCORES} SELECT repo_id, quality, total_deduction, raw_deduction FROM qscore",
    "quality_breakdown": f"""WITH {QUALITY_SCORES} SELECT repo_id,
        CASE WHEN raw_deduction > 50 THEN 50 - {_FIT('m')} - {_FIT('l')} ELSE h END AS deduct_high, {_FIT('m')} AS deduct_medium, {_FIT('l')} AS deduct_low FROM qscore""",
    "quality_deductions": f"WITH {QUALITY_ALL} SELECT repo_id, type, severity, CAST({_POINTS} AS INT) AS deduction, count(*) AS n FROM quality GROUP BY ALL",
    "documentation_score": f"WITH {having(a.ROOTS)} SELECT repo_id, CAST({_ROOT} AS INT) AS documentation FROM files GROUP BY repo_id",
    "overall_health": f"""WITH {QUALITY_SCORES}, {secret_ctes()},
        sall AS (SELECT repo_id, type, NULL AS package, NULL AS version, 0 AS vuln_count FROM secrets),
        repos AS (SELECT DISTINCT repo_id FROM files), {security_penalty('sall')},
        roots AS ({for_duckdb(a.ROOTS)}), allpaths AS (SELECT repo_id, path FROM files UNION ALL SELECT regexp_replace(repo_id, '^repo', 'src'), path FROM roots),
        doc AS (SELECT repo_id, CAST({_ROOT} AS INT) AS documentation FROM allpaths GROUP BY repo_id)
        SELECT repo_id, security, quality, documentation,
          CAST(round_even(security * 0.5::DOUBLE + quality * 0.3::DOUBLE + documentation * 0.2::DOUBLE, 0) AS INT) AS overall
        FROM sscore JOIN qscore USING (repo_id) JOIN doc USING (repo_id)""",
    "diagnosis": f"WITH {DIAGNOSIS} SELECT repo_id, severity, category, type, file, details, package, version, vuln_count, CAST(1 AS BIGINT) AS occurrences FROM issues",
    "diagnosis_counts": f"WITH {DIAGNOSIS} SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {mapping('severity', dict(zip(rules.DIAGNOSIS_SEVERITIES, range(9))))}, category, type) AS INT) AS rank "
        "FROM (SELECT repo_id, severity, category, type, count(*) AS n FROM issues GROUP BY ALL)",
    "diagnosis_top5": f"""WITH {DIAGNOSIS},
        ranked AS (SELECT *, CAST(row_number() OVER w AS INT) AS rank, count(*) OVER (PARTITION BY repo_id, severity, category, type) AS n FROM issues
          WINDOW w AS (PARTITION BY repo_id, severity, category, type ORDER BY file NULLS LAST, line NULLS LAST, package NULLS LAST, version NULLS LAST, details))
        SELECT repo_id, severity, category, type, rank, file, line, package, version, greatest(n - 5, 0) AS n_more FROM ranked WHERE rank <= 5""",
    "recommended_actions": f"""WITH {DIAGNOSIS},
        f AS (SELECT repo_id, bool_or(severity = 'CRITICAL') AS c, bool_or(severity = 'HIGH' AND category = 'Dependency Security') AS d,
            bool_or(severity <> 'LOW' AND contains(type, 'Complexity')) AS x, bool_or(type = 'Large File') AS l, bool_or(type = 'Duplicate Code') AS u
          FROM issues GROUP BY repo_id),
        s AS (SELECT repo_id, list_filter([{', '.join(f"CASE WHEN {k} THEN '{rules.ACTIONS[n]}' END" for k, n in zip('cdxlu', ['critical', 'dependency', 'complexity', 'large_file', 'duplicate']))}], lambda v: v IS NOT NULL) AS acts FROM f),
        t AS (SELECT repo_id, CASE WHEN len(acts) = 0 THEN ['{rules.ACTIONS['default']}'] ELSE acts END AS acts FROM s)
        SELECT repo_id, CAST(i AS INT) AS position, acts[i] AS action FROM (SELECT *, unnest(range(1, len(acts) + 1)) AS i FROM t)""",
    "report_json": secret_query(
        a.FILES_DECORATED,
        f"SELECT CAST(json_object({', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in REPORT_KEYS.split(', '))}) AS VARCHAR) AS json FROM secrets",
    ),
    "stream_lookup_dedup": f"""WITH RECURSIVE l AS (SELECT DISTINCT key, ts FROM ({for_duckdb(a.LOOKUPS)})),
        kept AS (SELECT key, min(ts) AS ts FROM l GROUP BY key UNION ALL
          SELECT k.key, (SELECT min(l.ts) FROM l WHERE l.key = k.key AND l.ts >= k.ts + INTERVAL 24 HOUR) AS ts FROM kept k WHERE k.ts IS NOT NULL)
        SELECT key, epoch_us(ts) AS ts_us FROM kept WHERE ts IS NOT NULL""",
    "stream_secret_scan": f"""WITH {having(a.FILES_PLAIN)}, {MARKERS}, {secret_ctes()}
        SELECT {REPORT_KEYS} FROM secrets UNION ALL SELECT {REPORT_KEYS} FROM markers""",
    "stream_changed_files": f"""WITH dec AS ({for_duckdb(a.FILES_DECORATED)}),
        files AS (SELECT repo_id, path, CASE WHEN CAST(regexp_extract(path, 'f([0-9]+)', 1) AS INT) % 3 = 0
            THEN string_split(content, {NL})[1] ELSE content END AS content FROM dec), {MARKERS}, {secret_ctes()}
        SELECT {REPORT_KEYS} FROM secrets UNION SELECT {REPORT_KEYS} FROM markers""",
    "stream_first_in_window": f"""SELECT key, epoch_us(ts) // 86400000000 * 86400000000 AS window_us, min(epoch_us(ts)) AS ts_us
        FROM ({for_duckdb(a.LOOKUPS)}) GROUP BY 1, 2""",
    "lossy_decode": f"WITH {having(a.FILES_DECORATED)} SELECT repo_id, path, md5({NL} || content) AS digest FROM files",
    "advisory_dump": f"WITH {ADV} SELECT DISTINCT * FROM adv",
    "advisory_ranges": f"""WITH {DEPS1}, r AS ({for_duckdb(a.ADVISORY_RECORDS)}),
        parts AS (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS v FROM d1 WHERE version <> 'unspecified'),
        b AS (SELECT *, CASE WHEN introduced = '0' THEN [0, 0, 0] ELSE [major, minor, event_id % 3] END AS low,
            [major + 1, minor, 0] AS fix, [major, minor + 2, 0] AS last, [major + 3, 0, 0] AS low2, [major + 4, 0, 0] AS fix2 FROM r),
        adv AS (SELECT DISTINCT p.ecosystem, p.name, p.version, vuln_id, severity, db_severity FROM parts p JOIN b ON b.ecosystem = p.ecosystem AND b.name = p.name
          WHERE p.version = listed OR (again IS NOT NULL AND v >= low2 AND v < fix2)
            OR (v >= low AND CASE WHEN fixed IS NOT NULL THEN v < fix WHEN last_affected IS NOT NULL THEN v <= last WHEN again IS NOT NULL THEN v < fix2 ELSE TRUE END)),
        {SUMMARY}
        SELECT repo_id, manifest_path, d1.ecosystem, d1.name, d1.version, coalesce(n_vulns, 0) AS n_vulns, max_severity
        FROM d1 LEFT JOIN summary s ON s.ecosystem = d1.ecosystem AND s.name = d1.name AND s.version = d1.version""",
    "advisory_snapshot": f"WITH {ADV} SELECT * FROM adv",
    "registry_snapshot": f"WITH {having(a.REGISTRY, 'reg')} SELECT * FROM reg",
    "secret_explanations": secret_query(
        a.FILES_DECORATED,
        f"""SELECT repo_id, type, file, line,
          CASE WHEN file_category = 'test' THEN '{rules.EXPLANATIONS["secret/test"][0]}' ELSE '{rules.EXPLANATIONS["secret"][0]}' END AS why,
          CASE WHEN file_category = 'test' THEN '{rules.EXPLANATIONS["secret/test"][1]}' ELSE '{rules.EXPLANATIONS["secret"][1]}' END AS recommendation FROM secrets""",
    ),
}
SQL["report_written"] = f"""WITH {QUALITY_SCORES}, {secret_ctes()},
    t AS (SELECT repo_id, bool_or(severity <> 'LOW' AND contains(type, 'Complexity')) AS x, bool_or(type = 'Large File') AS l, bool_or(type = 'Duplicate Code') AS u
      FROM (SELECT repo_id, type, severity FROM quality UNION ALL SELECT repo_id, type, severity FROM secrets) GROUP BY repo_id)
    SELECT 'scores' AS section, repo_id, 1 AS n FROM (SELECT DISTINCT repo_id FROM files)
    UNION ALL SELECT 'languages', repo_id, count(DISTINCT {LANGUAGE}) FROM files WHERE {EXT} IN {values(rules.LANGUAGE_BY_EXTENSION)} GROUP BY repo_id
    UNION ALL SELECT 'security_findings', repo_id, count(*) FROM secrets GROUP BY repo_id
    UNION ALL SELECT 'quality_findings', repo_id, count(*) FROM quality GROUP BY repo_id
    UNION ALL SELECT 'diagnosis_counts', repo_id, count(*) FROM (SELECT repo_id FROM quality UNION ALL SELECT repo_id FROM secrets) GROUP BY repo_id
    UNION ALL SELECT 'actions', repo_id, greatest(1, x::INT + l::INT + u::INT) FROM t"""
SQL["commit_snapshot"] = SQL["commit_health"]
