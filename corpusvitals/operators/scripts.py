"""JavaScript and TypeScript: imports, identifiers, branches, functions."""

import bisect
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import rules
from ..functions import paths, text as tx

IMPORT = (
    # only from the first of several empty lines, which are then read once; the
    # start of a line and its first sign are asked for first, so that nothing is looked at elsewhere
    r"(?mdU)^(?=\s|import)(?<!\n[ \t\r]{0,100}\n)\s*+import\s+"
    r"(?:([A-Za-z_$][\w$]*)(?:\s*,\s*)?)?"
    r"(?:\{([^}]+)\})?"
    r"(?:\s+from\s+)?"
    r"[\"'][^\"']+[\"']\s*;?"
)
# runs are possessive: same texts match, and long strings cannot exhaust the stack;
# one look at the first sign spares most places the five forms
COMMENT_OR_STRING = (
    r"(?s)(?=[/\"'`])(?://[^\n]*|/\*.*?\*/"
    r"|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
    r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r"|`[^`\\]*+(?:\\.[^`\\]*+)*+`)"
)
IDENTIFIER = r"(?U)(?<![\w$])[A-Za-z_$][\w$]*"
MARKUP = r"<[A-Za-z][^>]*>"


def script_files(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.where(
        paths.extension(path).isin(rules.JS_EXTENSIONS)
        & (paths.quality_category(path) != "generated")
    )


def strip_comments_and_strings(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT_OR_STRING, " ")


def _imported_names(statement: Column) -> Column:
    """Identifiers one import statement binds, default name first."""
    default = F.regexp_extract(statement, IMPORT, 1)
    items = F.transform(
        F.split(F.regexp_extract(statement, IMPORT, 2), ","),
        lambda item: F.regexp_replace(
            tx.strip(F.regexp_replace(tx.strip(item), r"(?sU)^.*?\s+as\s+", "")),
            r"(?U)^\s*type\s+",
            "",
        ),
    )
    valid = F.filter(items, lambda name: name.rlike(r"(?U)^[A-Za-z_$][\w$]*\z"))
    return F.concat(F.when(default != "", F.array(default)).otherwise(F.array().cast("array<string>")), valid)


def import_pieces(gaps: Column, hits: Column) -> Column:
    """Gaps and import statements as small structs, for line numbering."""
    pairs = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lit("import").alias("label"),
            i.alias("i"),
            tx.newlines(p["gap"]).alias("gap_nl"),
            tx.newlines(F.coalesce(p["hit"], F.lit(""))).alias("hit_nl"),
            F.when(p["hit"].isNotNull(), _imported_names(p["hit"])).alias("names"),
        ),
    )


def _located_imports(rows: DataFrame, carry: list) -> DataFrame:
    """Identifiers with lines from ``statements`` columns."""
    keys = ["repo_id", "path"]
    placed = rows.select(*keys, *carry, F.inline("statements"))
    return tx.with_start_line(placed, keys).select(*keys, *carry, "line", F.explode("names").alias("identifier"))


def js_imports(files: DataFrame) -> DataFrame:
    """(repo_id, path, identifier, line)"""
    rows = _with_import_cuts(script_files(files), F.col("content")).where(F.size("import_hits") > 0)
    rows = rows.select("repo_id", "path", tx.once(statements=import_pieces(F.col("import_gaps"), F.col("import_hits"))))
    return _located_imports(rows, []).select("repo_id", "path", "identifier", "line")


def js_identifier_counts(files: DataFrame) -> DataFrame:
    """(repo_id, path, identifier, n) outside comments and strings."""
    names = F.regexp_extract_all(
        strip_comments_and_strings(F.col("content")), F.lit(IDENTIFIER), F.lit(0)
    )
    return (
        script_files(files)
        .select("repo_id", "path", F.explode(names).alias("identifier"))
        .groupBy("repo_id", "path", "identifier")
        .agg(F.count("*").alias("n"))
    )


def _with_import_cuts(rows: DataFrame, content: Column) -> DataFrame:
    """Add ``import_hits``, the import statements, and ``import_gaps``, what lies between them; no gaps without statements."""
    hits = F.when(content.contains("import"), F.regexp_extract_all(content, F.lit(IMPORT), F.lit(0)))
    rows = rows.select("*", tx.once(import_hits=hits))
    return rows.select("*", tx.once(import_gaps=F.when(F.size("import_hits") > 0, F.split(content, IMPORT, -1))))


def _mentioned(body: Column, name: Column) -> Column:
    """Whether an identifier of the body is this name: the pattern runs where the signs are found at all."""
    whole = F.concat(F.lit(r"(?U)(?<![\w$])\Q"), name, F.lit(r"\E(?![\w$])"))
    return body.contains(name) & F.regexp_like(body, whole)


def with_import_facts(rows: DataFrame, content: Column) -> DataFrame:
    """Add ``unused``, imported names the rest of the module never mentions,
    NULL without imports, and ``statements``, only where there are any;
    ``content`` is NULL for other languages.

    Decided inside the row that holds the text, so names are not shuffled.
    Import statements are taken out before strings are, otherwise their
    quoted module would hide them and every import would count as its own use.
    """
    columns = rows.columns
    bound = F.array_distinct(F.flatten(F.transform("import_hits", _imported_names)))
    cut = _with_import_cuts(rows, content).select(
        "*",
        tx.once(
            import_body=strip_comments_and_strings(F.array_join("import_gaps", " ")),
            import_names=F.when(F.col("import_gaps").isNotNull(), bound),
        ),
    )
    unused = F.filter("import_names", lambda name: ~_mentioned(F.col("import_body"), name))
    found = cut.select("*", tx.once(unused=unused))
    # markup uses React without naming it
    markup = F.array_contains("unused", "React") & content.rlike(MARKUP)
    kept = F.when(markup, F.array_remove("unused", "React")).otherwise(F.col("unused"))
    found = found.select(*columns, "import_gaps", "import_hits", tx.once(unused=kept))
    statements = F.when(F.size("unused") > 0, import_pieces(F.col("import_gaps"), F.col("import_hits")))
    return found.select(*columns, "unused", statements.alias("statements"))


def unused_js_imports(files: DataFrame) -> DataFrame:
    rows = with_import_facts(script_files(files).select("repo_id", "path", "content"), F.col("content"))
    return unused_import_findings(rows.select("repo_id", "path", tx.once(unused=F.col("unused"), statements=F.col("statements"))))


def unused_import_findings(facts: DataFrame) -> DataFrame:
    """Findings from ``unused`` and ``statements`` columns."""
    why, advice = rules.EXPLANATIONS["Unused JavaScript Import"]
    return (
        _located_imports(facts, ["unused"])
        .where(F.array_contains("unused", F.col("identifier")))
        .select(
            "repo_id",
            F.lit("quality").alias("domain"),
            F.lit("Unused JavaScript Import").alias("type"),
            F.col("path").alias("file"),
            "line",
            F.lit("LOW").alias("severity"),
            F.lit("LOW").alias("priority"),
            F.lit(90).alias("confidence"),
            F.format_string(rules.DETAILS["unused_import"], "identifier").alias("details"),
            F.lit(why).alias("why"),
            F.lit(advice).alias("recommendation"),
        )
    )


def js_branch_counts(files: DataFrame) -> DataFrame:
    """Branches of each kind per file, comments and strings aside."""
    bare = script_files(files).select(
        "repo_id", "path", strip_comments_and_strings(F.col("content")).alias("bare")
    )
    return bare.select(
        "repo_id", "path",
        *[
            F.regexp_count("bare", F.lit("(?U)" + pattern)).cast("long").alias(f"n_{kind}")
            for kind, pattern in rules.JS_BRANCHES.items()
        ],
    )


# --- function facts: brace matching needs a stack, so it runs per file -------
#
# A head is read backwards from the brace that it ends with, so every character
# is looked at a fixed number of times, whatever the text.

_SIGNS = re.compile(r"[(){}]")
_QUOTED = {q: re.compile(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}", re.S) for q in "\"'`"}
_NOISE_START = re.compile(r"//|/\*|[\"'`]")
_NAME_START = re.compile(r"[A-Za-z_$]")
_NOT_METHOD = re.compile(rf"(?:{'|'.join(rules.JS_NOT_METHODS)})\b")
_BRANCH = [re.compile(p) for p in rules.JS_BRANCHES.values()]


def _noise(text: str) -> list:
    """Spans of comments and strings. What is never closed is no noise, and is looked for once only."""
    spans, at, unclosed = [], 0, set()
    while opened := _NOISE_START.search(text, at):
        start, sign = opened.span()[0], opened.group()
        at = start + 1
        if sign == "//":
            end = text.find("\n", start)
            at = len(text) if end < 0 else end
        elif sign in unclosed:
            continue
        elif sign == "/*":
            end = text.find("*/", start + 2)
            at = end + 2 if end >= 0 else at
        else:
            quoted = _QUOTED[sign].match(text, start)
            end = at = quoted.end() if quoted else at
            end = end if quoted else -1
        if sign != "//" and end < 0:
            unclosed.add(sign)
        else:
            spans.append((start, at))
    return spans


def _blanked(text: str, spans: list) -> str:
    parts, at = [], 0
    for start, end in spans:
        parts += text[at:start], " " * (end - start)
        at = end
    return "".join(parts) + text[at:]


class _Scan:
    """Brackets of a text and the function heads that end at its braces."""

    def __init__(self, text: str):
        self.text, self.ends = text, {}
        self._closing = {}  # ")" -> the "(" after the ")" before it
        open_at, parens = [], []
        for sign in _SIGNS.finditer(text):
            char, at = sign.group(), sign.start()
            if char == "{":
                open_at.append(at)
            elif char == "}":
                if open_at:
                    self.ends[open_at.pop()] = at + 1
            elif char == "(":
                parens.append(at)
            else:
                self._closing[at] = parens
                parens = []
        self.braces = sorted(self.ends)

    def _before(self, at: int) -> int:
        """Where the white space that ends at ``at`` begins."""
        text = self.text
        while at and text[at - 1].isspace():
            at -= 1
        return at

    def _word(self, at: int) -> int:
        """Where the word that ends at ``at`` begins."""
        text = self.text
        while at and (text[at - 1] == "$" or text[at - 1] == "_" or text[at - 1].isalnum()):
            at -= 1
        return at

    def _bare(self, at: int, words: tuple) -> int | None:
        """Where one of ``words`` begins that ends at ``at``, with a word border before it."""
        for word in words:
            start = at - len(word)
            if start >= 0 and self.text.startswith(word, start):
                before = self.text[start - 1] if start else " "
                if not (before == "_" or before.isalnum()):
                    return start
        return None

    def _name(self, at: int) -> tuple | None:
        start = self._word(at)
        return (start, at) if start < at and _NAME_START.match(self.text, start) else None

    def _declared(self, paren: int) -> tuple | None:
        """``function name`` before a parenthesis: (start, name span)."""
        name = self._name(self._before(paren))
        if name:
            gap = self._before(name[0])
            start = self._bare(gap, ("function",)) if gap < name[0] else None
            if start is not None:
                return start, name
        return None

    def _line_start(self, at: int) -> int | None:
        """First line start in the white space that ends at ``at``."""
        gap = self._before(at)
        if not gap:
            return 0
        found = self.text.find("\n", gap, at)
        return None if found < 0 else found + 1

    def _method(self, paren: int) -> tuple | None:
        name = self._name(self._before(paren))
        if not name or _NOT_METHOD.match(self.text, name[0]):
            return None
        gap = self._before(name[0])
        if gap < name[0] and self._word(gap) == gap - 5 and self.text.startswith("async", gap - 5):
            start = self._line_start(gap - 5)
            if start is not None:
                return start, name
        start = self._line_start(name[0])
        return None if start is None else (start, name)

    def _assigned(self, at: int) -> tuple | None:
        """``const name =`` and perhaps ``async`` before parameters at ``at``."""
        text = self.text
        at = self._before(at)
        if text.endswith("async", 0, at):
            rest = self._before(at - 5)
            at = rest if rest and text[rest - 1] == "=" else at
        if not at or text[at - 1] != "=":
            return None
        name = self._name(self._before(at - 1))
        if name:
            gap = self._before(name[0])
            start = self._bare(gap, ("const", "let", "var")) if gap < name[0] else None
            if start is not None:
                return start, name
        return None

    def _arrow(self, brace: int) -> int | None:
        """Where the parameters of ``=> {`` end."""
        at = self._before(brace)
        return self._before(at - 2) if self.text.endswith("=>", 0, at) else None

    def callbacks(self) -> list:
        """Braces of all arrow functions."""
        found = []
        for brace in self.braces:
            at = self._arrow(brace)
            if not at:
                continue
            if self.text[at - 1] == ")":
                if self._closing.get(at - 1):
                    found.append(brace)
            elif _NAME_START.search(self.text, self._word(at), at):
                found.append(brace)
        return found

    def heads(self) -> list:
        """(name, line, start, brace): declared, then assigned, then methods;
        the first to claim a (name, line) wins. The line is that of the name."""
        shapes = [], [], []
        opened = [m.start() for m in re.finditer(r"\{", self.text)]
        for brace in opened:
            at = self._before(brace)
            if at and self.text[at - 1] == ")":
                for kind, read in ((0, self._declared), (2, self._method)):
                    hits = map(read, self._closing.get(at - 1, ()))
                    if hit := next(filter(None, hits), None):
                        shapes[kind].append((*hit, brace))
            elif at := self._arrow(brace):
                if self.text[at - 1] == ")":
                    hits = map(self._assigned, self._closing.get(at - 1, ()))
                else:
                    word = self._name(at)
                    hits = [self._assigned(word[0])] if word else []
                if hit := next(filter(None, hits), None):
                    shapes[1].append((*hit, brace))
        breaks = [m.start() for m in re.finditer("\n", self.text)]
        found, claimed = [], set()
        for start, name, brace in itertools.chain(*shapes):
            key = self.text[name[0] : name[1]], bisect.bisect_left(breaks, name[0]) + 1
            if key not in claimed:
                claimed.add(key)
                if brace in self.ends:
                    found.append((*key, start, brace))
        return found


def _own_branches(text: str, first: int = 0, last: int | None = None) -> tuple:
    """Branches by the brace of the innermost function around them, and all
    their places from ``first`` to ``last``."""
    scan = _Scan(text)
    inner = sorted({*(h[3] for h in scan.heads()), *scan.callbacks()})
    last = len(text) if last is None else last
    places = sorted(m.start() for branch in _BRANCH for m in branch.finditer(text, first, last))
    own, around, i = dict.fromkeys(inner, 0), [], 0
    for place in places:
        while i < len(inner) and inner[i] <= place:
            while around and scan.ends[around[-1]] <= inner[i]:
                around.pop()
            around.append(inner[i])
            i += 1
        while around and scan.ends[around[-1]] <= place:
            around.pop()
        if around:
            own[around[-1]] += 1
    return own, places


def _function_facts(text: str) -> list:
    """(name, line, end line, complexity) of each function.

    Complexity is 1 and the branches in the function outside functions nested
    in it, comments and strings aside. A function that starts or ends inside
    a comment or string is counted within its own text, as if it stood alone.
    """
    scan = _Scan(text)
    heads = scan.heads()
    noise = _noise(text)
    noise_starts = [s for s, _ in noise]
    own, places = {}, []
    if heads:  # what lies outside all functions counts for none
        first, last = min(h[2] for h in heads), max(scan.ends[h[3]] for h in heads)
        own, places = _own_branches(_blanked(text, noise), first, last)
    breaks = [m.start() for m in re.finditer("\n", text)]
    facts, island = [], (-1, -1, {}, [])
    for at, (name, line, start, brace) in sorted(enumerate(heads), key=lambda h: h[1][2]):
        end = scan.ends[brace]
        lines = bisect.bisect_left(breaks, end) - bisect.bisect_left(breaks, start)
        shift, counts, branches = 0, own, places
        spans = (bisect.bisect_right(noise_starts, p) - 1 for p in (start, end - 1))
        if any(i >= 0 and p < noise[i][1] for i, p in zip(spans, (start, end - 1))):
            if not (island[0] <= start and end <= island[1]):
                body = text[start:end]
                island = (start, end, *_own_branches(_blanked(body, _noise(body))))
            shift, counts, branches = island[0], island[2], island[3]
        in_head = bisect.bisect_left(branches, brace - shift) - bisect.bisect_left(branches, start - shift)
        facts.append((at, (name, line, line + lines, 1 + in_head + counts.get(brace - shift, 0))))
    return [fact for _, fact in sorted(facts)]


FUNCTION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("complexity", T.IntegerType()),
])


#: Texts whose facts are Python objects at the same time, however large the session's batches are.
SLICE_ROWS = 64


def row_by_row(facts, texts: pa.Array, kind: T.DataType) -> pa.Array:
    """Facts of each text as Arrow has them, without a detour by pandas; one
    text at a time is a Python object, and so are the facts of one slice."""
    arrow = to_arrow_type(kind)
    slices = [texts.slice(start, SLICE_ROWS) for start in range(0, len(texts), SLICE_ROWS)] or [texts]
    return pa.concat_arrays([pa.array([facts(t.as_py()) for t in part], arrow) for part in slices])


@F.arrow_udf(T.ArrayType(FUNCTION))
def function_facts(texts: pa.Array) -> pa.Array:
    return row_by_row(lambda t: _function_facts(t) if t else [], texts, T.ArrayType(FUNCTION))


# without Arrow, whose batches hold as many texts as the session says: these hold a hundred
@F.udf(T.ArrayType(FUNCTION), useArrow=False)
def function_facts_alone(text: str) -> list:
    return _function_facts(text) if text else []


def js_functions(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, line, end_line, complexity)"""
    return (
        script_files(files)
        .select("repo_id", "path", F.explode(function_facts_alone("content")).alias("f"))
        .select("repo_id", "path", "f.*")
    )


def complexity_findings(functions: DataFrame, language: str, confidence: int, details: Column) -> DataFrame:
    kind = f"High {language} Complexity"
    severity = F.when(F.col("complexity") >= rules.COMPLEXITY_HIGH, "HIGH").otherwise("MEDIUM")
    why, advice = rules.EXPLANATIONS[kind]
    return functions.where(F.col("complexity") > rules.COMPLEXITY_THRESHOLD).select(
        "repo_id",
        F.lit("quality").alias("domain"),
        F.lit(kind).alias("type"),
        F.col("path").alias("file"),
        "line",
        F.col("name").alias("function"),
        "complexity",
        F.lit(rules.COMPLEXITY_THRESHOLD).alias("threshold"),
        severity.alias("severity"),
        severity.alias("priority"),
        F.lit(confidence).alias("confidence"),
        details.alias("details"),
        F.lit(why).alias("why"),
        F.lit(advice).alias("recommendation"),
    )


def js_complexity(functions: DataFrame) -> DataFrame:
    details = F.format_string(
        rules.DETAILS["script_complexity"],
        "name", "complexity", F.lit(rules.COMPLEXITY_THRESHOLD),
    )
    return complexity_findings(functions, "JavaScript", 80, details)
