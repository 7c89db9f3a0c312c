"""Python sources: facts from the syntax tree, decisions in Spark."""

import ast
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .. import rules
from ..functions import paths
from .scripts import FUNCTION, complexity_findings, row_by_row

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_ONE_BRANCH = {
    ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler,
    ast.With, ast.AsyncWith, ast.Assert, ast.comprehension,
}
# leaves that carry no fact
_IGNORED = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop, ast.Constant)
# fields that hold such leaves, or no nodes at all
_BARE_FIELDS = {
    "ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "conversion", "level", "module", "simple", "is_async",
}
# the fields to look into by kind of node; other kinds, and what is no node, are missing
_FIELDS = {
    kind: tuple(f for f in kind._fields if f not in _BARE_FIELDS)
    for kind in vars(ast).values()
    if isinstance(kind, type) and issubclass(kind, ast.AST) and not issubclass(kind, (*_IGNORED, ast.Name))
}


def _bound_names(node):
    """Names an import statement binds; compiler directives bind none."""
    if isinstance(node, ast.Import):
        return [a.asname or a.name.partition(".")[0] for a in node.names]
    if isinstance(node, ast.ImportFrom) and node.module != "__future__":
        return [a.asname or a.name for a in node.names if a.name != "*"]
    return []


def _module_facts(text: str):
    """Functions, imports, referenced names and whether the text parses.

    The parser reports nesting beyond its stack as a lack of memory, so that
    is a property of the text too and has a status of its own.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return {"parse_status": "invalid"}
    except (RecursionError, MemoryError):
        return {"parse_status": "too deep"}
    functions, imports, names = [], [], set()
    # (node, functions around it): a branch counts for all of them
    todo = [(tree, ())]
    while todo:
        node, around = todo.pop()
        kind = type(node)
        weight = 0
        if kind in _ONE_BRANCH:
            weight = 1
        elif kind is ast.BoolOp:
            weight = len(node.values) - 1
        elif kind in _FUNCTIONS:
            functions.append([node.name, node.lineno, node.end_lineno or node.lineno, 1])
            around = around + (functions[-1],)
        elif kind in (ast.Import, ast.ImportFrom):
            imports.extend((name, node.lineno) for name in _bound_names(node))
            continue
        if weight:
            for owner in around:
                owner[3] += weight
        for field in _FIELDS[kind]:
            child = getattr(node, field, None)
            for item in child if type(child) is list else (child,):
                kind = type(item)
                if kind is ast.Name:
                    names.add(item.id)
                elif kind in _FIELDS:
                    todo.append((item, around))
    return {
        "functions": [tuple(f) for f in functions], "imports": imports, "names": list(names),
        "parse_status": "parsed",
    }


IMPORT = T.StructType([
    T.StructField("identifier", T.StringType()),
    T.StructField("line", T.IntegerType()),
])
FACTS = T.StructType([
    T.StructField("functions", T.ArrayType(FUNCTION)),
    T.StructField("imports", T.ArrayType(IMPORT)),
    T.StructField("names", T.ArrayType(T.StringType())),
    T.StructField("parse_status", T.StringType()),
])


@F.arrow_udf(FACTS)
def module_facts(texts: pa.Array) -> pa.Array:
    return row_by_row(lambda t: _module_facts(t) if t else {}, texts, FACTS)


# without Arrow, whose batches hold as many texts as the session says: these hold a hundred
@F.udf(FACTS, useArrow=False)
def module_facts_alone(text: str) -> dict:
    return _module_facts(text) if text else {}


# keeps filters inferred from later explodes from running the parser again
module_facts = module_facts.asNondeterministic()
module_facts_alone = module_facts_alone.asNondeterministic()


def python_files(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.where(
        (paths.extension(path) == ".py") & (paths.quality_category(path) != "generated")
    )


def python_facts(files: DataFrame) -> DataFrame:
    """One row per file; every text is parsed once, for all rules below."""
    return python_files(files).select("repo_id", "path", module_facts_alone("content").alias("m")).select(
        "repo_id", "path", "m.*"
    )


def python_functions(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "path", F.explode("functions").alias("f")).select(
        "repo_id", "path", "f.*"
    )


def python_imports(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "path", F.explode("imports").alias("i")).select(
        "repo_id", "path", "i.*"
    )


def python_complexity(functions: DataFrame) -> DataFrame:
    details = F.format_string(
        rules.DETAILS["python_complexity"],
        "complexity", F.lit(rules.COMPLEXITY_THRESHOLD),
    )
    return complexity_findings(functions, "Python", 95, details)


def long_functions(functions: DataFrame) -> DataFrame:
    limit = rules.LONG_FUNCTION_LINES
    lines = F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1)
    severity = F.when(F.col("lines") >= 2 * limit, "HIGH").otherwise("MEDIUM")
    why, advice = rules.EXPLANATIONS["Long Function"]
    return functions.withColumn("lines", lines).where(F.col("lines") > limit).select(
        "repo_id",
        F.lit("quality").alias("domain"),
        F.lit("Long Function").alias("type"),
        F.col("path").alias("file"),
        "line",
        F.col("name").alias("function"),
        "lines",
        F.lit(limit).alias("threshold"),
        severity.alias("severity"),
        severity.alias("priority"),
        F.lit(100).alias("confidence"),
        F.format_string(
            rules.DETAILS["long_function"], "lines", F.lit(limit)
        ).alias("details"),
        F.lit(why).alias("why"),
        F.lit(advice).alias("recommendation"),
    )


def unused_python_imports(facts: DataFrame) -> DataFrame:
    """Imports whose name is never referenced, package initialisers aside.

    Imports and names of a file sit in one row, so no join is needed.
    """
    unused = F.array_except("imports.identifier", "names")
    why, advice = rules.EXPLANATIONS["Unused Python Import"]
    return (
        facts.where(paths.base_name(F.col("path")) != "__init__.py")
        .select("repo_id", "path", unused.alias("unused"), F.explode("imports").alias("i"))
        .where(F.array_contains("unused", F.col("i.identifier")))
        .select(
            "repo_id",
            F.lit("quality").alias("domain"),
            F.lit("Unused Python Import").alias("type"),
            F.col("path").alias("file"),
            F.col("i.line").alias("line"),
            F.lit("LOW").alias("severity"),
            F.lit("LOW").alias("priority"),
            F.lit(95).alias("confidence"),
            F.format_string(rules.DETAILS["unused_import"], F.col("i.identifier")).alias("details"),
            F.lit(why).alias("why"),
            F.lit(advice).alias("recommendation"),
        )
    )
