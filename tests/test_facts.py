import gc
import weakref

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from corpusvitals import rules
from corpusvitals.functions import text as tx
from corpusvitals.operators import facts as fct, markers, scripts, secrets


def test_both_languages_are_read_by_one_worker(files):
    plan = fct.code_facts(files({"a.py": "x = 1", "b.js": "y"}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_facts_of_a_slice_are_python_objects_at_a_time():
    class Fact(dict):
        __hash__ = object.__hash__

    live, most = weakref.WeakSet(), 0

    def facts(text):
        nonlocal most
        fact = Fact(a=text)
        live.add(fact)
        most = max(most, len(live))
        return fact

    gc.collect()
    kind = T.StructType([T.StructField("a", T.StringType())])
    texts = [f"t{i}" for i in range(1000)]
    assert [r["a"] for r in scripts.row_by_row(facts, pa.array(texts), kind).to_pylist()] == texts
    assert most <= 2 * scripts.SLICE_ROWS
    assert len(scripts.row_by_row(facts, pa.array([], pa.string()), kind)) == 0


def test_uncommon_space_is_the_same_in_one_look(spark):
    signs = [(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + [("x",), ("",)]
    c = F.col("c")
    differing = spark.createDataFrame(signs, "c string").where(tx.uncommon(c) != c.rlike(tx.UNCOMMON_SPACE))
    assert differing.count() == 0


def test_lines_counted_from_their_cut(spark):
    texts = [(t,) for t in ("", "\n", "a", "a\n", "a\nb", "a\n\n", "a\r\nb")] + [(None,)]
    c = F.col("c")
    rows = spark.createDataFrame(texts, "c string").select(
        tx.read_line_count(c).alias("n"), tx.read_line_count_of(tx.plain_lines(c)).alias("m")
    ).collect()
    assert [r.m for r in rows] == [r.n for r in rows] == [0, 1, 1, 1, 2, 2, 2, None]


def test_initials_of_secrets_lose_no_match(spark):
    words = [w for w in ("api_key", "apikey", "secret-key", "ſecret_key", "password", "paſſword", "passwd", "pwd", "token", "auth_token", "toKen", "mytoken", "other")]
    texts = [(lead + form(w) + " = 'v1'",) for w in words for form in (str, str.upper, str.title) for lead in ("", "x ", "x", "(", "é", "\n")]
    df = spark.createDataFrame(texts, "c string")
    for kind, keywords in rules.SECRET_KEYWORDS.items():
        plainly = F.regexp_extract_all("c", F.lit(rf"(?iU)\b({keywords})\b{secrets._VALUE}"), F.lit(0))
        quickly = F.regexp_extract_all("c", F.lit(secrets.PATTERNS[kind]), F.lit(0))
        assert df.where(plainly != quickly).count() == 0
        assert df.where(F.size(quickly) > 0).count() > 0


def test_names_in_use_are_whole_identifiers(files):
    text = (
        "import a, { b, c$, d, e as f, g } from 'm'\n"
        "x.ab; b1; $b; c$d; /* c$ */ 'd' // f\n"
        "g\n"
    )
    rows = scripts.unused_js_imports(files({"m.js": text, "n.js": "no statement: import", "o.js": "import a from 'b'"})).collect()
    found = {(r.file, r.line, r.details.split()[0]) for r in rows}
    assert found == {("m.js", 1, n) for n in ("a", "b", "c$", "d", "f")} | {("o.js", 1, "a")}


def test_markers_only_in_lines_that_have_one(files):
    text = "todos\n# ToDo todo\nx\nFIXME: Xxx\n"
    rows = markers.work_markers(files({"a.py": text, "b.py": "autodoc todos"})).collect()
    assert sorted((r.file, r.line, r.type) for r in rows) == [
        ("a.py", 2, "TODO Marker"), ("a.py", 2, "TODO Marker"), ("a.py", 4, "FIXME Marker"), ("a.py", 4, "XXX Marker"),
    ]
