"""Rules of redaction, links and states on small rows made for their edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.plans import registry
from tidewater.functions import text
from tidewater.operators import linking
from tidewater.operators.ranking import first_few, sole_least


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def one(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_redaction(spark):
    rows = texts(spark, ["password = 'a b", "monkey: `x`, token=", "Key:v}", None, "", "tokenkey=1"])
    assert one(rows, text.redact_assignments(F.col("v"))) == ["password = 'a b", "monkey: [REDACTED], token=", "Key: [REDACTED]}", None, "", "tokenkey: [REDACTED]"]
    rows = texts(spark, ["jdbc:sap://u:p@h:1/x", "https://u@h/p?token=1", "https://u@h/p", "https://:@h/p", "mail a.b@c.example, ok", "my api key : 7", "donkey=1", "basic abc;d", None])
    found = one(rows, text.redact_secrets(F.col("v")))
    assert found == ["jdbc:sap://redacted:redacted@h:1/x", "[REDACTED]", "https://redacted:redacted@h/p", "https://:@h/p", "mail [REDACTED], ok", "[REDACTED]", "donkey=1", "[REDACTED];d", None]


def test_redact_json(spark):
    deep = {"a": [{"authToken": {"x": 1}}, "secret: q", 1.5, None], "é": "plain"}
    rows = texts(spark, [json.dumps(deep), "no json", None, '"key=1"', "[" * 100_000])
    found = one(rows, text.redact_json(F.col("v")))
    assert json.loads(found[0]) == {"a": [{"authToken": "[REDACTED]"}, "secret: [REDACTED]", 1.5, None], "é": "plain"}
    assert found[1:] == [None, None, '"key: [REDACTED]"', None]


def test_byte_prefix(spark):
    values = ["aé€😀", "", None, "😀😀", "abc", "é" * 50_000]
    rows = texts(spark, values)
    for most in (1, 2, 3, 4, 5, 6, 7, 9, 10, 0):
        cut, longer = text.byte_prefix(F.col("v"), most)
        for v, (c, more) in zip(values, rows.orderBy("i").select(cut, longer).collect()):
            if v is None:
                assert c is None
            elif most <= 0:
                assert (c, more) == (v, False)
            else:
                assert (c, more) == (v.encode()[:most].decode(errors="ignore"), len(v.encode()) > most)


def test_substituted(spark):
    rows = texts(spark, ["a/${x}/${ y }/${x}", "plain", "${z}${x}", "", None])
    values = F.create_map(F.lit("x"), F.lit("${y}"), F.lit("y"), F.lit("2"))
    found = rows.select("i", *text.substituted(F.col("v"), values)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found[:4]] == [
        ("a/${y}/2/${y}", ["x", "y"], ["x", "y"], [], True), ("plain", [], [], [], False), ("${z}${y}", ["z", "x"], ["x"], ["z"], True), ("", [], [], [], False)]
    assert found[4].effective is None


def test_dependency_edges(spark):
    repos = spark.createDataFrame([(1, "A-Lib", "@o/a"), (2, "a_lib", "@o/b"), (3, "main", "@o/b"), (4, "x", None), (5, "b", "b")], "id int, name string, package_name string")
    asked = spark.createDataFrame([(3, "@o/a"), (1, "@o/b"), (2, "@o/b"), (3, "@z/a.lib"), (2, "a-lib"), (4, "none"), (4, None), (5, "b"), (3, "@o/a")], "id int, dependency string")
    found = {(r.id, r.dependency): (r.match, r.candidates, r.status, r.to_id, r.confidence) for r in linking.dependency_edges(repos, asked).collect()}
    assert found == {
        (3, "@o/a"): ("exact_package_name", 1, "resolved", 1, 1.0), (1, "@o/b"): ("exact_package_name", 2, "ambiguous", None, 0.5),
        (2, "@o/b"): ("exact_package_name", 1, "resolved", 3, 1.0), (3, "@z/a.lib"): ("normalized_directory", 2, "ambiguous", None, 0.5),
        (2, "a-lib"): ("normalized_directory", 1, "resolved", 1, 1.0)}
    assert linking.dependency_edges(repos.limit(0), asked).count() == linking.dependency_edges(repos, asked.limit(0)).count() == 0


def test_implementation_decisions(spark):
    names = [*(c for c in linking.SIGNS if c != "helper_owned"), "db_model", "has_local_services", "has_local_registration", "same_repo_registration", "method_matches", "method_contradicted"]

    def row(op, *on):
        return (op, *(c in on or None for c in names))

    rows = [
        row("one", "model_is_handler", "method_matches"), row("one", "handler_needs_model", "method_matches"), row("one", "model_is_application", "method_matches", "method_contradicted"),
        row("two", "local_service_path", "method_matches"), row("two", "local_service_path", "method_matches", "has_local_services"),
        row("helper", "method_matches", "same_repo_registration", "imports_handler"), row("none", "method_matches"), row(None, "has_local_services", "handler_needs_model", "method_matches"),
    ]
    scored = linking.implementation_scores(spark.createDataFrame(rows, "op string, " + ", ".join(f"{c} boolean" for c in names)))
    found = {r.op: (r.candidates, r.accepted, r.top_score, r.winners, r.status) for r in linking.implementation_decisions(scored, "op").collect()}
    assert found == {"one": (3, 2, 100, 1, "resolved"), "two": (2, 2, 80, 2, "ambiguous"), "helper": (1, 1, 70, 1, "resolved"), "none": (1, 0, 0, 0, "unresolved"), None: (1, 0, 0, 0, "unresolved")}


def test_path_patterns(spark):
    rows = [("a", "/x/1/end"), ("a", "/x/22/end"), ("a", None), ("b", "/q"), ("b", "/q"), ("c", None), ("d", ""), ("e", "ab"), ("e", "abab"), (None, "z"), (None, "y")]
    found = {r.g: r.pattern for r in linking.path_patterns(spark.createDataFrame(rows, "g string, path string"), "g").collect()}
    assert found == {"a": "/x/*/end", "b": "/q", "c": "", "d": "", "e": "ab*", None: "*"}


def test_work_tree_states(spark):
    lines = ["# branch.head  main ", "# branch.upstream o/m", "# branch.ab +2 -1", "1 .M N", "# branch.head last", "? u", "2 ?? x"]
    rows = [("a", i, line) for i, line in enumerate(lines)] + [("b", 0, "1 A. f"), ("c", 0, None), ("d", 0, "# branch.upstream x"), ("d", 1, "1 ")]
    found = {r[0]: tuple(r)[1:] for r in linking.work_tree_states(spark.createDataFrame(rows, "g string, pos int, line string"), "g").collect()}
    assert found == {
        "a": ("last", "diverged", False, True, True, 2, 1), "b": ("HEAD", "no_remote", True, False, False, 0, 0),
        "c": ("HEAD", "no_remote", False, False, False, 0, 0), "d": ("HEAD", "in_sync", False, False, False, 0, 0)}


def test_first_few_and_sole_least(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("a", 2, 2), ("a", 1, 5), ("b", None, None), (None, 7, 1), (None, 6, 1)], "g string, x int, y int")
    assert {tuple(r) for r in first_few(rows, "g", "x", 3, "n", "few").collect()} == {("a", 4, "1,1,2"), ("b", 1, ""), (None, 2, "6,7")}
    assert {tuple(r) for r in sole_least(rows, "g", "y", "x", "who", "many").collect()} == {("a", 3, False), (None, None, True)}
    assert first_few(rows.limit(0), "g", "x", 3, "n", "few").count() == 0


def test_long_hostile_texts(spark):
    """Patterns over whole texts neither recurse nor multiply with the text's length."""
    long = ["a@" + "b." * 100_000 + "-", "key:!" * 20_000, "Bearer " * 20_000, "eyJ" + "a." * 50_000, "x://" + "u:" * 20_000 + "@h", "-----BEGIN " * 5_000, "a@b.c_ a@b.c.d_ x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, t string")
    found = rows.select("i", text.redact_secrets(F.col("t")).alias("s"), text.redact_assignments(F.col("t")).alias("a"), text.redact_mail(F.col("t")).alias("m")).collect()
    assert len(found) == len(long)
    by = {r["i"]: r["s"] for r in found}
    assert by[0] == "[REDACTED].-" and by[6] == "a@b.c_ [REDACTED].d_ x"


def test_hash_color(spark):
    names = ["", "a", "checkout-service-eu10", "ÄÖÜ", "😀 app", "ARGENTINA", "x" * 300]

    def want(name):
        h = 0
        raw = name.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >> 31 else h) % 10

    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.hash_color(F.col("n")).alias("c"))
    assert {r["n"]: r["c"] for r in rows.collect()} == {n: want(n) for n in names}


def test_names_are_registered_once():
    with pytest.raises(ValueError, match="two queries"):
        registry.query("f_level")(lambda spark, sf_dir: None)
