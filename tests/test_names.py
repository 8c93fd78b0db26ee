"""Dotted names and extended services against plain loops."""

import random

from pyspark.sql import functions as F

from tidewater.operators import extensions, names


def _resolve(defs, target, package):
    if target is None:
        return None, "missing", None
    if target in defs:
        return target, "resolved", "exact"
    fits = [n for n in defs if n.endswith("." + target)]
    own = [n for n in fits if defs[n][0] == package and package is not None]
    if len(fits) == 1:
        return fits[0], "resolved", "suffix"
    if len(fits) > 1 and len(own) == 1:
        return own[0], "resolved", "package"
    return None, "ambiguous" if fits else "missing", None


def _facts():
    rng = random.Random(5)
    name = lambda: ".".join(rng.choice(["a", "b", "Item", "Order", "", "x"]) for _ in range(rng.randrange(1, 5)))
    defs = {name(): (rng.choice([None, "p", "q", "r"]), rng.choice(["entity", "type"])) for _ in range(90)}
    refs = [(i, rng.choice([name(), name(), None, "cds.String"]), rng.choice([None, "p", "q"])) for i in range(400)]
    return defs, refs + refs[:20], rng


def _defs(spark, defs):
    rows = [(n, p, k) for n, (p, k) in defs.items()]
    return spark.createDataFrame(rows + rows[:5] + [(None, "p", "type")], "name string, package string, kind string")


def test_resolve(spark):
    defs, refs, _ = _facts()
    d = _defs(spark, defs)
    r = spark.createDataFrame(refs, "id int, target string, package string")
    got = sorted((x["id"], x["found_name"], x["status"], x["tier"]) for x in names.resolve(r, d).collect())
    want = sorted(((i, *_resolve(defs, t, p)) for i, t, p in refs), key=lambda x: (x[0], str(x)))
    assert sorted(map(str, got)) == sorted(map(str, want)) and {w[3] for w in want} == {"exact", "suffix", "package", None} and {w[2] for w in want} == {"resolved", "missing", "ambiguous"}
    assert names.resolve(r.limit(0), d).count() == 0
    assert {x["status"] for x in names.resolve(r, d.limit(0)).collect()} == {"missing"}


def test_one_name_of_most(spark):
    """A third of all definitions and of all references share a tail: no pairs are made of them."""
    d = spark.range(20_000).select(F.concat(F.lit("n"), "id", F.when(F.col("id") % 3 == 0, ".Hot").otherwise(F.concat(F.lit(".T"), "id"))).alias("name"), F.lit("p").alias("package"), F.lit("entity").alias("kind"))
    r = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("T"), F.col("id") % 20_000)).alias("target"), F.lit("p").alias("package"))
    got = {x["status"]: x["count"] for x in names.resolve(r, d).groupBy("status").count().collect()}
    assert got["ambiguous"] == 20_000 and sum(got.values()) == 60_000


def test_incoming(spark):
    defs, _, rng = _facts()
    pool = ["Item", "Order", "b.Item", "a", "x", "cds.String", *list(defs)[:20]]
    refs = [(rng.choice(list(defs)), f"f{i % 7}", rng.choice(["association", "type", "projection", "other"]), rng.choice(pool), rng.choice([None, "p", "q"])) for i in range(300)]
    asked = ["Item", "b.Item", "nowhere", "x", list(defs)[0], None, "Item"]
    want = set()
    for e in {a for a in asked if a is not None}:
        fits = {n for n in defs if n == e or n.endswith("." + e)}
        fits = {e} if "." in e and e in defs else fits
        if not fits:
            want.add((e, None, None, None, "unknown_entity"))
        for source, field, kind, target, package in refs:
            found, status, _ = _resolve(defs, target, package)
            if status != "resolved" or kind == "other" or found not in fits or kind == "type" and (target.startswith("cds.") or defs[found][1] != "type"):
                continue
            want.add((e, source, "(projection)" if kind == "projection" else field, kind == "type", "reference"))
    r = spark.createDataFrame(refs, "source string, field string, kind string, target string, package string")
    got = [tuple(x) for x in names.incoming(r, _defs(spark, defs), spark.createDataFrame([(a,) for a in asked], "entity string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(w[3] for w in want) and any(w[4] == "unknown_entity" for w in want)


def _module(file, spec):
    out = []
    for part in [*file.split("/")[:-1], *spec.split("/")]:
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out).removesuffix(".cds")


SERVICE = "service_id int, repo_id int, package_name string, service_name string, qualified_name string, source_file string, is_extend boolean, module_specifier string, imported_symbol string, import_kind string"


def test_bases_and_inherited(spark):
    rng = random.Random(11)
    packages = {0: "@o/a", 1: "b", 2: None, 3: "@o/c"}
    rows = []
    for i in range(160):
        repo, extend = rng.randrange(4), rng.random() < 0.5
        kind = rng.choice(["relative", "package", None])
        spec = {"relative": ["./m", "../srv/n.cds", "../../../lib/m", "", None], "package": ["@o/a", "b", "@o/a/srv/m", "b/lib/m.cds", "@o/c/srv/n", None], None: [None, "./m"]}[kind]
        name = f"S{rng.randrange(5)}"
        rows.append((i, repo, packages[repo], name, rng.choice([name, "org." + name, None]), rng.choice(["srv/m.cds", "srv/n", "lib/m.cds", "srv/n.cds", None]), rng.choice([True, extend]) if extend else rng.choice([False, None]), rng.choice(spec), rng.choice([None, "S1", "org.S2"]), kind))
    plain = [r for r in rows if not r[6]]
    want = {}
    for i, repo, _, name, _, file, extend, spec, symbol, kind in rows:
        if not extend:
            continue
        symbol = symbol or name
        fits = [b for b in plain if symbol in (b[3], b[4])]
        if kind == "relative" and spec:
            m = _module(file or "", spec)
            fits = [b for b in fits if b[1] == repo and b[5] in (m, m + ".cds")]
        elif kind == "package" and spec:
            own = "/".join(spec.split("/")[: 2 if spec[0] == "@" else 1])
            m = spec[len(own) :].removeprefix("/")
            fits = [b for b in fits if b[2] == own and (not m or b[5] in (m, m + ".cds"))]
        else:
            fits = [b for b in fits if b[1] == repo]
        want[i] = ("resolved", fits[0][0]) if len(fits) == 1 else ("ambiguous" if fits else "unresolved", None)
    found = extensions.bases(spark.createDataFrame(rows, SERVICE))
    assert {r["service_id"]: (r["status"], r["base_id"]) for r in found.collect()} == want and len({w[0] for w in want.values()}) == 3

    ops = []
    for i, *_ in rows:
        for _ in range(3):
            ops.append([len(ops), i, f"o{rng.randrange(4)}", "/p", rng.choice(["action", None]), "{}", None, "f", 1, "direct", None])
    direct = {}
    for o in ops:
        direct.setdefault(o[1], []).append(o)
    for i, (_, base) in want.items():
        for o in direct.get(base, []):
            if rng.random() < 0.7:  # stored before: as it is, or changed since
                ops.append([len(ops), i, *o[2:5], rng.choice(["{}", "{}", "old"]), *o[6:9], "inherited", o[0]])
        ops.append([len(ops), i, f"gone{i}", "/p", None, None, None, None, None, "inherited", 1])
    acts = []
    for i, (_, base) in want.items():
        mine = {(o[2], o[3]) for o in direct.get(i, [])}
        desired = [o for o in direct.get(base, []) if (o[2], o[3]) not in mine] if base is not None else []
        stored = [o for o in ops if o[1] == i and o[9] == "inherited"]
        last = {(o[2], o[3]): o for o in stored}
        keys = {(o[2], o[3]) for o in desired}
        acts += [(i, o[2], o[3], "delete", o[0], o[10]) for o in stored if (o[2], o[3]) not in keys]
        for o in desired:
            s = last.get((o[2], o[3]))
            acts.append((i, o[2], o[3], "add" if s is None else "keep" if s[4:9] == o[4:9] and s[10] == o[0] else "update", s and s[0], o[0]))
    o = spark.createDataFrame([tuple(x) for x in ops], "operation_id int, service_id int, name string, path string, type string, params string, returns string, file string, line int, provenance string, base_operation_id int")
    got = [tuple(r) for r in extensions.inherited(found, o).collect()]
    assert sorted(map(str, got)) == sorted(map(str, acts)) and {a[3] for a in acts} == {"add", "keep", "update", "delete"}
    assert extensions.inherited(found.limit(0), o).count() == 0
