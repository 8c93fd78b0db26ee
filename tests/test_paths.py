"""Structure and meaning of request paths against a scan one character at a time."""

import random
import re

from tidewater.functions import paths

HOLE = re.compile(r"\$\{\s*[^{}\s][^{}]*\}")


def scan(path):
    """(fault, query at, slashes, open, close), by one character after the other."""
    holes = {m.start(): m.end() for m in HOLE.finditer(path)}
    if "${" in HOLE.sub(" ", path):
        return ("path_placeholder_is_malformed",)
    i, depth, query, asked, slashes, first, last = 0, 0, None, 0, [], None, None
    while i < len(path):
        c = path[i]
        if i in holes:
            i = holes[i]
            continue
        if c in "'\"":
            j = i + 1
            while True:
                if j >= len(path):
                    return ("path_quote_is_unbalanced",)
                if j in holes:
                    j = holes[j]
                elif path[j] == "\\":
                    j += 2
                elif path[j] != c:
                    j += 1
                elif path[j + 1 : j + 2] == c:
                    j += 2
                else:
                    break
            i = j + 1
            continue
        if query is not None:
            asked += {"(": 1, ")": -1}.get(c, 0)
            if asked < 0:
                return ("path_parenthesis_is_unbalanced",)
        elif c == "(":
            if depth == 0 and not slashes:
                if first is not None:
                    return ("path_parenthesis_suffix_is_invalid",)
                first = i
            depth += 1
        elif c == ")":
            if depth == 0:
                return ("path_parenthesis_is_unbalanced",)
            depth -= 1
            if depth == 0 and not slashes:
                last = i
        elif c == "?" and depth == 0:
            query = i
        elif c == "/" and i > 0 and depth == 0:
            slashes.append(i)
        i += 1
    if depth or asked:
        return ("path_parenthesis_is_unbalanced",)
    end = query if query is not None else len(path)
    if last is not None and path[last + 1 : (slashes or [end])[0]].strip():
        return ("path_parenthesis_suffix_is_invalid",)
    bounds = [0 if path.startswith("/") else -1, *slashes, end]
    segments = [path[a + 1 : b] for a, b in zip(bounds, bounds[1:]) if path[a + 1 : b]]
    head = path[bounds[0] + 1 : first] if first is not None else segments[0] if segments else None
    return (None, path[:end], None if query is None else path[query + 1 :], segments, (head or "").strip() or None, bool(head and HOLE.search(head)), None if last is None else path[first + 1 : last])


def test_structures_against_a_scan(spark):
    rng = random.Random(3)
    pieces = ["/", "/", "(", ")", "?", "'", '"', "''", "\\", "a", "Book", "b.c", "${k}", "${ a.b }", "${", "}", "$", " ", "=", "'x'", "('1')", "é", "\U0001f600"]
    texts = sorted({"/" * rng.randrange(2) + "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(4000)} | {"", "/", "//", "/(x)", "//x(1)", "/A(1)(2)", "/A('${k}')/b?q=(1)"})
    got = paths.structures(spark.createDataFrame([(t,) for t in texts], "p string"), "p")
    faults = set()
    for r in got.collect():
        want = scan(r["p"].strip())
        faults.add(want[0])
        assert r["malformed"] == want[0], r["p"]
        if want[0] is None:
            assert (r["malformed"], r["without_query"], r["query"], r["segments"], r["head"], r["open_head"], r["arguments"]) == want, r["p"]
    assert len(faults) == 5


def test_kinds(spark):
    rows = [
        ("/Books?$filter=contains(title,'A')", "GET", "entity_query", "Books"), ("/Books?$skiptoken=${token}", None, "entity_query", "Books"), ("/Books(ID='1')", " get ", "entity_key_read", "Books"),
        ("/Authors('A')/books?$select=ID", "", "entity_navigation_query", "Authors"), ("/Authors('A')/books", "GET", "entity_navigation_query", "Authors"), ("/score(input='A')", "GET", "operation_invocation", "score"),
        ("/score(input='A')?x=1", "GET", "unknown", "score"), ("/a.b.score(x=')/?')", "POST", "operation_invocation", "a.b.score"), ("/Papers", "GET", "entity_candidate", "Papers"), ("/Papers", "POST", "entity_mutation", "Papers"),
        ("/Papers('${id}')", "PATCH", "entity_mutation", "Papers"), ("/Papers(${x.ID})/content", "PUT", "entity_media", "Papers"), ("/Papers('${id}')", "DELETE", "entity_delete", "Papers"), ("/Papers('${id}')/Items", "GET", "entity_media", "Papers"),
        ("/Papers(1)/other", "DELETE", "entity_delete", "Papers"), ("/submit", "POST", "operation_invocation", "submit"), ("/price", "GET", "unknown", "price"), ("/${name}/x", "POST", "unknown", "${name}"), ("x", "GET", "unknown", "x"), (None, None, "unknown", None),
        ("/papers/other", "PUT", "entity_mutation", "papers"), ("/A(1", "GET", "unknown", None)]
    got = paths.intents(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, m string, want string, at string"), "p", "m").collect()
    assert {r["i"]: (r["kind"], r["head"]) for r in got} == {i: r[2:] for i, r in enumerate(rows)}
    by = {r["p"]: r for r in got}
    assert by["/a.b.score(x=')/?')"]["operation"] == "score" and by["/a.b.score(x=')/?')"]["key_keys"] == []
    assert by["/Papers(${x.ID})/content"]["key_keys"] == ["x.ID"] and by["/Papers(${x.ID})/content"]["navigation"] == "content"


def test_invocations(spark):
    rows = {
        "/f(x='${a}')": ("/f", None), " /f ( ${a} ) ": ("/f", None), "/f": ("/f", "no_top_level_parenthesis"), "/f(1)?q": ("/f(1)?q", "query_string_paths_are_not_operation_invocations"), "f(1)": ("f(1)", "path_is_not_absolute"),
        "/f(1)/g": ("/f(1)/g", "operation_segment_contains_navigation_separator"), "/${f}(1)": ("/${f}(1)", "operation_segment_is_runtime_dependent"), "/(1)": ("/(1)", "operation_segment_is_empty"), "/f(1)x": ("/f(1)x", "path_parenthesis_suffix_is_invalid"),
        "/f('1)": ("/f('1)", "path_quote_is_unbalanced"), "/f(${})": ("/f(${})", "path_placeholder_is_malformed"), "/f(1))": ("/f(1))", "path_parenthesis_is_unbalanced"), " ": (None, None), None: (None, None)}
    got = paths.invocations(spark.createDataFrame([(p,) for p in rows], "p string"), "p").collect()
    assert {r["p"]: (r["normalized"], r["rejected"]) for r in got} == rows


def test_long_paths(spark):
    long = ["/A('" + "x''" * 100_000 + "')", "/" + "${k}" * 50_000, "/a" + " " * 200_000 + "b", "'" * 99_999, "/" + "(" * 3_000 + ")" * 3_000, "/A(" + "\\" * 99_999]
    got = {r["i"]: r["malformed"] for r in paths.structures(spark.createDataFrame(list(enumerate(long)), "i int, p string"), "p").collect()}
    assert got == {0: None, 1: None, 2: None, 3: "path_quote_is_unbalanced", 4: None, 5: "path_parenthesis_is_unbalanced"}
