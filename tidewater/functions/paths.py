"""Request paths of entities and operations: their structure, and what a request on them means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOLE = r"\$\{\s*+[^{}\s][^{}]*+\}"
#: Placeholders, quoted texts (a quote is doubled or escaped inside), runs of plain characters, delimiters. Possessive, so that long texts neither recurse nor go back.
TOKEN = rf"""(?s)({HOLE}|'(?:{HOLE}|\\.|''|[^'\\])*+'|"(?:{HOLE}|\\.|""|[^"\\])*+"|[^'"()?/$]++|.)"""
#: Last segments that stand for a stream or a property.
MEDIA = ("file", "content", "$value", "metadata", "items")

STATE = "struct<i:int,depth:int,asked:int,open:int,close:int,query:int,slashes:array<int>,reason:string>"


def _trim(text: Column) -> Column:
    return F.regexp_extract(text, r"(?sU)\A\s*+(.*\S)?", 1)


def _keys(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({HOLE})"), F.lit(1)), lambda k: _trim(F.substring(k, F.lit(3), F.length(k) - 3))))


def _between(tokens: Column, after: Column, before: Column) -> Column:
    """Text of the tokens after one place and before another."""
    return F.array_join(F.slice(tokens, after + 1, F.greatest(before - after - 1, F.lit(0))), "")


def _step(s: Column, t: Column) -> Column:
    i, top = s["i"] + 1, (s["depth"] == 0) & s["query"].isNull()
    first = top & (F.size(s["slashes"]) == 0)
    asked, quote = s["query"].isNotNull(), t.isin("'", '"')
    unbalanced = (t == ")") & F.when(asked, s["asked"] == 0).otherwise(s["depth"] == 0)
    reason = (
        F.when(s["reason"].isNotNull(), s["reason"]).when(quote, "path_quote_is_unbalanced").when(unbalanced, "path_parenthesis_is_unbalanced")
        .when((t == "(") & first & s["open"].isNotNull(), "path_parenthesis_suffix_is_invalid")
    )
    turn = F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
    closes = (t == ")") & ~asked & (s["depth"] == 1) & (F.size(s["slashes"]) == 0)
    return F.struct(
        i.alias("i"), F.when(asked, s["depth"]).otherwise(s["depth"] + turn).alias("depth"), F.when(asked, s["asked"] + turn).otherwise(s["asked"]).alias("asked"),
        F.when((t == "(") & first & s["open"].isNull(), i).otherwise(s["open"]).alias("open"), F.when(closes, i).otherwise(s["close"]).alias("close"),
        F.when((t == "?") & top, i).otherwise(s["query"]).alias("query"), F.when((t == "/") & top & (i > 1), F.array_append(s["slashes"], i)).otherwise(s["slashes"]).alias("slashes"), reason.alias("reason"),
    ).cast(STATE)


def structures(rows: DataFrame, path: str) -> DataFrame:
    """Rows with the structure of a path: raw, malformed, without_query, query, segments, head, open_head, arguments, keys, argument_keys, has_open.

    Texts are trimmed, null is empty. `${...}` stands for itself wherever it is; quoted texts and
    what stands in parentheses hide delimiters. `malformed` names the first fault: placeholders
    that are not closed, are empty or hold braces; quotes or parentheses that don't match; text
    after the first segment's parentheses or a second pair there. A malformed path has no
    structure. `head` is the first segment up to its parenthesis, `open_head` tells that it holds
    a placeholder, `arguments` is what stands in the parentheses.

    The fold keeps places only; texts are cut out of the tokens once.
    """
    start = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("asked"), start.alias("open"), start.alias("close"), start.alias("query"), F.array().cast("array<int>").alias("slashes"), F.lit(None).cast("string").alias("reason")).cast(STATE)
    rows = rows.withColumn("raw", _trim(F.coalesce(path, F.lit(""))))
    rows = rows.withColumn("_tokens", F.regexp_extract_all("raw", F.lit(TOKEN), F.lit(1)))
    rows = rows.withColumn("_at", F.aggregate("_tokens", zero, _step))
    at, tokens = (lambda c: F.col(f"_at.{c}")), F.col("_tokens")
    end = F.coalesce(at("query"), F.size(tokens) + 1)
    tail = _trim(_between(tokens, at("close"), F.coalesce(F.get(at("slashes"), F.lit(0)), end)))
    broken = F.contains(F.regexp_replace("raw", HOLE, " "), F.lit("${"))
    malformed = (
        F.when(broken, "path_placeholder_is_malformed").when(at("reason").isNotNull(), at("reason")).when((at("depth") > 0) | (at("asked") > 0), "path_parenthesis_is_unbalanced")
        .when(at("close").isNotNull() & (tail != ""), "path_parenthesis_suffix_is_invalid")
    )
    bounds = F.concat(F.array(F.when(F.get(tokens, F.lit(0)) == "/", 1).otherwise(0)), at("slashes"), F.array(end))
    parts = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda j: _between(tokens, F.element_at(bounds, j), F.element_at(bounds, j + 1)))
    rows = rows.withColumns({"malformed": malformed, "_parts": F.filter(parts, lambda p: p != "")})
    valid = F.col("malformed").isNull()
    before_open = _between(tokens, F.when(F.get(tokens, F.lit(0)) == "/", 1).otherwise(0), at("open"))
    rows = rows.withColumns({
        "without_query": F.when(valid, _between(tokens, F.lit(0), end)).otherwise(F.col("raw")), "query": F.when(valid & at("query").isNotNull(), _between(tokens, at("query"), F.size(tokens) + 1)),
        "segments": F.when(valid, F.col("_parts")).otherwise(F.array().cast("array<string>")), "has_open": valid & at("open").isNotNull(),
        "_head": F.when(valid, F.when(at("open").isNotNull(), before_open).otherwise(F.get("_parts", F.lit(0)))), "arguments": F.when(valid & at("close").isNotNull(), _between(tokens, at("open"), at("close"))),
        "keys": F.when(valid, _keys(F.col("raw"))).otherwise(F.array().cast("array<string>")),
    })
    head = _trim(F.col("_head"))
    rows = rows.withColumns({
        "head": F.when(head != "", head), "open_head": F.coalesce(F.col("_head").rlike(HOLE), F.lit(False)), "argument_keys": F.coalesce(_keys(F.col("arguments")), F.array().cast("array<string>")),
        "_operation": F.when(F.col("has_open"), _trim(F.concat(F.when(F.get(tokens, F.lit(0)) == "/", "/").otherwise(""), "_head"))),
    })
    return rows.drop("_tokens", "_at", "_parts", "_head")


def _invoked() -> Column:
    return F.col("malformed").isNull() & F.col("has_open") & F.startswith("raw", F.lit("/")) & (F.size("segments") == 1) & ~F.col("open_head") & F.col("arguments").isNotNull() & (F.length("_operation") > 1)


def invocations(rows: DataFrame, path: str) -> DataFrame:
    """Rows with (normalized, invoked, rejected) of a path: `/name(arguments)` becomes `/name`, anything else stays and says why; empty paths give nulls."""
    rows = structures(rows, path)
    rejected = (
        F.when(F.col("malformed").isNotNull(), F.col("malformed")).when(~F.col("has_open"), "no_top_level_parenthesis").when(F.col("query").isNotNull(), "query_string_paths_are_not_operation_invocations")
        .when(~F.startswith("raw", F.lit("/")), "path_is_not_absolute").when(F.size("segments") != 1, "operation_segment_contains_navigation_separator").when(F.col("open_head"), "operation_segment_is_runtime_dependent")
        .when(F.col("arguments").isNull(), "top_level_invocation_parenthesis_is_unbalanced").when(F.length("_operation") <= 1, "operation_segment_is_empty")
    )
    rows = rows.withColumn("rejected", F.when(F.col("raw") != "", rejected))
    some = F.col("raw") != ""
    return rows.withColumns({"invoked": F.when(some, F.col("rejected").isNull()), "normalized": F.when(some, F.when(F.col("rejected").isNull(), F.col("_operation")).otherwise(F.col("raw")))}).drop("_operation")


def intents(rows: DataFrame, path: str, method: str) -> DataFrame:
    """Rows with the structure of a path and (verb, kind, why, operation, key_keys, navigation, media): what a request means.

    verb is GET where it is null or blank. kind is operation_invocation, entity_query,
    entity_key_read, entity_navigation_query, entity_mutation, entity_delete, entity_media,
    entity_candidate or unknown. Only a lower-case head can be an operation that is called with
    arguments; key_keys are the placeholders in parentheses of anything else. Columns of the
    same names as those added are replaced.
    """
    verb = F.upper(_trim(F.coalesce(method, F.lit("GET"))))
    rows = structures(rows.withColumn("verb", F.when(verb == "", "GET").otherwise(verb)), path)
    deep, last = F.size("segments") > 1, F.element_at("segments", -1)
    lower = F.coalesce(F.regexp_extract("head", r"([^.]*)\z", 1).rlike(r"\A[a-z][A-Za-z0-9_]*\z"), F.lit(False))
    name = F.when(_invoked(), F.regexp_extract("_operation", r"(?s)\A/?(?:.*\.)?([^.]*)\z", 1)).when(~deep & ~F.col("has_open"), F.col("head"))
    rows = rows.withColumns({"invoked": _invoked(), "navigation": F.when(deep, F.array_join(F.slice("segments", F.lit(2), F.size("segments")), "/")), "media": F.coalesce(deep & F.lower(last).isin(*MEDIA), F.lit(False)), "operation": name, "_lower": lower})
    called, upper = F.col("invoked") & F.col("_lower"), F.coalesce(F.col("head").rlike(r"\A[A-Z][A-Za-z0-9_]*\z"), F.lit(False))
    asked, held, way, media = F.col("query").isNotNull(), F.col("has_open"), F.col("navigation").isNotNull(), F.col("media")
    change = F.when(F.col("verb") == "DELETE", "entity_delete").otherwise("entity_mutation")
    pair = lambda kind, why: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(why).alias("why"))
    got = (
        F.when(asked & way, pair("entity_navigation_query", "get_path_has_navigation_and_query_string")).when(asked & called, pair("unknown", "get_invocation_with_query_string_requires_indexed_operation_evidence"))
        .when(asked, pair("entity_query", "get_collection_path_has_query_string")).when(way & media, pair("entity_media", "get_entity_media_stream_path")).when(way, pair("entity_navigation_query", "get_path_has_navigation_segments"))
        .when(held & called, pair("operation_invocation", "get_balanced_top_level_operation_invocation")).when(held, pair("entity_key_read", "get_entity_segment_has_key_predicate"))
        .when(upper, pair("entity_candidate", "uppercase_collection_segment_without_indexed_entity_evidence")).otherwise(pair("unknown", "get_path_has_no_query_key_or_navigation_signal"))
    )
    put = (
        F.when(called, pair("operation_invocation", "non_get_balanced_top_level_operation_invocation")).when(media, pair("entity_media", "non_get_entity_media_stream_path"))
        .when(held, pair(change, "non_get_entity_key_or_navigation_path_shape")).when(way, pair(change, "non_get_entity_navigation_path_shape"))
        .when(upper, pair(change, "non_get_entity_path_shape")).otherwise(pair("operation_invocation", "non_get_lowercase_path_may_be_operation"))
    )
    told = (
        F.when(~F.startswith("raw", F.lit("/")), pair("unknown", "path_missing_or_not_absolute")).when(F.col("malformed").isNotNull(), F.struct(F.lit("unknown").alias("kind"), F.col("malformed").alias("why")))
        .when(F.col("open_head"), pair("unknown", "path_classification_head_is_runtime_dependent")).when(F.col("verb") == "GET", got).otherwise(put)
    )
    rows = rows.withColumns({"_told": told, "key_keys": F.when(called, F.array().cast("array<string>")).otherwise(F.col("argument_keys"))})
    return rows.withColumns({"kind": F.col("_told.kind"), "why": F.col("_told.why")}).drop("_told", "_lower", "_operation")
