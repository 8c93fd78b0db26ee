"""Log lines to typed rows: parsing, continuation lines, levels, router fields, compact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.session import Scratch

LINE = r"^\s*(\d{4}-\d{2}-\d{2}T\S+)\s+\[([^\]]+)\]\s+(OUT|ERR)\s?(.*)$"
SEVERITY = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "error": 4, "fatal": 5}
#: How lines of the client itself begin.
SYSTEM_PREFIXES = ("Retrieving logs for app", "Failed to retrieve logs from Log Cache:", "Failed to retrieve recent logs from Log Cache:", "Server error, status code:")
#: Query keys whose values are not shown, without their separators.
SECRET_KEYS = ("accesstoken", "apikey", "auth", "authorization", "clientsecret", "oauthcode", "passwd", "password", "refreshtoken", "sig", "signature", "token")
REQUEST = r"\"([A-Z]+)\s+(\S+)\s+HTTP/[\d.]+\"\s+(\d{3}|-)"
ROUTER = r"(?i)^rtr\b"
#: White space that is trimmed from lines.
WHITE = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def parse_line(line: Column) -> list[Column]:
    """timestamp_raw, source, stream, body of a header line; empty texts for any other line."""
    part = lambda i: F.regexp_extract(line, LINE, i)
    return [part(1).alias("timestamp_raw"), part(2).alias("source"), part(3).alias("stream"), trimmed(part(4)).alias("body")]


def is_system(line: Column) -> Column:
    """Blank lines and lines of the client itself."""
    found = trimmed(line) == ""
    for p in SYSTEM_PREFIXES:
        found = found | F.startswith(trimmed(line), F.lit(p))
    return found


def json_body(body: Column) -> Column:
    """The body as a variant where it is a JSON object; null for any other."""
    return F.when(body.startswith("{") & body.endswith("}"), F.try_parse_json(body))


def is_header(line: Column) -> Column:
    """Whether a line begins an entry; one whose body looks like JSON and is none does not."""
    body = trimmed(F.regexp_extract(line, LINE, 4))
    broken = body.startswith("{") & body.endswith("}") & F.try_parse_json(body).isNull()
    return line.rlike(LINE) & ~broken


def numbered(lines: DataFrame, group: str, scratch: Scratch) -> DataFrame:
    """lines(group, pos, line) -> with header and entry: the pos of the line's header, null before a group's first.

    Lines are dealt by ranges of (group, pos) and written, so one very long log is shared
    out; each range passes on no more than its last header.
    """
    ranged = lines.withColumn("header", is_header(F.col("line"))).repartitionByRange(group, "pos").withColumn("p", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    at = F.when(F.col("header"), F.col("pos"))
    within = Window.partitionBy("p", group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = ranged.groupBy("p", group).agg(F.max(at).alias("last")).select(F.col("p").alias("in"), F.col(group).alias("of"), F.max("last").over(before).alias("carried"))
    local = ranged.withColumn("local", F.last(at, ignorenulls=True).over(within))
    found = local.join(carried, (F.col("p") == F.col("in")) & F.col(group).eqNullSafe(F.col("of")))
    return found.withColumn("entry", F.coalesce("local", "carried")).drop("p", "in", "of", "local", "carried")


def join_continuations(lines: DataFrame, group: str, scratch: Scratch) -> DataFrame:
    """lines(group, pos, line): a line without a header belongs to the last header before it in its group.

    Gives (group, at, text, n_lines) where `at` is the place of the entry's header, null for the
    lines before a group's first. Each entry's lines are joined with line feeds in order. Lines
    of a null group are a group like any other.
    """
    runs = numbered(lines, group, scratch)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return runs.groupBy(group, F.col("entry").alias("at")).agg(text.alias("text"), F.count("*").alias("n_lines"))


def entries(lines: DataFrame, group: str, scratch: Scratch) -> DataFrame:
    """lines(group, pos, line) -> (group, pos, timestamp_raw, source, stream, level, message, n_lines), one row per entry.

    Blank lines and lines of the client itself are dropped. Lines before a group's first
    header make one entry of source SYSTEM. The level is that of the whole joined message.
    Lines of a null group are a group like any other.
    """
    runs = numbered(lines.where(~is_system(F.col("line"))).withColumn("line", trimmed(F.col("line"))), group, scratch)
    rest = F.transform(F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("pos", "line")))), lambda x: x["line"])
    first = F.max_by("line", F.when(F.col("header"), F.col("pos")))
    found = runs.groupBy(group, "entry").agg(F.min("pos").alias("pos"), first.alias("head"), rest.alias("rest"), F.count("*").alias("n_lines"))
    return found.select(group, "pos", *entry_fields(F.col("head"), F.col("rest")), "n_lines")


def entry_fields(head: Column, rest: Column) -> list[Column]:
    """timestamp_raw, source, stream, level and message of an entry, from its header line (null if it has none) and its other lines."""
    stamp, source, stream, body = (F.when(head.isNotNull(), c) for c in parse_line(head))
    body = F.when(body == "", "(empty)").otherwise(body)
    source, stream = F.coalesce(source, F.lit("SYSTEM")), F.coalesce(stream, F.lit("OUT"))
    said = F.try_variant_get(json_body(body), "$.level", "string")
    message = F.array_join(F.concat(F.when(body.isNotNull(), F.array(body)).otherwise(F.array().cast("array<string>")), rest), "\n")
    status = F.try_to_number(F.nullif(F.regexp_extract(message, REQUEST, 3), F.lit("-")), F.lit("999")).cast("int")
    return [
        F.coalesce(stamp, F.lit("N/A")).alias("timestamp_raw"), source.alias("source"), stream.alias("stream"),
        level(said, status, message, stream, source).alias("level"), message.alias("message"),
    ]


def router_level(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def level(explicit: Column, status: Column, message: Column, stream: Column, source: Column) -> Column:
    """An explicit level, else for router lines that of the status, else words of the message, else the stream."""
    said = F.lower(F.trim(explicit))
    return (
        F.when(said == "warning", "warn")
        .when(said.isin(*SEVERITY), said)
        .when(source.rlike(ROUTER), router_level(status))
        .when(message.rlike(r"(?i)\bfatal\b"), "fatal")
        .when(message.rlike(r"(?i)\b(error|exception|failed)\b"), "error")
        .when(message.rlike(r"(?i)\bwarn(ing)?\b"), "warn")
        .when(stream == "ERR", "error")
        .otherwise("info")
    )


def severity(lvl: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in SEVERITY.items():
        out = F.when(lvl == name, n).otherwise(out)
    return out


def source_family(source: Column) -> Column:
    return F.split_part(source, F.lit("/"), F.lit(1))


def decoded_target(target: Column) -> Column:
    """Path and query decoded each for itself, so that one that can't be decoded leaves the other."""
    at = F.instr(target, "?")
    path, query = F.substring(target, 1, at - 1), F.substring(target, at + 1, F.length(target))
    return F.when(at == 0, percent_decoded(target)).otherwise(F.concat(percent_decoded(path), F.lit("?"), percent_decoded(query)))


def request_text(method: Column, target: Column, most: int = 120) -> Column:
    """'GET /path', cut to `most` characters with '...'; empty unless both are known."""
    whole = F.concat(method, F.lit(" "), target)
    room = F.greatest(F.lit(16), F.lit(most - 6) - F.length(method))
    short = F.concat(method, F.lit(" "), F.substring(target, F.lit(1), room), F.lit("..."))
    return F.when((method == "") | (target == ""), "").when(F.length(whole) <= most, whole).otherwise(short)


def router_fields(body: Column) -> list[Column]:
    """host, method, request, status, latency, tenant, client_ip and request_id of a router access line; '' for what it does not say."""
    pick = lambda p, i=1: F.regexp_extract(body, p, i)
    told = lambda *cs: F.coalesce(*(F.nullif(F.nullif(F.trim(c), F.lit("-")), F.lit("")) for c in cs), F.lit(""))
    quoted = lambda k: pick(rf'\b{k}:"([^"]*)"')
    seconds = F.try_to_number(pick(r"\bresponse_time:(\d+(?:\.\d+)?)(?=\s|$|,)"), F.lit("999999999.999999999")).cast("double")
    return [
        told(pick(r"^([^ ]+)\s+-\s+\[")).alias("host"), pick(REQUEST).alias("method"), request_text(pick(REQUEST), decoded_target(pick(REQUEST, 2))).alias("request"),
        F.replace(pick(REQUEST, 3), F.lit("-"), F.lit("")).alias("status"), F.when(seconds.isNull(), "").otherwise(latency_text(seconds)).alias("latency"), told(quoted("tenantid")).alias("tenant"),
        told(quoted("x_cf_true_client_ip"), quoted("true_client_ip"), F.split_part(quoted("x_forwarded_for"), F.lit(","), F.lit(1))).alias("client_ip"),
        told(quoted("x_correlationid"), quoted("vcap_request_id")).alias("request_id"),
    ]


def redacted_query(url: Column) -> Column:
    """The url with the values of secret query keys replaced; keys are compared decoded, in lower case, letters and digits only."""
    at = F.instr(url, "?")
    rest = F.substring(url, at + 1, F.length(url))
    query, tail = F.substring_index(rest, "#", 1), F.regexp_extract(rest, "(?s)^[^#]*(#.*)?$", 1)

    def part(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        plain = F.regexp_replace(F.lower(percent_decoded(key)), "[^a-z0-9]", "")
        return F.when(plain.isin(*SECRET_KEYS), F.concat(key, F.lit("=redacted"))).otherwise(p)

    shown = F.array_join(F.transform(F.split(query, "&"), part), "&")
    return F.when(at == 0, url).otherwise(F.concat(F.substring(url, F.lit(1), at), shown, tail))


def duration_ms(text: Column) -> Column:
    """'90', '1.5h', '250ms', '15m', '1d' in milliseconds; bare numbers are seconds; null for anything else."""
    shape = r"(?i)^(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?$"
    unit = F.lower(F.regexp_extract(F.trim(text), shape, 2))
    factor = F.when(unit == "ms", 1).when((unit == "s") | (unit == ""), 1_000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    amount = F.try_to_number(F.regexp_extract(F.trim(text), shape, 1), F.lit("999999999999.999999")).cast("double")
    return F.round(amount * factor).cast("long")


def since_ms(text: Column) -> Column:
    """The strict grammar of a whole positive number and a unit; null for anything else."""
    return F.when(text.rlike(r"(?i)^\s*[1-9]\d*(s|m|h|d)\s*$"), duration_ms(text))


def known(value: Column) -> Column:
    """Null for what says nothing: empty text and '-'."""
    return F.when((value == "") | (value == "-"), None).otherwise(value)


def first_known(*values: Column) -> Column:
    return F.coalesce(*map(known, values))


def latency_text(seconds: Column) -> Column:
    """Below one second 'n.n ms', else 'n.nnn s', zeros at the end trimmed."""
    trim = lambda c: F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    ms = F.format_string("%.1f", F.round(seconds * 1000, 1))
    s = F.format_string("%.3f", F.round(seconds, 3))
    return F.when(seconds < 1, F.concat(trim(ms), F.lit(" ms"))).otherwise(F.concat(trim(s), F.lit(" s")))


def percent_decoded(text: Column) -> Column:
    """Percent decoding that leaves '+' alone and gives undecodable text, bytes that are no UTF-8 too, back as it is."""
    found = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    wrong = F.contains(found, F.lit("\ufffd")) & ~F.contains(text, F.lit("\ufffd")) & ~F.contains(F.upper(text), F.lit("%EF%BF%BD"))
    return F.when(found.isNull() | wrong, text).otherwise(found)


def squeezed(text: Column, most: int) -> Column:
    """White space to one blank, ends trimmed, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def compacted(text: Column, most: int = 500) -> Column:
    """White space to one blank, ends trimmed; longer ones end in '...' within so many characters."""
    squeezed_text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(squeezed_text) <= most, squeezed_text).otherwise(F.concat(F.substring(squeezed_text, 1, most - 3), F.lit("...")))


def epoch_ms(raw: Column) -> Column:
    """Milliseconds of a timestamp text; '+hhmm' offsets are understood; null for what is none."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_replace(raw, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def tail_order(rows: DataFrame, time: str, raw: str, app: str, id_: str) -> list[Column]:
    """Known times first, then the raw text, the application, and the id."""
    return [F.col(time).asc_nulls_last(), F.col(raw).asc(), F.col(app).asc(), F.col(id_).asc()]


def last_n(rows: DataFrame, n: int, group: str, id_: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(id_).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def status_filter(status: Column, pattern: str) -> Column:
    """'500', '5xx' or '400-499' in either order; what is no three-digit status never matches."""
    code = F.when((status >= 100) & (status <= 999), status)
    if pattern.lower().endswith("xx"):
        lo = int(pattern[0]) * 100
        return F.coalesce(code.between(lo, lo + 99), F.lit(False))
    bounds = sorted(int(x) for x in pattern.split("-"))
    return F.coalesce(code.between(bounds[0], bounds[-1]), F.lit(False))


def app_filter(app: Column, include: tuple[str, ...] = (), include_re: str | None = None, exclude: tuple[str, ...] = (), exclude_re: str | None = None) -> Column:
    """Excluded names, then excluded patterns; without anything to include all others pass."""
    out = ~app.isin(*exclude) if exclude else F.lit(True)
    if exclude_re:
        out = out & ~app.rlike(exclude_re)
    if not include and include_re is None:
        return out
    wanted = app.isin(*include) if include else F.lit(False)
    return out & (wanted | app.rlike(include_re) if include_re else wanted)
