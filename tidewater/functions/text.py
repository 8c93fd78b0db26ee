"""Scalar functions on names, texts and small notations, as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fuzzy_score(name: Column, term: Column) -> Column:
    """-2000 for the same text, -1000 + place for a part, else edit distance; case is ignored. Null where it is beyond max(2, a third of the term)."""
    a, b = F.lower(name), F.lower(term)
    at = F.instr(a, b)
    score = F.when(a == b, -2000).when(at > 0, -1000 + at - 1).otherwise(F.levenshtein(a, b))
    return F.when(score <= F.greatest(F.lit(2), F.ceil(F.length(b) / 3)), score)


def csv_escape(value: Column) -> Column:
    """Quoted where it holds a quote, comma or line end; null to nothing."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def md_escape(value: Column) -> Column:
    v = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(v, r"\r?\n", " ")


def redact_literals(value: Column, secrets: list[str]) -> Column:
    """The longest first, each to '***'."""
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        value = F.replace(value, F.lit(s), F.lit("***"))
    return value


#: Words of a key or an assignment that tell of a secret, and the forms of mail addresses and web tokens.
SECRET_WORDS = "authorization|cookie|token|secret|password|key|credential"
SECRET_ASSIGNED = "access token|apikey|api key|clientsecret|client secret|password|passphrase|passwd|pwd|key|connection_string|connection-string|secret|token"
PEM = "-----BEGIN [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----"
AUTH = r"(?i)(?<![A-Za-z0-9_])(?:Bearer|Basic)\s+[^\s,;]+"
WEB_TOKEN = r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
#: Fixed value: a mail address as a word. Its labels are taken possessively, so no text makes the matching recurse; of a name
#: before the @ of more than 255 characters only the end counts, so that long runs without an @ are not read anew from each place.
MAIL = r"(?<![A-Za-z0-9_])[A-Za-z0-9][A-Za-z0-9._%+-]{0,254}+(?<=[A-Za-z0-9])@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?![A-Za-z0-9_]))++"
USER_INFO = r"^((?:[Jj][Dd][Bb][Cc]:)?[A-Za-z][A-Za-z0-9+.-]*://)[^/?#\s]*[^:/?#\s][^/?#\s]*@(\S+)$"
_BARE = "[^,'\"`}\\s]+"
ASSIGNED_VALUE = rf"(?i)({SECRET_WORDS})\s*[:=]\s*(?:'{_BARE}'|\"{_BARE}\"|`{_BARE}`|{_BARE})"


def redact_assignments(value: Column) -> Column:
    """password=x, monkey: 'x' and the like to 'word: [REDACTED]'; a quote that is not closed leaves the text as it is."""
    return F.regexp_replace(value, ASSIGNED_VALUE, "$1: [REDACTED]")


def redact_secrets(value: Column) -> Column:
    """A text without secrets: keys and certificates, and texts that assign a secret, go as a whole.

    Of urls (of jdbc: too) the user's name and password go; in other texts the words after
    Bearer or Basic, web tokens and mail addresses. Hosts are not rewritten. Null stays null.
    """
    whole = F.lit("[REDACTED]")
    url = F.regexp_replace(value, USER_INFO, "$1redacted:redacted@$2")
    rest = F.regexp_replace(F.regexp_replace(value, AUTH, "[REDACTED]"), WEB_TOKEN, "[REDACTED]")
    rest = F.regexp_replace(rest, MAIL, "[REDACTED]")
    jdbc = F.startswith(F.lower(value), F.lit("jdbc:"))
    assigns = value.rlike(rf"(?i)(?:^|[^a-z0-9])(?:{SECRET_ASSIGNED})\s*[=:]")
    return F.when(value.rlike(PEM), whole).when(jdbc & (url != value), url).when(assigns, whole).when(url != value, url).otherwise(rest)


def redact_json(value: Column) -> Column:
    """JSON texts with the values of secret keys at any depth, and secrets in texts, replaced; null where it is no JSON."""
    secret, assigned = re.compile(SECRET_WORDS, re.I), re.compile(ASSIGNED_VALUE)

    def walk(x):
        if isinstance(x, dict):
            return {k: "[REDACTED]" if secret.search(k) else walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return assigned.sub(r"\1: [REDACTED]", x) if isinstance(x, str) else x

    def one(raw):
        try:
            return None if raw is None else json.dumps(walk(json.loads(raw)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(value)


def byte_prefix(value: Column, most: int) -> tuple[Column, Column]:
    """(text, truncated): the longest prefix of whole characters in at most so many UTF-8 bytes; all of it if `most` is not above 0."""
    raw = F.encode(value, "UTF-8")
    if most <= 0:
        return value, F.lit(False)
    within = lambda k: F.hex(F.substring(raw, most + 1 - k, 1)).between("80", "BF")
    cut = F.lit(most - 3)
    for k in (2, 1, 0):
        cut = F.when(~within(k), most - k).otherwise(cut)
    longer = F.octet_length(value) > most
    return F.when(longer, F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")).otherwise(value), longer


def substituted(template: Column, values: Column) -> list[Column]:
    """effective, placeholders, supplied, missing and changed of a template whose `${key}` are looked up in a map; what is missing stays."""
    key = r"\$\{([^{}]+)\}"
    found = F.transform(F.regexp_extract_all(template, F.lit(key), F.lit(1)), lambda k: F.trim(k))
    put = F.transform(found, lambda k: F.coalesce(F.element_at(values, k), F.when(F.map_contains_key(values, k), "").otherwise(F.concat(F.lit("${"), k, F.lit("}")))))
    effective = F.array_join(F.zip_with(F.split(template, key, -1), put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    keys = F.array_distinct(found)
    has = lambda k: F.map_contains_key(values, k)
    return [
        effective.alias("effective"), keys.alias("placeholders"), F.filter(keys, has).alias("supplied"),
        F.filter(keys, lambda k: ~has(k)).alias("missing"), (effective != template).alias("changed"),
    ]


def common_prefix(a: Column, b: Column) -> Column:
    """The longest text that both begin with."""
    upto = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.substring(a, F.lit(1), F.array_max(F.filter(upto, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))))


def redact_mail(value: Column) -> Column:
    return F.regexp_replace(value, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")


def slug_hash(value: Column) -> Column:
    """Lower-case letters, digits and dashes, 40 characters at most, and 12 digits of a SHA-256."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.substring(slug, 1, 40), F.lit("-"), F.substring(F.sha2(value, 256), 1, 12))


def hash_color(value: Column, colors: int = 10) -> Column:
    """h = h * 31 + unit over the UTF-16 units, kept to a signed 32-bit number; its absolute value modulo the number of colours."""
    raw = F.hex(F.encode(value, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(4)), lambda i: F.conv(F.substring(raw, i, F.lit(4)), 16, 10).cast("long"))
    h = F.aggregate(F.when(raw == "", F.array().cast("array<bigint>")).otherwise(units), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return (F.least(h, F.lit(1 << 32) - h) % colors).cast("int")


def a1_column(letters: Column) -> Column:
    """'A' is 1, 'Z' 26, 'AA' 27."""
    codes = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(codes, F.lit(0), lambda n, c: n * 26 + c)


def hours(minutes: Column) -> Column:
    return F.round(minutes / 60, 2)


def json_pointer_path(pointer: str) -> list[str]:
    """The steps of an RFC 6901 pointer."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError("a pointer begins with '/'")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


def json_at(doc: Column, pointer: str) -> Column:
    """The text at a pointer of a JSON text; null where there is none."""
    path = "$"
    for step in json_pointer_path(pointer):
        path += f"[{step}]" if step.isdigit() else "['" + step.replace("'", "\\'") + "']"
    return F.try_variant_get(F.try_parse_json(doc), path, "string")
