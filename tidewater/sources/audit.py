"""Audit events of a paged REST service as a Spark data source: one partition a window of time."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PATH = "/v3/audit_events"
#: Rows that the service gives a page at most.
PAGE_ROWS = 100
ENTITY = "struct<guid:string,type:string,name:string>"
SCHEMA = f"guid string, type string, created_at timestamp, updated_at timestamp, actor {ENTITY}, target {ENTITY}, data string, space_guid string, organization_guid string"


@dataclass
class Window(InputPartition):
    """Events from `since` on and before `until`; None is no bound."""

    since: dt.datetime | None
    until: dt.datetime | None


def _stamp(t: dt.datetime) -> str:
    return t.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _time(text: object) -> dt.datetime | None:
    if not isinstance(text, str) or not text:
        return None
    try:
        t = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def _whole(t: dt.datetime, up: bool) -> dt.datetime:
    """The second at or before a time, or the one at or after it: the service compares whole seconds."""
    t = t if t.tzinfo else t.astimezone()
    low = t.replace(microsecond=0)
    return low + dt.timedelta(seconds=1) if up and low < t else low


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.endpoint, self.token = options["endpoint"].rstrip("/"), options.get("token")
        scope, guid = options.get("scope", "app"), options["guid"]
        if scope not in ("app", "space"):
            raise ValueError(f"scope is app or space, not {scope}")
        self.scope = ("target_guids" if scope == "app" else "space_guids", guid)
        self.limit = max(int(options["limit"]), 1) if options.get("limit") else None
        self.windows = max(int(options.get("windows", "1")), 1)
        self.tries = max(int(options.get("tries", "3")), 1)
        self.since, self.until = _time(options.get("since")), _time(options.get("until"))
        self.types: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Types go to the service for good; times narrow the windows and are tested by Spark again, as the service rounds them."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("type",) and isinstance(f, (EqualTo, In)):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                if all(isinstance(w, str) and w and "," not in w for w in wanted):
                    self.types = [w for w in wanted if self.types is None or w in self.types]
                    continue
            if column == ("created_at",) and isinstance(getattr(f, "value", None), dt.datetime):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = _whole(f.value, up=False)
                    self.since = low if self.since is None else max(self.since, low)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    # one second more, so that an event of just this second is among them
                    high = _whole(f.value, up=True) + dt.timedelta(seconds=1)
                    self.until = high if self.until is None else min(self.until, high)
            yield f

    def partitions(self) -> list[Window]:
        if self.types == [] or (self.since and self.until and self.since >= self.until):
            return []
        if self.windows == 1 or self.since is None or self.until is None:
            return [Window(self.since, self.until)]
        width = (self.until - self.since) / self.windows
        bounds = sorted({_whole(self.since + width * i, up=False) for i in range(1, self.windows)} - {self.since})
        return [Window(a, b) for a, b in zip([self.since, *bounds], [*bounds, self.until]) if a < b]

    def _first(self, window: Window) -> str:
        asked = [self.scope, ("order_by", "-created_at"), ("per_page", str(min(self.limit or PAGE_ROWS, PAGE_ROWS)))]
        if self.types:
            asked.append(("types", ",".join(self.types)))
        if window.since:
            asked.append(("created_ats[gte]", _stamp(window.since)))
        if window.until:
            asked.append(("created_ats[lt]", _stamp(_whole(window.until, up=True))))
        return f"{PATH}?{urllib.parse.urlencode(asked)}"

    def _page(self, path: str) -> dict:
        """One page; failures that may pass are tried again."""
        headers = {"Accept": "application/json"} | ({"Authorization": f"bearer {self.token}"} if self.token else {})
        for attempt in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.endpoint + path, headers=headers), timeout=60) as answer:
                    body = json.load(answer)
                break
            except urllib.error.HTTPError as error:
                if attempt == self.tries or error.code not in (429, 500, 502, 503, 504):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.tries:
                    raise
            time.sleep(0.2 * 2**attempt)
        if not isinstance(body, dict) or body.get("errors"):
            errors = body.get("errors") if isinstance(body, dict) else body
            told = [": ".join(str(e[k]) for k in ("title", "detail") if e.get(k)) or f"code {e.get('code')}" for e in errors if isinstance(e, dict)] if isinstance(errors, list) else [str(errors)]
            raise RuntimeError("the audit service answers: " + "; ".join(told))
        if not isinstance(body.get("resources"), list):
            raise RuntimeError("the audit service's answer has no list of resources")
        return body

    def read(self, partition: Window) -> Iterator[tuple]:
        path, given = self._first(partition), 0
        while path:
            body = self._page(path)
            for resource in body["resources"]:
                row = _row(resource)
                # the service rounds bounds: windows that end within a second must not overlap
                if row[2] is not None and (partition.since and row[2] < partition.since or partition.until and row[2] >= partition.until):
                    continue
                yield row
                given += 1
                if given == self.limit:
                    return
            path = _next(body)


def _next(body: dict) -> str | None:
    """Path and query of the next page: the host stays the one that was asked."""
    following = (body.get("pagination") or {}).get("next") or {}
    url = urllib.parse.urlsplit(following.get("href") or "")
    return (f"{url.path}?{url.query}" if url.query else url.path) if url.netloc else None


def _row(resource: object) -> tuple:
    r = resource if isinstance(resource, dict) else {}
    text = lambda x: x if isinstance(x, str) else ""
    at = lambda k: r[k] if isinstance(r.get(k), dict) else {}
    entity = lambda k: tuple(text(at(k).get(c)) for c in ("guid", "type", "name"))
    return (
        text(r.get("guid")), text(r.get("type")), _time(r.get("created_at")), _time(r.get("updated_at")), entity("actor"), entity("target"),
        json.dumps(at("data"), ensure_ascii=False, sort_keys=True), at("space").get("guid") or None, at("organization").get("guid") or None,
    )


class AuditEvents(DataSource):
    """format("audit_events") with options endpoint, guid, scope (app or space), token, since, until, windows, limit, tries.

    since and until (ISO times; until is not included) make `windows` partitions of equal
    length, else there is one. A partition follows next links until no page or `limit` rows are
    left, newest first; whatever has no valid time comes along unless Spark tests times. Errors
    that the service reports end the job, overload and lost connections are tried again. Equality and
    lists of types and bounds of created_at are asked of the service, which needs
    spark.sql.python.filterPushdown.enabled: `register` sets it for the session.
    """

    @classmethod
    def name(cls) -> str:
        return "audit_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets its filters go down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AuditEvents)


def newest(spark: SparkSession, most: int, types: list[str] | None = None, **options: str) -> DataFrame:
    """The `most` newest events: no partition asks for more, and only these meet to be merged."""
    register(spark)
    rows = spark.read.format("audit_events").options(limit=str(most), **options).load()
    rows = rows.where(F.col("type").isin(types)) if types else rows
    return rows.orderBy(F.desc_nulls_last("created_at"), "guid").limit(most)
