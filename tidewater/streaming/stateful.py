"""Streams that keep state by key: entries that grow over micro-batches, and the last rows of each key.

State lives in RocksDB state stores under the query's checkpoint, one value or list a key, so
a restart goes on where the last finished micro-batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewater.operators import logs

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "id long, pos long, head string, rest array<string>, n_lines long"
#: Rows and characters of raw text that are kept of an application's log.
KEEP_ROWS, KEEP_CHARS = 300, 360_000


def use_rocksdb(spark: SparkSession) -> None:
    """State by key needs this state store; it holds for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _Entries(StatefulProcessor):
    """Lines of one key in order of pos: the entries so far, of which the last is open to further lines."""

    def __init__(self, keep_rows: int, keep_chars: int, idle_ms: int | None, closed_only: bool):
        self.keep_rows, self.keep_chars, self.idle_ms, self.closed_only = keep_rows, keep_chars, idle_ms, closed_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # told: how many lines of the open entry have been given out
        self.place = handle.getValueState("place", "next_id long, last_pos long, told long")
        self.rows = handle.getListState("rows", _ENTRY)
        self.text = handle.getValueState("text", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lines = pd.concat(list(rows)).sort_values("pos", kind="stable").drop_duplicates("pos")
        next_id, last_pos, told = self.place.get() if self.place.exists() else (1, None, 0)
        if last_pos is not None:
            lines = lines[lines["pos"] > last_pos]
        if lines.empty:
            return
        kept = [[*r[:3], list(r[3]), r[4]] for r in self.rows.get()]
        given: list[tuple] = []
        for pos, raw_line, dropped, header in zip(lines["pos"], lines["line"], lines["dropped"], lines["header"]):
            if dropped:
                continue
            line = raw_line.strip(logs.WHITE)
            if header or not kept:
                if kept and kept[-1][4] > told:
                    given.append((*kept[-1], told))
                kept.append([next_id, int(pos), line if header else None, [] if header else [line], 1])
                next_id, told = next_id + 1, 0
                if len(kept) > self.keep_rows:
                    del kept[0]
            else:
                kept[-1][3].append(line)
                kept[-1][4] += 1
        if kept and kept[-1][4] > told and not self.closed_only:
            given.append((*kept[-1], told))
            told = kept[-1][4]
        self.rows.put([tuple(r) for r in kept])
        self.place.update((next_id, int(lines["pos"].iloc[-1]), told))
        before = self.text.get()[0] + "\n" if self.text.exists() else ""
        self.text.update(((before + "\n".join(lines["line"]))[-self.keep_chars :],))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._out(key, given)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A key without lines for so long: its open entry is given out, and only that one is kept."""
        kept = [[*r[:3], list(r[3]), r[4]] for r in self.rows.get()][-1:]
        next_id, last_pos, told = self.place.get()
        given = [(*r, told) for r in kept if r[4] > told]
        self.rows.put([tuple(r) for r in kept])
        self.text.clear()
        self.place.update((next_id, last_pos, kept[-1][4] if kept else told))
        yield self._out(key, given)

    @staticmethod
    def _out(key, given: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(given, columns=["id", "pos", "head", "rest", "n_lines", "n_before"])
        found.insert(0, "app", pd.Series([key[0]] * len(found), dtype=object))
        return found

    def close(self) -> None:
        pass


def entries(
    lines: DataFrame, keep_rows: int = KEEP_ROWS, keep_chars: int = KEEP_CHARS, idle_ms: int | None = None, closed_only: bool = False
) -> DataFrame:
    """lines(app, pos, line), a stream -> (app, id, pos, timestamp_raw, source, stream, level, message, n_lines, n_before, message_before).

    An entry is a header line and the lines up to the next, over as many micro-batches as they
    take; ids count an application's entries from 1. Each micro-batch gives the entries that
    are new or have grown, with n_before, the number of their lines that were given before (0:
    new), and message_before, what the message was then (null: new). With `closed_only` an
    entry is given once: when the next header comes, or after `idle_ms` without a line.
    The last row of an (app, id) is what `logs.entries` gives for the same lines; source
    SYSTEM, levels and dropped lines are as there.

    A line at or below the last place of its application is a repeat and is passed over. State
    by application: its last `keep_rows` entries and `keep_chars` characters of raw text
    (`tail_rows`, `tail_text`); after `idle_ms` without lines only the open entry is kept.
    Lines of one application are one task's, as their order demands. A null line counts as empty.
    """
    told = lines.select("app", F.col("pos").cast("long").alias("pos"), F.coalesce("line", F.lit("")).alias("line"))
    told = told.select("*", logs.is_system(F.col("line")).alias("dropped"), logs.is_header(logs.trimmed(F.col("line"))).alias("header"))
    kind = told.schema["app"].dataType.simpleString()
    processor = _Entries(keep_rows, keep_chars, idle_ms, closed_only)
    found = told.groupBy("app").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"app {kind}, {_ENTRY}, n_before long", outputMode="Append" if closed_only else "Update", timeMode="None" if idle_ms is None else "ProcessingTime",
    )
    known = F.slice("rest", F.lit(1), F.greatest(F.lit(0), F.col("n_before") - F.col("head").isNotNull().cast("long")).cast("int"))
    before = F.when(F.col("n_before") > 0, entry_message(F.col("head"), known))
    return found.select("app", "id", "pos", *logs.entry_fields(F.col("head"), F.col("rest")), "n_lines", "n_before", before.alias("message_before"))


def entry_message(head, rest):
    return logs.entry_fields(head, rest)[-1]


def only_new(found: DataFrame) -> DataFrame:
    """Each entry once, as it first came: an entry that grows later is not given again."""
    return found.where("n_before = 0")


def newly_visible(found: DataFrame, visible: Callable) -> DataFrame:
    """Entries that a filter over (level, message) lets through now and did not before they grew.

    `visible` maps a level and a message column to a condition. What an entry was before is
    judged by its earlier message and the level that its later one has not changed.
    """
    status = F.try_to_number(F.nullif(F.regexp_extract("message_before", logs.REQUEST, 3), F.lit("-")), F.lit("999")).cast("int")
    said = F.try_variant_get(logs.json_body(F.col("message_before")), "$.level", "string")
    level_before = logs.level(said, status, F.col("message_before"), F.col("stream"), F.col("source"))
    was = F.col("message_before").isNotNull() & F.coalesce(visible(level_before, F.col("message_before")), F.lit(False))
    return found.where(F.coalesce(visible(F.col("level"), F.col("message")), F.lit(False)) & ~was)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def tail_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(app, id, pos, timestamp_raw, source, stream, level, message, n_lines) that the state of a stream of entries holds."""
    kept = _state(spark, checkpoint, "rows").select(F.col("key.app").alias("app"), F.col("list_element.*"))
    return kept.select("app", "id", "pos", *logs.entry_fields(F.col("head"), F.col("rest")), "n_lines")


def tail_text(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(app, text): the last characters of each application's raw log that the state of a stream of entries holds."""
    return _state(spark, checkpoint, "text").select(F.col("key.app").alias("app"), F.col("value.text").alias("text"))


class _LastRows(StatefulProcessor):
    """The last rows of a key, as JSON texts with their places."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "pos long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = {int(pos): row for pos, row in self.rows.get()}
        for part in rows:
            for pos, row in zip(part["pos"], part["row"]):
                kept.setdefault(int(pos), row)
            if len(kept) > 4 * self.keep:
                kept = {p: kept[p] for p in sorted(kept)[-self.keep :]}
        last = [(p, kept[p]) for p in sorted(kept)[-self.keep :]]
        self.rows.put(last)
        found = pd.DataFrame(last, columns=["pos", "row"])
        found.insert(0, "app", pd.Series([key[0]] * len(found), dtype=object))
        yield found

    def close(self) -> None:
        pass


def last_rows(rows: DataFrame, keep: int = 1000) -> DataFrame:
    """rows(app, pos, ...), a stream -> the last `keep` rows by pos of each application that a micro-batch adds to.

    Rows of a place that is there already are repeats.
    """
    names = [c for c in rows.columns if c not in ("app", "pos")]
    packed = rows.select("app", F.col("pos").cast("long").alias("pos"), F.to_json(F.struct(*names)).alias("row"))
    kind, inner = rows.schema["app"].dataType.simpleString(), ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    found = packed.groupBy("app").transformWithStateInPandas(statefulProcessor=_LastRows(keep), outputStructType=f"app {kind}, pos long, row string", outputMode="Update", timeMode="None")
    return found.select("app", "pos", F.from_json("row", inner).alias("r")).select("app", "pos", "r.*")


def running_summary(events: DataFrame, summarise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keep: int = 1000) -> StreamingQuery:
    """After each micro-batch, the summary of the last `keep` events of every application that it adds to, as Parquet in `path`/batch=n.

    A micro-batch that is run again after a failure writes its own folder again, so none counts twice.
    """

    def put(found: DataFrame, batch: int) -> None:
        summarise(found).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return last_rows(events, keep).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
