"""Retention: documents older than the limit, as a batch and as a stream."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BinaryType, BooleanType, DateType, DecimalType, IntegralType, StringType

RETENTION_HOURS = 24
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Documents are dealt to so many pages by their hash; a page is read and written at once.
PAGES = 4_096
# A page with more entries than this is written anew as one.
PAGE_ENTRIES = 32
# Documents that one row carries past the documents' own states.
CARRIED = 128
# Types of ids that Python finds equal however they reached it; documents with others have states of their own only.
PAGED_IDS = (BinaryType, BooleanType, DateType, DecimalType, IntegralType, StringType)


def created_time(text: Column) -> Column:
    """ISO time without its zone mark; null when it cannot be read."""
    bare = F.replace(F.replace(text, F.lit("Z"), F.lit("")), F.lit("+00:00"), F.lit(""))
    return bare.try_cast("timestamp")


def expired(records: DataFrame, now: str, hours: int = RETENTION_HOURS) -> DataFrame:
    """Records created before ``now`` minus the retention; unreadable times never expire."""
    cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return records.where(created_time(F.col("created_at")) < cutoff)


def kept(records: DataFrame, now: str, hours: int = RETENTION_HOURS) -> DataFrame:
    """Records left after the sweep: one projection, no join."""
    cutoff = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return records.where(F.coalesce(created_time(F.col("created_at")) >= cutoff, F.lit(True)))


class Retention(StatefulProcessor):
    """The state of one document: its creation, until a timer reports it; then, as long again, that it was reported."""

    def __init__(self, hours: int) -> None:
        self.keep_ms = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The newest creation among the rows this task has met: the present is no earlier.
        self.newest_ms = 0
        self.document = handle.getValueState("document", "created_us long, timer_ms long, reported boolean")

    def _report(self, key: tuple, created_us: int, now_ms: int) -> Iterator[Row]:
        """A document that is reported again within the retention is reported once only."""
        forget = now_ms + self.keep_ms
        self.document.update((created_us, forget, True))
        self.handle.registerTimer(forget)
        yield Row(document_id=key[1], created_us=created_us)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        told = [row.created_us for row in rows]
        created_us = min(told)
        self.newest_ms = max(self.newest_ms, max(told) // 1000)
        known = self.document.get()
        if known is not None:
            if known[2] or known[0] <= created_us:
                return
            self.handle.deleteTimer(known[1])
        # The first millisecond at which the creation is longer ago than the retention.
        due_ms, now_ms = created_us // 1000 + self.keep_ms + 1, max(self.newest_ms, timerValues.getCurrentWatermarkInMs())
        if due_ms <= now_ms:
            yield from self._report(key, created_us, now_ms)
        else:
            self.document.update((created_us, due_ms, False))
            self.handle.registerTimer(due_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        known = self.document.get()
        if known is None or known[1] != expiredTimerInfo.getExpiryTimeInMs():
            return
        if known[2]:
            self.document.clear()
        else:
            yield from self._report(key, known[0], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Waiting(Retention):
    """The states of the documents that pages tell; what pages have reported goes through as it is."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        told = []
        for row in rows:
            if row.documents is None:
                told.append(row)
            else:
                yield Row(documents=row.documents, created=row.created)
        if told:
            yield from self._carried(super().handleInputRows(key, told, timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        yield from self._carried(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def _carried(self, reports: Iterator[Row]) -> Iterator[Row]:
        for report in reports:
            yield Row(documents=[report.document_id], created=[report.created_us])


class Pages(StatefulProcessor):
    """A page of documents: those reported on arrival, remembered for the retention, and those that have a state of their own.

    A document that is unknown and too old is reported here, without a state and timer of its own. All other records are told
    to the document's own state, which alone knows when it falls due and whether it was reported; here stands only that it may
    exist. It does until TOLD, a retention after the last record, has passed (by then the document fell due), and FADING, a
    retention after that, has as well (by then its report is forgotten). These two may last longer, so they are rounded up to
    parts of the retention. A page has one timer for each different time.
    """

    REPORTED, FADING, TOLD = range(3)

    def __init__(self, hours: int, id_type: str) -> None:
        self.keep_ms, self.id_type = hours * 3_600_000, id_type
        self.step_ms = max(1, self.keep_ms // 8)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The newest creation among the rows this task has met: the present is no earlier.
        self.newest_ms = 0
        # An entry holds runs of documents that share a time and a kind; the last entry of a document counts.
        self.entries = handle.getListState("entries", f"until_ms array<long>, kinds array<int>, counts array<int>, documents array<{self.id_type}>")

    def _known(self) -> tuple[dict, int]:
        known, n = {}, 0
        for n, (until_ms, kinds, counts, documents) in enumerate(self.entries.get(), 1):
            rest = iter(documents)
            for until, kind, count in zip(until_ms, kinds, counts, strict=True):
                known.update(dict.fromkeys(islice(rest, count), (until, kind)))
        return known, n

    def _rounded(self, ms: int) -> int:
        return -(-ms // self.step_ms) * self.step_ms

    @staticmethod
    def _entry(known: dict) -> tuple:
        runs = defaultdict(list)
        for document, mark in known.items():
            runs[mark].append(document)
        return [u for u, _ in runs], [k for _, k in runs], [len(r) for r in runs.values()], [d for r in runs.values() for d in r]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        oldest, newest_us = {}, self.newest_ms * 1000
        for row in rows:
            created_us = row.created_us
            newest_us = max(newest_us, created_us)
            if created_us <= oldest.get(row.document_id, created_us):
                oldest[row.document_id] = created_us
        self.newest_ms = newest_us // 1000
        now_ms = max(self.newest_ms, timerValues.getCurrentWatermarkInMs())
        reported, told = (now_ms + self.keep_ms, self.REPORTED), (self._rounded(now_ms + self.keep_ms + 1), self.TOLD)
        known, n = self._known()
        new, documents = {}, []
        for document, created_us in oldest.items():
            mark = known.get(document)
            if mark is None and created_us // 1000 + self.keep_ms + 1 <= now_ms:
                new[document] = reported
                documents.append(document)
            elif mark is None or mark[1] != self.REPORTED:
                if mark != told:
                    new[document] = told
                yield Row(page=key[0], document_id=document, created_us=created_us, documents=None, created=None)
        for k in range(0, len(documents), CARRIED):
            some = documents[k:k + CARRIED]
            yield Row(page=key[0], document_id=None, created_us=None, documents=some, created=[oldest[d] for d in some])
        if new:
            if n < PAGE_ENTRIES:
                self.entries.appendValue(self._entry(new))
            else:
                self.entries.put([self._entry(known | new)])
            for until in {u for u, _ in new.values()} - {u for u, _ in known.values()}:
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        known, _ = self._known()
        left = {d: m for d, m in known.items() if m[0] > now_ms}
        fading = (self._rounded(now_ms + self.keep_ms), self.FADING)
        left |= {d: fading for d, (until, kind) in known.items() if until <= now_ms and kind == self.TOLD}
        if left == known:
            return
        if left:
            self.entries.put([self._entry(left)])
        else:
            self.entries.clear()
        if fading in left.values():
            self.handle.registerTimer(fading[0])
        yield from ()

    def close(self) -> None:
        pass


def run_expiry(created: DataFrame, out: str, checkpoint: str, hours: int = RETENTION_HOURS, pages: int = PAGES) -> StreamingQuery:
    """Documents whose age passes the retention while the stream's time goes on, written to ``out`` by micro-batch.

    ``created``: streaming (document_id, created_at timestamp), the earliest creation of a document counts; the newest one seen is
    the present. Each document that waits has a keyed state and an event-time timer, so a micro-batch touches the pages of
    the documents it brings and those that fall due, whatever number is waiting. A record that is too old on arrival is
    reported at once by its page, with neither: too old for the watermark, or for a newer record that its task has met in
    the same micro-batch; the time column that reaches the states is no watermark column, so no late record is dropped.
    Pages and keys go by a hash, so a task meets new and old records in any order of ids. A reported document is
    remembered for the retention, then its state goes. Times count in milliseconds of the present; a null time never expires.
    """
    spark = created.sparkSession
    timed = created.select("document_id", "created_at").where(F.col("created_at").isNotNull()).withWatermark("created_at", "0 seconds")
    page = F.pmod(F.xxhash64("document_id"), F.lit(pages))
    rows = timed.select(page.alias("page"), "document_id", F.unix_micros("created_at").alias("created_us"))
    id_type = created.schema["document_id"].dataType.simpleString()
    carried = f"documents array<{id_type}>, created array<long>"
    if isinstance(created.schema["document_id"].dataType, PAGED_IDS):
        paged = rows.groupBy("page").transformWithState(
            statefulProcessor=Pages(hours, id_type), outputStructType=f"page long, document_id {id_type}, created_us long, {carried}", outputMode="Append", timeMode="EventTime"
        )
    else:
        paged = rows.withColumns({"documents": F.lit(None).cast(f"array<{id_type}>"), "created": F.lit(None).cast("array<long>")})
    key = F.when(F.col("documents").isNull(), F.xxhash64("document_id")).otherwise(F.col("page"))
    due = paged.select(key.alias("document_hash"), "document_id", "created_us", "documents", "created").groupBy("document_hash", "document_id").transformWithState(
        statefulProcessor=Waiting(hours), outputStructType=carried, outputMode="Append", timeMode="EventTime"
    )

    def write(batch: DataFrame, number: int) -> None:
        reports = batch.select(F.inline(F.arrays_zip("documents", "created")).alias("document_id", "created_us"))
        reported = reports.select("document_id", F.timestamp_micros("created_us").alias("created_at"))
        reported.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, KEYED_STATE)
    try:
        return due.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)
