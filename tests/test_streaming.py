"""Streams give what the batch forms give."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Row

from filingdelta.operators.classify import Lexicon
from filingdelta.streaming import intake, retention, status


def test_intake_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes("%PDF-1 annual report".encode())
    (folder / "b.pdf").write_bytes(b"%PDF-1 \xff\xfe other")
    (folder / "c.txt").write_bytes(b"annual")
    lexicon = Lexicon.of(spark, {"annual": ["annual"]}, {"annual": "Annual"})
    out, mark = os.path.join(tmp_path, "out"), os.path.join(tmp_path, "mark")

    def run():
        intake.run_intake(intake.file_stream(spark, str(folder)), lexicon, out, mark).awaitTermination()
        return {r.filename: (r.status, r.detected_type, r.processing_status, r.queueable) for r in spark.read.parquet(out).collect()}

    assert run() == {
        "a.pdf": ("accepted", "annual", "queued", True), "b.pdf": ("accepted", None, "pending_classification", False), "c.txt": ("rejected", None, "rejected", False),
    }
    (folder / "d.pdf").write_bytes(b"%PDF annual")
    assert len(run()) == 4 and spark.read.parquet(out).count() == 4


def test_status_stream(spark, tmp_path):
    schema = "document_id string, ts timestamp, event_id long, processing_status string"
    start = dt.datetime(2024, 1, 1)
    rows = [(str(i % 7), start + dt.timedelta(minutes=(i * 37) % 50), i, f"s{i % 5}") for i in range(200)]
    source = os.path.join(tmp_path, "events")
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = os.path.join(tmp_path, "log")
    status.run_status(stream, out, os.path.join(tmp_path, "mark")).awaitTermination()
    batch = {tuple(r) for r in status.latest_status(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r) for r in status.current_status(spark.read.parquet(out)).collect()} == batch
    assert {tuple(r) for r in status.current_status(status.read_log(spark, out)).collect()} == batch
    before = len(os.listdir(out))
    status.compact_log(spark, out)
    status.compact_log(spark, out)
    assert before >= 4 and len(os.listdir(out)) == 1 and status.read_log(spark, out).count() == 7
    # A late event and a new one after the compaction.
    more = [("0", start - dt.timedelta(days=9), 900, "late"), ("new", start, 901, "s")]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    status.run_status(stream, out, os.path.join(tmp_path, "mark")).awaitTermination()
    wanted = {tuple(r) for r in status.latest_status(spark.createDataFrame(rows + more, schema)).collect()}
    assert {tuple(r) for r in status.current_status(status.read_log(spark, out)).collect()} == wanted
    last = {}
    for d, ts, i, s in rows:
        last[d] = max(last.get(d, (ts, i, s)), (ts, i, s))
    assert {(r[0], r[1]) for r in batch} == {(d, v[2]) for d, v in last.items()}


def test_expiry(spark, tmp_path):
    now = "2024-01-02T00:00:00"
    times = {"edge": "2024-01-01T00:00:00Z", "old": "2023-12-31T23:59:59.999Z", "zone": "2023-12-30T00:00:00+00:00", "naive": "2023-12-30T00:00:00", "bad": "yesterday", "none": None, "new": "2024-01-01T12:00:00Z"}
    df = spark.createDataFrame(list(times.items()), "document_id string, created_at string")
    old = {r.document_id for r in retention.expired(df, now).collect()}
    assert old == {"old", "zone", "naive"}
    assert {r.document_id for r in retention.kept(df, now).collect()} == set(times) - old


def test_expiry_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(str(i), start + dt.timedelta(hours=i)) for i in range(60)]
    source = os.path.join(tmp_path, "created")
    for k in range(6):
        spark.createDataFrame(rows[k * 10:k * 10 + 10], "document_id string, created_at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("document_id string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = os.path.join(tmp_path, "out")
    retention.run_expiry(stream, out, os.path.join(tmp_path, "mark")).awaitTermination()
    got = sorted(int(r.document_id) for r in spark.read.parquet(out).collect())
    assert got == [i for i in range(60) if i < 59 - 24]


def test_expiry_reports_once_and_forgets(spark, tmp_path):
    """Repeated records are reported once; what is written, and kept, follows what falls due, not what is waiting."""
    base, source, out, mark = dt.datetime(2024, 1, 10), *(os.path.join(tmp_path, n) for n in ("created", "out", "mark"))
    hour = lambda n: base + dt.timedelta(hours=n)
    schema = "document_id string, created_at timestamp"
    batches = [
        [("a", hour(0)), ("b", hour(1)), ("c", hour(1))],
        [("a", hour(20)), ("b", hour(-3)), ("now", hour(22))],  # b is older than first told, a is not younger
        [("a", hour(0)), ("b", hour(1)), ("now", hour(26))],    # a and c fall due, b is told again
        [("a", hour(0)), ("c", hour(1)), ("now", hour(27))],
        [("now2", hour(80))],
    ]
    rows = lambda n: sorted((r.document_id, r.created_at) for r in spark.read.parquet(out).where(f"batch >= {n}").collect())
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        retention.run_expiry(stream, out, mark).awaitTermination()
    assert rows(0) == [("a", hour(0)), ("b", hour(-3)), ("c", hour(1)), ("now", hour(22))]
    assert spark.conf.get(retention.STATE_STORE) != retention.KEYED_STATE
    state = spark.read.format("statestore").option("stateVarName", "document").option("path", mark).load()
    assert {r.key.document_id for r in state.select("key").collect()} == {"now", "now2"}


def test_expiry_of_late_records(spark, tmp_path):
    """A record that is too old when a later batch brings it is reported as well."""
    now, source = dt.datetime(2024, 1, 10), os.path.join(tmp_path, "created")
    old, young = now - dt.timedelta(hours=30), now - dt.timedelta(hours=2)
    for rows in ([("1", old), ("2", old), ("new", now)], [("3", old), ("4", young), ("none", None)], [("5", old)]):
        spark.createDataFrame(rows, "document_id string, created_at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("document_id string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = os.path.join(tmp_path, "out")
    retention.run_expiry(stream, out, os.path.join(tmp_path, "mark")).awaitTermination()
    assert sorted(r.document_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "5"]


class _Handle:
    """Keyed state of one task in plain Python; every call counts."""

    def __init__(self):
        self.values, self.timers, self.key, self.calls = {}, set(), None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.values.get(self.key)

    def exists(self):
        self.calls += 1
        return self.key in self.values

    def update(self, value):
        self.calls += 1
        self.values[self.key] = value

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add((ms, self.key))


class _Times:
    def getCurrentWatermarkInMs(self):
        return 0


def test_old_records_wait_for_no_timer():
    """A newer record of the same task proves that a record is too old: three state calls, and no timer fires for it."""
    hour = 3_600_000
    handle, processor = _Handle(), retention.Retention(24)
    processor.init(handle)

    def told(name, *hours):
        handle.key, handle.calls = (0, name), 0
        out = list(processor.handleInputRows(handle.key, iter([Row(created_us=h * hour * 1000) for h in hours]), _Times()))
        return [(r.document_id, r.created_us // (hour * 1000)) for r in out], handle.calls

    assert told("new", 40) == ([], 3)
    assert told("old", 12, 10) == ([("old", 10)], 3)
    assert told("edge", 16) == ([], 3)
    assert told("old", 3) == ([], 1)
    assert handle.timers == {(64 * hour + 1, (0, "new")), (40 * hour + 1, (0, "edge")), (64 * hour, (0, "old"))}


class _Store:
    """Keyed state of one task in plain Python, with lists; writes and reads that leave the task count as calls."""

    def __init__(self):
        self.values, self.timers, self.key, self.calls = {}, set(), None, 0

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def get(self):
        self.calls += 1
        return iter(self.values.get(self.key, [])) if isinstance(self.key[0], str) else self.values.get(self.key)

    def update(self, value):
        self.calls += 1
        self.values[self.key] = value

    put = update

    def appendValue(self, value):
        self.update([*self.values.get(self.key, []), value])

    def clear(self):
        self.calls += 1
        self.values.pop(self.key, None)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add((ms, self.key))

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard((ms, self.key))


class _Task:
    """A processor with its keyed state, run by micro-batch."""

    def __init__(self, processor):
        self.processor, self.store = processor, _Store()
        processor.init(self.store)

    def run(self, groups, watermark):
        times, out = type("Times", (), {"getCurrentWatermarkInMs": lambda _: watermark})(), []
        self.processor.newest_ms = 0  # a micro-batch has new tasks
        for key, rows in sorted(groups.items()):
            self.store.key = key
            out += self.processor.handleInputRows(key, iter(rows), times)
        for ms, key in sorted(t for t in self.store.timers if t[0] <= watermark):
            self.store.key = key
            info = type("Info", (), {"getExpiryTimeInMs": lambda _, ms=ms: ms})()
            out += self.processor.handleExpiredTimer(key, times, info)
            self.store.timers.discard((ms, key))
        return out


class _Stream:
    """Pages and the documents' own states, in two tasks each, as the stream chains them."""

    def __init__(self, hours):
        self.pages = [_Task(retention.Pages(hours, "string")) for _ in range(2)]
        self.own = [_Task(retention.Waiting(hours)) for _ in range(2)]
        self.watermark = 0

    def run(self, rows):
        dealt, told, out = [{}, {}], [{}, {}], []
        for d, ms in rows:
            page = int(d[1:]) % 5
            dealt[page % 2].setdefault((f"page {page}",), []).append(Row(document_id=d, created_us=ms * 1000))
        for task, groups in zip(self.pages, dealt):
            for r in task.run(groups, self.watermark):
                key = (0, r.document_id) if r.documents is None else (1, "")
                told[(int(r.document_id[1:]) if r.documents is None else 0) // 5 % 2].setdefault(key, []).append(r)
        for task, groups in zip(self.own, told):
            out += [(d, us // 1000) for r in task.run(groups, self.watermark) for d, us in zip(r.documents, r.created)]
        self.watermark = max([self.watermark, *(ms for _, ms in rows)])
        return sorted(out)

    def marks(self):
        return {d: m for t in self.pages for t.store.key in t.store.values for d, m in t.processor._known()[0].items()}


def test_pages_leave_documents_as_states_of_their_own_report_them():
    """Against one plain state for each document: the same reports in the same micro-batches, and nothing is left behind."""
    rng, hours, keep = random.Random(5), 1, 3_600_000
    for _ in range(20):
        stream, plain, clock = _Stream(hours), {}, 10 * keep
        for n in range(120):
            watermark = stream.watermark
            if n % 2:  # old and young records, none newer than the watermark
                rows = [(f"d{rng.randrange(40)}", watermark - rng.choice([0, 1, keep, keep + 1, rng.randrange(3 * keep)])) for _ in range(rng.randrange(12))]
            else:
                clock += rng.choice([1, keep // 7, keep // 2, keep, keep + 1, 3 * keep])
                rows = [(f"d{100 + n}", clock)]
            want = []

            def report(d, created):
                plain[d] = (None, watermark + keep)
                want.append((d, created))

            for d in {d for d, _ in rows}:
                created = min(ms for e, ms in rows if e == d)
                if d in plain and (plain[d][0] is None or plain[d][0] <= created):
                    continue
                if created + keep + 1 <= watermark:
                    report(d, created)
                else:
                    plain[d] = (created, created + keep + 1)
            for d, (created, due) in [*plain.items()]:
                if due <= watermark and created is None:
                    del plain[d]
                elif due <= watermark:
                    report(d, created)
            assert stream.run(rows) == sorted(want)
        for _ in range(3):
            clock += 5 * keep
            stream.run([("d999", clock)])
        assert set(stream.marks()) == {"d999"}


def test_pages_know_the_documents_that_have_a_state():
    """Whatever a task has met: no document that a page reported has a state, and a page knows each that has one."""
    rng, keep = random.Random(6), 3_600_000
    for _ in range(20):
        stream, clock = _Stream(1), 10 * keep
        for _ in range(100):
            clock += rng.choice([0, 1, keep // 3, keep, 4 * keep])
            stream.run([(f"d{rng.randrange(30)}", clock - rng.choice([0, keep, keep + 1, rng.randrange(3 * keep)])) for _ in range(rng.randrange(8))])
            marks = stream.marks()
            for task in stream.own:
                assert all(marks[d][1] != retention.Pages.REPORTED for _, d in task.store.values)


def test_old_documents_need_few_state_calls():
    """A page of old documents takes as many calls as one of them; later records of them write nothing."""
    hour = 3_600_000_000
    page = lambda *rows: (task := _Task(retention.Pages(24, "string")), [r for r in task.run({("page",): [Row(document_id=d, created_us=us) for d, us in rows]}, 100 * hour // 1000)])
    one, out = page(("a", hour))
    assert [(r.documents, r.created) for r in out] == [(["a"], [hour])]
    many, out = page(*((f"{i}", hour + i) for i in range(1000)), ("7", 5))
    assert len(out) == 8 and sorted(zip((d for r in out for d in r.documents), (c for r in out for c in r.created))) == sorted((f"{i}", hour + i if i != 7 else 5) for i in range(1000))
    assert one.store.calls == many.store.calls == 3
    again = [Row(document_id=f"{i}", created_us=99 * hour) for i in range(1000)]
    assert many.run({("page",): again}, 100 * hour // 1000) == [] and many.store.calls == 4


def test_page_entries_are_joined():
    """Many small micro-batches leave a page with few entries, and every document in it as it was."""
    hour, task = 3_600_000, _Task(retention.Pages(24, "string"))
    for i in range(100):
        task.run({("page",): [Row(document_id=f"{i}", created_us=0), Row(document_id="w", created_us=(100 * hour + i) * 1000)]}, 100 * hour + i)
        task.store.key = ("page",)
        assert len(task.store.values[("page",)]) <= retention.PAGE_ENTRIES
    known, _ = task.processor._known()
    assert known == {f"{i}": (124 * hour + i, 0) for i in range(100)} | {"w": (126 * hour, 2)}


@pytest.mark.parametrize("pages", [{}, {"pages": 7}])
def test_expiry_stream_keeps_states_for_waiting_documents_only(spark, tmp_path, pages):
    """Documents that are too old on arrival are reported and remembered without states and timers of their own."""
    now, schema = dt.datetime(2024, 1, 10), "document_id string, created_at timestamp"
    old = [(f"o{i}", now - dt.timedelta(hours=25, seconds=i)) for i in range(300)] + [(None, now - dt.timedelta(hours=30))]
    young = [(f"y{i}", now - dt.timedelta(hours=23, seconds=i)) for i in range(5)]
    out, mark, source = (os.path.join(tmp_path, n) for n in ("out", "mark", "created"))
    for rows in ([("now", now)], old + young, old[::-1] + young):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        retention.run_expiry(stream, out, mark, **pages).awaitTermination()
    key = lambda r: (r[0] or "", r[1])
    assert sorted(((r.document_id, r.created_at) for r in spark.read.parquet(out).collect()), key=key) == sorted(old, key=key)
    state = spark.read.format("statestore").option("stateVarName", "document").option("path", mark).load()
    assert {r.key.document_id for r in state.select("key").collect()} == {"now"} | {d for d, _ in young}


def test_expiry_of_documents_with_times_as_ids(spark, tmp_path):
    """Ids that reach Python in more than one form are reported once as well."""
    now, out = dt.datetime(2024, 1, 10), os.path.join(tmp_path, "out")
    rows, source = [(now, now)] + [(now + dt.timedelta(days=i), now - dt.timedelta(hours=25)) for i in range(1, 9)], os.path.join(tmp_path, "created")
    for _ in range(2):
        spark.createDataFrame(rows, "document_id timestamp, created_at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("document_id timestamp, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    retention.run_expiry(stream, out, os.path.join(tmp_path, "mark")).awaitTermination()
    assert sorted((r.document_id, r.created_at) for r in spark.read.parquet(out).collect()) == rows[1:]
