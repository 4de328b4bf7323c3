"""Secret scans: single secrets by pattern, and credentials whose parts stand near each other."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.llm.common import arrow_map, written

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]
MIN_ENTROPY = 3.5
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
NAMED_ID = r"""(?ai:client|app|account|access_key|user)[_-]?(?ai:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})"""
UPPER_ID = r"(?<![A-Za-z0-9])[A-Z0-9]{16,32}(?![A-Za-z0-9])"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"
URL = r"[a-z][a-z0-9+]{1,20}://[^\s\"'<>]+"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9])"
PART = "struct<kind:string,start:int,stop:int,scope:int>"


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def scan_text(text: str, patterns: dict[str, re.Pattern]) -> tuple[list[tuple], list[tuple]]:
    """Base spans and weak parts ``(kind, start, stop)`` of a whole text, in code points."""
    base, weak = [], []
    lower = text.lower() if ":" in text or "=" in text else ""
    if any(w in lower for w in WORDS):
        base += [("assign", *m.span()) for m in patterns["assign"].finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in patterns["access"].finditer(text) if len(m[0]) >= 20]
    base += [("hex", *m.span()) for m in patterns["hex"].finditer(text)]
    if "id" in lower or "name" in lower:
        weak += [("identifier", *m.span(1)) for m in patterns["named_id"].finditer(text)]
    weak += [("identifier", *m.span()) for m in patterns["upper_id"].finditer(text) if re.search("[0-9].*[0-9]", m[0]) and re.search("[A-Z]", m[0])]
    weak += [("secret", *m.span()) for m in patterns["opaque"].finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= MIN_ENTROPY]
    if "://" in text:
        weak += [("endpoint", *m.span()) for m in patterns["url"].finditer(text)]
    weak += [("endpoint", *m.span()) for m in patterns["address"].finditer(text)]
    return base, _free(weak, base)


def _free(weak: list[tuple], base: list[tuple]) -> list[tuple]:
    """Weak parts that overlap no base span, by one sweep over both."""
    out, taken, k, reach = [], sorted((s, e) for _, s, e in base), 0, -1
    for kind, start, stop in sorted(set(weak), key=lambda p: (p[1], p[2])):
        while k < len(taken) and taken[k][0] < stop:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= start:
            out.append((kind, start, stop))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, base, weak)`` per row of ``docs(doc_id, text)``; parts carry the number of their scope.

    Scopes are the stretches between blank lines.
    """
    part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("scope", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", part), ("weak", part)])
    sources = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "named_id": NAMED_ID, "upper_id": UPPER_ID, "opaque": OPAQUE, "url": URL, "address": ADDRESS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        patterns = {k: re.compile(p) for k, p in sources.items()}
        blank = re.compile(r"\n[ \t\r]*\n")

        def scoped(parts: list[tuple], text: str) -> list[dict]:
            ends = [m.start() for m in blank.finditer(text)] if parts else []
            out, k = [], 0
            for kind, start, stop in sorted(parts, key=lambda p: p[1]):
                while k < len(ends) and ends[k] <= start:
                    k += 1
                out.append({"kind": kind, "start": start, "stop": stop, "scope": k})
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [scan_text(t, patterns) for t in texts]
            yield {
                "doc_id": batch.column("doc_id"),
                "base": [scoped(b, t) for (b, _), t in zip(found, texts)],
                "weak": [scoped(w, t) for (_, w), t in zip(found, texts)],
            }

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = arrow_map(rows, run, schema, f"doc_id long, base array<{PART}>, weak array<{PART}>")
    return out.withColumn("row", F.monotonically_increasing_id())


def linked(scanned: DataFrame) -> DataFrame:
    """Weak parts that complete a credential: ``(row, kind, start, stop)``.

    Within a scope, however far apart, every part meets the nearest complementary parts before and behind it: one sorted pass
    over the parts of a scope, in which no pairs are formed. Secrets are weak, assigned or hexadecimal ones, identifiers weak or access
    ones. An identifier counts with a secret, a weak secret with an identifier or an endpoint, an endpoint with a secret that
    has an identifier too.
    """
    parts = scanned.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("p")).select(
        "row", "p.*", F.when(F.col("p.kind").isin("assign", "hex", "secret"), "secret").when(F.col("p.kind").isin("access", "identifier"), "identifier").otherwise("endpoint").alias("part"))
    sweep = Window.partitionBy("row", "scope").orderBy("start", "stop", "kind")
    before, behind = sweep.rowsBetween(Window.unboundedPreceding, -1), sweep.rowsBetween(1, Window.unboundedFollowing)

    def nearest(part: str) -> Column:
        place = F.when(F.col("part") == part, F.col("start"))
        return F.coalesce(F.last(place, ignorenulls=True).over(before), F.first(place, ignorenulls=True).over(behind))

    met = parts.withColumn("secret", nearest("secret")).withColumn("identifier", nearest("identifier")).withColumn("endpoint", nearest("endpoint"))
    counts = (
        F.when(F.col("kind") == "identifier", F.col("secret").isNotNull())
        .when(F.col("kind") == "secret", F.coalesce("identifier", "endpoint").isNotNull())
        .when(F.col("kind") == "endpoint", F.col("secret").isNotNull() & F.col("identifier").isNotNull())
    )
    return met.where(counts).select("row", "kind", "start", "stop")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` per row of ``docs(doc_id, text)``: arrays of ``(start, rank, kind, stop)``, sorted.

    ``base`` has the spans found by pattern alone, ``spans`` those and the linked parts. A null or empty text has
    none; repeated rows have the same; other columns are not read. Scanned parts are a table in the shared folder.
    """
    scanned = written(scan(docs), "secrets")
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    entry = lambda kind, start, stop: F.struct(start.alias("start"), rank(kind).alias("rank"), kind.alias("kind"), stop.alias("stop"))
    more = linked(scanned).groupBy("row").agg(F.collect_list(entry(F.col("kind"), F.col("start"), F.col("stop"))).alias("more"))
    base = F.transform("base", lambda p: entry(p["kind"], p["start"], p["stop"]))
    spans = F.when(F.col("more").isNull(), base).otherwise(F.concat(base, "more"))
    return scanned.join(more, "row", "left").select("doc_id", F.sort_array(base).alias("base"), F.sort_array(spans).alias("spans"))


def span_text(spans: str) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
