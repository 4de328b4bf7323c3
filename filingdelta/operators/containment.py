"""Which of many needles stand in which of many texts, found over rare runs of characters instead of all pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.session import materialise

# Lengths of the runs that are looked up; a needle shorter than a length has no run of it.
GRAMS = (1, 2, 3)
# Up to so many different needles, of so many characters in all, travel to the texts.
FEW_NEEDLES, FEW_CHARS = 20_000, 4_000_000
# Bytes of a run, bits of its hash, and bytes of text that are looked through at once.
RUN, RUN_BITS, SLICE = 4, 20, 4 << 20


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """All different runs of so many characters."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def _run_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the run that starts at every byte."""
    n = max(len(data) - RUN + 1, 0)
    runs = np.ndarray(shape=(n,), dtype="<u4", buffer=data, strides=(1,)) if n else np.empty(0, "<u4")
    return (runs * np.uint32(2654435761)) >> np.uint32(32 - RUN_BITS)


def _finder(needles: Sequence[str]):
    """A function from a batch of texts to the numbers of the needles in each."""
    words = [n.encode() for n in needles]
    short = [k for k, w in enumerate(words) if len(w) < RUN]
    long = [k for k, w in enumerate(words) if len(w) >= RUN]

    def find(texts: pa.Array) -> pa.Array:
        hashes = [_run_hashes(np.frombuffer(words[k], dtype="u1")) for k in long]
        flat, starts = np.concatenate([*hashes, np.empty(0, "<u4")]), np.cumsum([0, *map(len, hashes)])[:-1]

        def found(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            _, ends, buffer = part.buffers()
            ends = np.frombuffer(ends, dtype="<i8" if pa.types.is_large_string(part.type) else "<i4")[part.offset : part.offset + len(part) + 1].astype("i8")
            data = np.frombuffer(buffer or b"", dtype="u1")[ends[0] : ends[-1]]
            ends = ends - ends[0]
            runs = _run_hashes(data)
            counts = np.bincount(runs, minlength=1 << RUN_BITS)
            # The place of every needle's rarest run in these texts; a run that is in none rules the needle out.
            rarest = [int(counts[h].argmin()) for h in hashes] if len(runs) else []
            held = np.minimum.reduceat(counts[flat], starts) if len(runs) and long else np.zeros(len(long), "i8")
            common = [long[j] for j in np.flatnonzero(held > len(part) // 4)]
            rows, hits = [], []
            for k in short + common:
                at = np.flatnonzero(pc.match_substring(part, needles[k]).fill_null(False).to_numpy(zero_copy_only=False))
                rows.append(at)
                hits.append(np.full(len(at), k))
            rare = np.flatnonzero((held > 0) & (held <= len(part) // 4))
            if len(rare):
                filed = np.zeros(1 << RUN_BITS, dtype=bool)
                filed[[hashes[j][rarest[j]] for j in rare]] = True
                at = np.flatnonzero(filed[runs])
                order = np.argsort(runs[at], kind="stable")
                at, keys = at[order], runs[at][order]
                raw = data.tobytes()
                for j in rare:
                    word, key = words[long[j]], hashes[j][rarest[j]]
                    places = at[np.searchsorted(keys, key, "left") : np.searchsorted(keys, key, "right")] - rarest[j]
                    places = places[[p >= 0 and raw.startswith(word, p) for p in places.tolist()]]
                    inside = np.searchsorted(ends, places, "right") - 1
                    inside = inside[places + len(word) <= ends[inside + 1]]
                    rows.append(np.unique(inside))
                    hits.append(np.full(len(rows[-1]), long[j]))
            rows, hits = np.concatenate([*rows, np.empty(0, "i8")]), np.concatenate([*hits, np.empty(0, "i8")])
            valid = np.asarray(part.is_valid())[rows.astype("i8")]
            return rows[valid].astype("i8"), hits[valid].astype("i4")

        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        total, all_rows, all_hits, begin = len(texts), [], [], 0
        while begin < total:
            until = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, "right"))
            until = max(until, begin + 1)
            rows, hits = found(texts.slice(begin, until - begin))
            all_rows.append(rows + begin)
            all_hits.append(hits)
            begin = until
        rows, hits = np.concatenate([*all_rows, np.empty(0, "i8")]), np.concatenate([*all_hits, np.empty(0, "i4")])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows.astype("i8"), minlength=total))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hits[np.argsort(rows, kind="stable")], pa.int32()))

    return find


def _with_few(df: DataFrame, text: Column, filed: DataFrame, out: str, none: Column) -> DataFrame:
    """The needles travel to the texts: no row moves and every text is read once."""
    words = [r.needle for r in filed.select("needle").orderBy("needle").collect()]
    if not words:
        return df.withColumn(out, none)
    find = F.arrow_udf(_finder(words), "array<int>")
    numbered = filed.agg(F.array_sort(F.collect_list(F.struct("needle", "_rows"))).alias("_all"))
    rows = numbered.select(F.transform("_all", lambda f: f["_rows"])).scalar()
    met = F.flatten(F.transform("_at", lambda i: F.get("_all", i)))
    return df.withColumn("_at", find(text)).withColumn("_all", rows).withColumn(out, F.coalesce(met, none)).drop("_at", "_all")


def _with_many(df: DataFrame, text: Column, filed: DataFrame, out: str, none: Column, sizes: Sequence[int]) -> DataFrame:
    """Needles and texts meet in joins, over the run of a needle that the fewest texts hold."""
    keyed = df.withColumn("_text", text).withColumn("_key", F.xxhash64("_text"))
    held = keyed.select("_key", F.explode(grams(F.col("_text"), sizes)).alias("_gram"))
    # One row per run and task reaches the count.
    counts = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    own = filed.select("needle", F.explode(grams(F.col("needle"), sizes)).alias("_gram"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), (-F.length("_gram")).alias("shorter"), "_gram"))
    rare = own.join(counts, "_gram", "left").groupBy("needle").agg(rarest.alias("_r"))
    index = materialise(filed.join(rare, "needle").select(F.col("_r._gram").alias("_gram"), F.struct("needle", "_rows").alias("_filed")), "needles")
    met = held.join(index, "_gram").groupBy("_key").agg(F.collect_set("_filed").alias("_met"))
    inside = F.filter("_met", lambda m: F.contains(F.col("_text"), m["needle"]))
    rows = F.flatten(F.transform(inside, lambda m: m["_rows"]))
    return keyed.join(met, "_key", "left").withColumn(out, F.coalesce(rows, none)).drop("_key", "_text", "_met")


def with_needles(df: DataFrame, text: Column, needles: DataFrame, out: str, sizes: Sequence[int] = GRAMS, few: int = FEW_NEEDLES) -> DataFrame:
    """``df`` with ``out``: the rows of ``needles(needle, ...)`` whose needle stands in ``text``, as an array of structs in no order.

    Up to ``few`` needles travel to the texts, which are read once where they are: a needle is looked for at the places of its
    run that is rarest in a slice of texts, one that most texts may hold in each of them. Any larger number passes as well:
    every needle is filed under the one of its runs that the fewest texts hold, a text meets the needles filed under its
    runs and no others; their index is a table, which is broadcast only where its size allows, and equal texts are looked up
    once. Either way the whole needle is compared, so the result is exact. Empty needles and nulls stand in no text.
    """
    none = F.filter(F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in needles.schema])), lambda _: F.lit(False))
    filed = materialise(needles.where(F.col("needle") != "").groupBy("needle").agg(F.collect_list(F.struct(*needles.columns)).alias("_rows")), "needles")
    n, chars = filed.agg(F.count("*"), F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()
    if n <= few and chars <= FEW_CHARS:
        return _with_few(df, text, filed, out, none)
    return _with_many(df, text, filed, out, none, sizes)
