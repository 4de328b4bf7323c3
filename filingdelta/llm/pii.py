"""Personal data: generators propose spans, boosted trees score them; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.llm.common import written

KINDS = ("email", "ip", "card", "phone", "number", "address")
BASE = KINDS[:4]
# Rows of labelled candidates that the trees are fitted on, at most.
TRAINING_ROWS = 20_000
TREES, DEPTH, MIN_PRECISION, BINS = 8, 3, 0.98, 50
SEED = 7

# Patterns are written without repeated groups, which the regex engine would follow recursively; where a pattern needs
# one, the text is first changed character by character, so that all places stay.
LOCAL = "A-Za-z0-9._%+-"
GENERATORS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9][0-9 -]{13,}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.-])[(0-9][0-9 ().-]{7,20}[0-9](?![0-9A-Za-z])",
    "address": rf"(?<![{LOCAL}])[{LOCAL}]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?)[A-Za-z]++",
}
FEATURES = ("length", "digits", "separators", "groups", "first_group", "last_group", "distinct_digits", "dots", "plus", "brackets", "letters", "sentence", "after_letter", "before_letter", "gap")
# Words before a span that speak for or against it; they label candidates and are no features.
CUES = r"(?i)(tel|telephone|phone|call|fax|mobile?|mail|contact|whatsapp)[^A-Za-z0-9]{0,6}$"
OTHER_CUES = r"(?i)(order|invoice|isbn|issn|version|date|page|pages|serial|ticket|case|patent|article|doi)[^A-Za-z0-9]{0,6}$"
DATE = r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2})(?![0-9-])"


def prepared(kind: str, text: Column) -> Column:
    """The text a generator reads; as many characters as before, each in its place."""
    if kind == "email":  # a dot that ends no label cannot belong to a domain, though it can to a local part
        return F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_")
    if kind == "card":  # only single separators between digits stay
        return F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", "x")
    return text


def _may_have(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "address":
        return F.contains(text, F.lit("at"))
    return F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9][0-9. -]")


def _proposals(kind: str, text: Column) -> Column:
    """Matches in order, each with the length and end of the gap before it and the start of the one behind it."""
    pattern, source = F.lit(GENERATORS[kind]), prepared(kind, text)
    cut = F.struct(F.regexp_extract_all(source, pattern, F.lit(0)).alias("m"), F.split(source, GENERATORS[kind]).alias("g"))

    def rows(s: Column) -> Column:
        return F.transform(s["m"], lambda m, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("k"), m.alias("match"), F.length(F.get(s["g"], k)).alias("gap"),
            F.right(F.get(s["g"], k), F.lit(24)).alias("before"), F.left(F.get(s["g"], k + 1), F.lit(1)).alias("after")))

    found = F.flatten(F.transform(F.array(cut), rows))
    return F.when(_may_have(kind, text), found)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.floor(2 * d.cast("int") / 10).cast("int") + (2 * d.cast("int")) % 10))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a proposal is certain by its format alone."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """All proposals of ``docs(doc_id, text)`` with their place; a row without any has one with a null kind.

    Columns: row, doc_id, key, kind, start, stop, base, match, gap, before, after. Places are running sums over the gaps and
    matches of one row and kind; no text is shuffled, only matches and a few characters around them.
    """
    text = F.coalesce("text", F.lit(""))
    # The row's number stands below the explode, so all proposals of a row share it.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    every = F.concat(*(F.coalesce(_proposals(k, F.col("text")), F.array()) for k in KINDS))
    rows = rows.select("row", "doc_id", F.xxhash64("doc_id", "text").alias("key"), F.explode_outer(every).alias("p")).select("row", "doc_id", "key", "p.*")
    so_far = Window.partitionBy("row", "kind").orderBy("k")
    length = F.length("match")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + length).over(so_far).cast("int")).withColumn("start", F.col("stop") - length)
    return rows.select("row", "doc_id", "key", "kind", "start", "stop", valid(F.col("kind"), F.col("match")).alias("base"), "match", "gap", "before", "after")


def featured(rows: DataFrame) -> DataFrame:
    """Adds the vector ``features`` to rows with match, before, after and gap; neither kind nor cue is in it."""
    match, length = F.col("match"), F.length("match")
    digits = F.regexp_replace(match, "[^0-9]", "")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    count = lambda marks: number(length - F.length(F.translate(match, marks, "")))
    features = {
        "length": number(length), "digits": number(F.length(digits)), "separators": count(" -"), "groups": number(F.regexp_count(match, F.lit("[0-9]++"))),
        "first_group": number(F.length(F.regexp_extract(match, "[0-9]++", 0))), "last_group": number(F.length(F.regexp_extract(match, "([0-9]*+)[^0-9]*$", 1))),
        "distinct_digits": number(F.size(F.array_distinct(F.split(F.left(digits, F.lit(40)), "")))), "dots": count("."), "plus": count("+"), "brackets": count("()[]"),
        "letters": number(F.regexp_count(match, F.lit("[A-Za-z]"))), "sentence": number(match.rlike(r"[A-Za-z]\. ")), "after_letter": number(F.col("after").rlike(r"\p{L}")),
        "before_letter": number(F.col("before").rlike(r"\p{L}.?$")), "gap": number(F.least("gap", F.lit(100))),
    }
    named = rows.withColumns({f"_{n}": features[n] for n in FEATURES})
    return VectorAssembler(inputCols=[f"_{n}" for n in FEATURES], outputCol="features").transform(named).drop(*(f"_{n}" for n in FEATURES))


def identity(kind: Column, match: Column) -> Column:
    """What a span says whatever its form: the digits of a number without leading zeros, a plain lower-case address."""
    plain = F.regexp_replace(F.regexp_replace(match, r" ?[(\[]at[)\]] ?", "@"), r" ?(?:[(\[]dot[)\]]|\.) ?", ".")
    return F.when(kind.isin("email", "address"), F.lower(plain)).otherwise(F.ltrim(F.regexp_replace(match, "[^0-9]", ""), F.lit("0")))


def variants(certain: DataFrame) -> DataFrame:
    """Other forms of certain emails and phones: ``(kind, match, before, after, gap, said)``, ``said`` being the label.

    An email is told as an obfuscated address (1) and as a sentence with the same words (0), a phone as a number
    without its country code (1) and as a date of its last digits (0). Forms are dealt by hash.
    """
    match, at = F.col("match"), F.pmod(F.xxhash64("match"), F.lit(6))
    pick = lambda *forms: F.element_at(F.array(*map(F.lit, forms)), (at + 1).cast("int"))
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    host, top = F.regexp_replace(domain, r"^.*\.(?=[^.]+\.[^.]+$)|\.[^.]+$", ""), F.substring_index(domain, ".", -1)
    address = F.concat(local, pick(" (at) ", " [at] ", "(at)", "[at]", " (at) ", "(at)"), host, pick(" (dot) ", " [dot] ", "(dot)", "[dot]", ".", "."), top)
    sentence = F.concat(local, pick(" (at) ", " [at] ", " (at) ", " [at] ", " (at) ", " (at) "), host, F.lit(". "), F.initcap(top))
    number = F.regexp_replace(F.regexp_replace(match, r"^\+[0-9]{1,3}[ .-]*", ""), F.lit(r"(?<=[0-9])[ .-]+(?=[0-9])"), pick("-", "-", " ", ".", "-", " "))
    number = F.when(at < 3, number).otherwise(F.regexp_replace(number, r"[()]+ ?", ""))
    last = F.right(F.regexp_replace(match, "[^0-9]", ""), F.lit(6))
    mark = pick("-", "-", ".", " ", "-", ".")
    date = F.concat(F.lit("20"), F.left(last, F.lit(2)), mark, F.lit("0"), F.substring(last, 3, 1), mark, F.lit("1"), F.right(last, F.lit(1)))
    form = lambda kind, told, said: F.struct(F.lit(kind).alias("kind"), told.alias("match"), F.lit(said).alias("said"))
    told = F.when(F.col("kind") == "email", F.array(form("address", address, 1.0), form("address", sentence, 0.0))).when(
        F.col("kind") == "phone", F.array(form("number", number, 1.0), form("number", date, 0.0)))
    out = certain.where(F.col("kind").isin("email", "phone")).select(F.explode(told).alias("v"), "before", "after", "gap").select("v.*", "before", "after", "gap")
    fits = F.when(F.col("kind") == "address", F.col("match").rlike(f"^{GENERATORS['address']}$")).otherwise(F.col("match").rlike(f"^{GENERATORS['number']}$"))
    return out.where(fits)


def evidence(kind: Column, match: Column, before: Column) -> Column:
    """What speaks for (1) or against (0) a proposal that is not certain by its format, from outside the features; else null."""
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    # A number that is a certain card or IP, or a date, is no phone number; neither is one of more digits than any has.
    other = valid(F.lit("card"), match) | match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") | match.rlike(DATE) | (n > 15) | (n < 7)
    number = F.when(other | before.rlike(OTHER_CUES), 0.0).when(before.rlike(CUES), 1.0)
    return F.when(kind.isin("number", "phone"), number).when(kind == "address", F.when(match.rlike(r"[A-Za-z]\. [A-Z]"), 0.0).when(before.rlike(CUES), 1.0)).otherwise(0.0)


def labelled(proposed: DataFrame) -> DataFrame:
    """``(kind, who, label, features)`` of candidates with evidence, one for each kind, identity and label.

    A proposal that is not certain is told by a certain span elsewhere that says the same, else by ``evidence``; other forms of certain
    spans join them. A certain span is no example of itself, and proposals without evidence are none either.
    """
    context = ("kind", "match", "before", "after", "gap")
    certain, open_ = proposed.where("base"), proposed.where("NOT base AND kind IS NOT NULL")
    who = identity(F.col("kind"), F.col("match"))
    digits = F.regexp_replace("match", "[^0-9]", "")
    # A phone may stand elsewhere without the one to three digits of its country.
    known = F.when(F.col("kind") == "phone", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.ltrim(F.substring(digits, k, F.length(digits)), F.lit("0")))).otherwise(F.array(who))
    known = certain.where(F.col("kind").isin("email", "phone")).select(F.explode(known).alias("who")).where(F.length("who") >= 7).distinct().withColumn("met", F.lit(1.0))
    one = lambda df: df.groupBy("kind", "who", "said").agg(F.first(F.struct(*context[1:])).alias("c")).select("kind", "who", "said", "c.*")
    # Candidates are made one of a kind before the join, so no span that is met often is a hot key.
    seen = one(open_.select(*context, who.alias("who"), evidence(F.col("kind"), F.col("match"), F.col("before")).alias("said")))
    told = seen.join(known, "who", "left").withColumn("said", F.when(F.col("kind").isin("number", "address"), F.coalesce("met", "said")).otherwise(F.col("said"))).drop("met")
    other = one(variants(certain).withColumn("who", who))
    return featured(told.where("said IS NOT NULL").unionByName(other)).select("kind", "who", F.col("said").alias("label"), "features")


def fit(proposed: DataFrame, training_rows: int = TRAINING_ROWS) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """Boosted trees and for each kind the threshold above which held-out precision is at least ``MIN_PRECISION``.

    Labels come from ``labelled``, not from the formats' tests. A fifth of what the candidates say (all forms of one number or
    address together) is held out whole; of the rest ``training_rows`` candidates, taken by hash, are fitted on. None if
    only one class is met.
    """
    sample = written(labelled(proposed).withColumn("fold", F.pmod(F.xxhash64("who", F.lit(SEED)), F.lit(5 * 1_000_000))), "training")
    training = sample.where("fold >= 1000000")
    counted = training.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes")).first()
    if counted["classes"] < 2:
        return None
    share = min(1.0, training_rows / counted["n"])
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=BINS).fit(training.where(F.col("fold") < 1_000_000 + int(4_000_000 * share)))
    scored = model.transform(sample.where("fold < 1000000")).select("kind", "label", F.floor(vector_to_array("probability")[1] * BINS).alias("bin"))
    # At most BINS + 1 rows of each kind.
    counts = scored.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    thresholds = {}
    for kind in KINDS:
        n, good = 0, 0.0
        for at, m, g in sorted(((r["bin"], r["n"], r["good"]) for r in counts if r["kind"] == kind), reverse=True):
            n, good = n + m, good + g
            # One failure more than seen, so that a few lucky rows do not open the gate.
            if good / (n + 1) >= MIN_PRECISION:
                thresholds[kind] = at / BINS
    return model, thresholds


def find_personal_data(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``(row, doc_id, key, spans)`` per row of ``docs(doc_id, text)``: sorted ``(start, rank, kind, stop, base)``.

    Certain formats are always reported (``base``); other proposals if the trees' score reaches the calibrated threshold and
    no certain span overlaps them. A null or empty text has no spans, repeated rows have the same ones, other columns are
    not read. Candidates are a table in the shared folder, read for fitting and for scoring.
    """
    proposed = written(candidates(docs), "candidates")
    fitted = fit(proposed, training_rows)
    if fitted is None:
        scored = proposed.withColumn("chosen", F.col("base"))
    else:
        model, thresholds = fitted
        least = F.lit(2.0)
        for kind, threshold in thresholds.items():
            least = F.when(F.col("kind") == kind, threshold).otherwise(least)
        scored = model.transform(featured(proposed)).withColumn("chosen", F.col("base") | (vector_to_array("probability")[1] >= least))
    place = Window.partitionBy("row").orderBy("start", "stop")
    held = F.col("base")
    ends = F.max(F.when(held, F.col("stop"))).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(held, F.col("start"))).over(place.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = ~(F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("stop"), F.lit(False)))
    scored = scored.select("row", "doc_id", "key", "kind", "start", "stop", "base", "chosen").withColumn("free", free)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.when(held | (F.col("chosen") & F.col("free")), F.struct("start", rank.alias("rank"), "kind", "stop", "base"))
    return scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.sort_array(F.collect_list(entry)).alias("spans"))


def redact(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    ``n_chars``, where there is such a column, follows the new text. Rows without spans, and null texts, are unchanged.
    """
    found = find_personal_data(docs, training_rows).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    found = written(found, "spans").withColumnRenamed("key", "_key").withColumnRenamed("spans", "_spans")
    held = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_at")).join(found, F.col("_at") == F.col("_key"), "left")
    text = F.col("_row.text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    held = held.withColumn("_new", new)
    columns = {"text": F.col("_new"), "n_chars": F.when(F.col("_spans").isNull(), F.col("_row.n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("_new").cast("long"))}
    return held.select(*(columns[c].alias(c) if c in columns else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
