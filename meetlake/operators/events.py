"""Events in words and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as T
from meetlake.operators import spans as S

def order():
    return Window.partitionBy("meeting_id", "track").orderBy("i")



def pauses(sentenced: DataFrame, speech: DataFrame, least_ms: int = 300, long_ms: int = 800) -> DataFrame:
    """Gaps between neighbouring own words: structural at a boundary of thought, hesitation elsewhere; not while the other speaks."""
    own = sentenced.where("track = 'mic' AND kind <> 'filler'")
    following = lambda c: F.lead(c).over(order())
    boundary = T.thought_boundary(F.col("text"), following("text")) | (F.col("sentence_i") != following("sentence_i"))
    gaps = own.select("meeting_id", "i", "sentence_i", F.col("end_ms").alias("start_ms"), following("start_ms").alias("end_ms"), boundary.alias("boundary")).where(f"end_ms - start_ms >= {least_ms}")
    gaps = S.overlap_sums(gaps, speech.where("track = 'system'"), ["meeting_id"], ["meeting_id", "i"], "other_ms")
    length = F.col("end_ms") - F.col("start_ms")
    kept = gaps.where(F.col("other_ms") <= F.greatest(F.lit(100.0), 0.2 * length))
    kind = F.when(F.col("boundary") & (length >= long_ms), "structural_pause").when(~F.col("boundary"), "hesitation_pause")
    return kept.withColumn("kind", kind).where("kind IS NOT NULL").select("meeting_id", "start_ms", "end_ms", "kind", F.when((F.col("kind") == "hesitation_pause") & (length >= long_ms), "long").alias("label"), "sentence_i")


def interruptions(spans: DataFrame, turn_gap: int = 700, least_ms: int = 500, spoken_ms: int = 1000) -> DataFrame:
    """Overlaps of turns in which the later speaker began after the earlier had spoken long enough."""
    turns = S.merge_gaps(spans, turn_gap)
    mic, other = (turns.where(F.col("track") == t).drop("track") for t in ("mic", "system"))
    both = S.overlapping(mic, other, ["meeting_id"]).where(F.least("end_ms", "b_end") - F.greatest("start_ms", "b_start") >= least_ms)
    who = F.when(F.col("b_start") - F.col("start_ms") >= spoken_ms, "by_other").when(F.col("start_ms") - F.col("b_start") >= spoken_ms, "by_me")
    return both.select("meeting_id", F.greatest("start_ms", "b_start").alias("start_ms"), F.least("end_ms", "b_end").alias("end_ms"), who.alias("kind")).where("kind IS NOT NULL")


def fillers(words: DataFrame) -> DataFrame:
    return words.where("kind = 'filler'").select("meeting_id", "track", "i", "start_ms", "end_ms", "label")


def crutch_candidates(sentenced: DataFrame, phrases: list[tuple[str, bool]], pause_ms: int = 200) -> DataFrame:
    """Own n-grams that are phrases; conditional ones only at a sentence start or beside a pause (ends count as pauses)."""
    own = sentenced.where("track = 'mic' AND kind <> 'filler'")
    longest = max(p.count(" ") + 1 for p, _ in phrases)
    own = own.withColumn("j", F.row_number().over(order()) - 1)
    after = lambda c, n: F.lead(c, n).over(order())
    starts = F.coalesce(F.col("sentence_i") != F.lag("sentence_i").over(order()), F.lit(True)) | F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order()) >= pause_ms, F.lit(True))
    grams = [F.struct(F.lit(n).alias("n"), (F.when(after("norm", n - 1).isNotNull(), F.concat_ws(" ", "norm", *(after("norm", k) for k in range(1, n)))) if n > 1 else F.col("norm")).alias("phrase"), F.coalesce(after("start_ms", n) - (after("end_ms", n - 1) if n > 1 else F.col("end_ms")) >= pause_ms, F.lit(True)).alias("pause")) for n in range(1, longest + 1)]
    rows = own.select("meeting_id", "i", "j", "start_ms", starts.alias("starts"), F.array(*grams).alias("gs")).select("meeting_id", "i", "j", "start_ms", "starts", F.inline("gs"))
    known = own.sparkSession.createDataFrame(phrases, "phrase string, conditional boolean")
    return rows.join(F.broadcast(known), "phrase").where("NOT conditional OR starts OR pause").select("meeting_id", "i", "j", "n", "start_ms", "phrase")


def crutches(candidates: DataFrame) -> DataFrame:
    """Of overlapping candidates, from left to right, the longest: a running state over a meeting's candidates, the first word that is free."""

    def step(free, row):
        return (free, []) if free is not None and row.j < free else (row.j + row.n, [(row.i, row.n, row.start_ms, row.phrase)])

    best = candidates.groupBy("meeting_id", "j").agg(F.max_by(F.struct("n", "i", "start_ms", "phrase"), "n").alias("c")).select("meeting_id", "j", "c.*")
    kinds = dict(candidates.dtypes)
    schema = f"i {kinds['i']}, n {kinds['n']}, start_ms long, phrase string"
    return S.folded(best, ["meeting_id"], ["j"], schema, step, lambda free: [])


def sentence_at(points: DataFrame, sentenced: DataFrame, at: str) -> DataFrame:
    """As-of lookup: sentence of the last own word that begins at or before each point; one sort, no pairs."""
    marks = sentenced.where("track = 'mic'").select("meeting_id", F.col("start_ms").alias("t"), F.lit(0).alias("o"), "sentence_i", F.lit(None).cast("struct<" + ",".join(f"{c}:{k}" for c, k in points.dtypes) + ">").alias("p"))
    asks = points.select("meeting_id", F.col(at).alias("t"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("sentence_i"), F.struct(*points.columns).alias("p"))
    upto = Window.partitionBy("meeting_id").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("sentence_i", F.last_value("sentence_i", ignoreNulls=True).over(upto))
    return both.where("p IS NOT NULL").select("p.*", "sentence_i")


def outside_speech(words: DataFrame, speech: DataFrame, pad_ms: int = 150) -> DataFrame:
    """Words without any speech of their own track within pad_ms."""
    padded = words.select("meeting_id", "track", "i", (F.col("start_ms") - pad_ms).alias("start_ms"), F.greatest(F.col("end_ms"), F.col("start_ms") + 20).alias("e")).withColumn("end_ms", F.col("e") + pad_ms).drop("e")
    hit = S.overlapping(padded, speech, ["meeting_id", "track"]).select("meeting_id", "track", "i").distinct()
    return words.join(hit, ["meeting_id", "track", "i"], "left_anti")


def dedup(found: DataFrame, known: DataFrame, share: float = 0.5) -> DataFrame:
    """Known events, source both where a found one overlaps by the share of the shorter; and the found ones that overlap none.

    Both have meeting_id, id, start_ms, end_ms.
    """
    ends = known.select("meeting_id", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"), F.col("id").alias("known_id"))
    near = S.overlapping(found, known, ["meeting_id"]).join(ends, ["meeting_id", "b_start", "b_end"])
    shorter = F.least(F.col("end_ms") - F.col("start_ms"), F.col("b_end") - F.col("b_start"))
    near = near.where(F.least("end_ms", "b_end") - F.greatest("start_ms", "b_start") >= share * shorter)
    hit = near.select("meeting_id", F.col("known_id").alias("id"), F.lit("both").alias("source")).distinct()
    kept = known.join(hit, ["meeting_id", "id"], "left").withColumn("source", F.coalesce("source", F.lit("words")))
    alone = found.join(near.select("meeting_id", "id").distinct(), ["meeting_id", "id"], "left_anti").withColumn("source", F.lit("detector"))
    columns = ["meeting_id", "id", "start_ms", "end_ms", "source"]
    return kept.select(columns).unionByName(alone.select(columns))


def filler_candidates(speech: DataFrame, words: DataFrame, least_ms: int = 250, most_ms: int = 2000, share: float = 0.3, margin_ms: int = 150) -> DataFrame:
    """Where a filler may be: short speech spans with few words in them, and holes between words in the other spans. All of one track, by meeting."""
    on = ["meeting_id"]
    said = S.normalize(words, on)
    seg = S.overlap_sums(speech, said, on, ["meeting_id", "start_ms"], "said_ms")
    length = F.col("end_ms") - F.col("start_ms")
    whole = length.between(least_ms, most_ms) & (F.col("said_ms") <= share * length)
    padded = said.withColumns({"start_ms": F.col("start_ms") - margin_ms, "end_ms": F.col("end_ms") + margin_ms})
    holes = S.subtract(seg.where(~whole), padded, on).where(length.between(least_ms, most_ms))
    return S.normalize(seg.where(whole).select("meeting_id", "start_ms", "end_ms").unionByName(holes), on)


def nearest(points: DataFrame, marks: DataFrame, value: str, by: list[str], within_ms: int) -> DataFrame:
    """points (meeting_id, start_ms, by) with the value of the mark that begins nearest within the distance, the earlier of two; others go."""
    around = points.select("meeting_id", *by, F.col("start_ms").alias("_at"), (F.col("start_ms") - within_ms).alias("start_ms"), (F.col("start_ms") + within_ms + 1).alias("end_ms"))
    spots = marks.select("meeting_id", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    best = S.overlapping(around, spots, ["meeting_id"]).groupBy("meeting_id", *by, "_at").agg(F.min(F.struct(F.abs(F.col("b_start") - F.col("_at")).alias("d"), F.col("b_start").alias("s"))).alias("m"))
    values = marks.groupBy("meeting_id", F.col("start_ms").alias("_s")).agg(F.min(value).alias(value))
    return best.select("meeting_id", *by, F.col("_at").alias("start_ms"), F.col("m.s").alias("_s")).join(values, ["meeting_id", "_s"]).drop("_s")


def hallucinated(segments: DataFrame, speech: DataFrame, phrases: list[str]) -> DataFrame:
    """segments with suspicious (little speech under them, or a recogniser in doubt) and dropped (suspicious, and a known phrase or deep doubt)."""
    by = ["meeting_id", "track", "sentence_i"]
    out = S.overlap_sums(segments, speech, S.KEYS, by, "said_ms")
    doubt = (F.col("no_speech") > 0.6) | (F.col("logprob") < -1.0) | (F.col("compression") > 2.4)
    out = out.withColumn("suspicious", (F.col("said_ms") < 0.5 * (F.col("end_ms") - F.col("start_ms"))) | doubt)
    known = F.lower("text").rlike("|".join(phrases)) if phrases else F.lit(False)
    return out.withColumn("dropped", F.col("suspicious") & (known | ((F.col("no_speech") > 0.85) & (F.col("logprob") < -1.0))))


def first_within(points: DataFrame, marks: DataFrame, value: str, by: list[str], within_ms: int) -> DataFrame:
    """points (meeting_id, start_ms, by, ...) with the value of the first mark that begins less than the distance away; null where there is none."""
    around = points.select("meeting_id", *by, F.col("start_ms").alias("_at"), (F.col("start_ms") - within_ms + 1).alias("start_ms"), (F.col("start_ms") + within_ms).alias("end_ms"))
    spots = marks.select("meeting_id", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    first = S.overlapping(around, spots, ["meeting_id"]).groupBy("meeting_id", *by, "_at").agg(F.min("b_start").alias("_s"))
    values = marks.groupBy("meeting_id", F.col("start_ms").alias("_s")).agg(F.min(value).alias(value))
    found = first.join(values, ["meeting_id", "_s"]).select("meeting_id", *by, F.col("_at").alias("start_ms"), value)
    return points.join(found, ["meeting_id", *by, "start_ms"], "left")


def layers(events: DataFrame, durations: DataFrame, kinds: list[str]) -> DataFrame:
    """meeting_id, kind, at, wide of the events of these kinds, as shares of their meeting. durations: meeting_id, duration_ms."""
    own = events.where(F.col("kind").isin(kinds)).join(durations, "meeting_id")
    return own.select("meeting_id", "kind", (F.col("start_ms") / F.col("duration_ms")).alias("at"), ((F.col("end_ms") - F.col("start_ms")) / F.col("duration_ms")).alias("wide"))
