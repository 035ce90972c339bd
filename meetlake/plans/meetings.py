"""The tables that the parts of a query share, each worked out once for the query and read from the shared folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.operators import events as E
from meetlake.operators import metrics as M
from meetlake.operators import prosody as P
from meetlake.operators import segment as G
from meetlake.operators import spans as S
from meetlake.operators import timeline as L
from meetlake.sources import adapters as D
from meetlake.sources.shared import dealt, staged, together

EVENT = ["meeting_id", "start_ms", "end_ms", "kind"]


class Meetings:
    """Words, sentences, speech, windows, events and metrics of all meetings below a folder of tables."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def parts(self) -> int:
        return D.parts(self.spark, self.sf)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written once, dealt by meeting: what is grouped by meeting, or meets by it, is not shuffled again."""
        return dealt(df, name, "meeting_id", self.parts)

    def ahead(self, *names: str) -> None:
        """Write some tables at the same time; what they all need comes first."""
        self.words  # noqa: B018
        together(self.spark, *(lambda n=n: getattr(self, n) for n in names if n not in self.__dict__))

    @cached_property
    def words(self) -> DataFrame:
        """Words with their sentences: the one reading of the source."""
        return self.kept(G.with_sentences(D.words(self.spark, self.sf, self.parts)), "words")

    @cached_property
    def sentences(self) -> DataFrame:
        return self.kept(G.sentences(self.words), "sentences")

    @cached_property
    def speech(self) -> DataFrame:
        return self.kept(S.vad(self.words), "speech")

    @cached_property
    def line(self) -> DataFrame:
        return self.kept(L.timeline(self.words, self.speech), "line")

    @cached_property
    def mine(self) -> DataFrame:
        return self.words.where("track = 'mic'")

    @cached_property
    def decays(self) -> DataFrame:
        return self.kept(P.word_decays(self.mine, D.framed(), self.sentences), "decays")

    @cached_property
    def rises(self) -> DataFrame:
        return self.kept(P.word_rises(self.mine, D.framed(), self.sentences), "rises")

    @cached_property
    def meetings(self) -> DataFrame:
        return D.meetings(self.spark, self.sf)

    @cached_property
    def questions(self) -> DataFrame:
        return G.utterances(self.words, C.STARTERS, C.LONG_STARTERS).where("is_question")

    @cached_property
    def bursts(self) -> DataFrame:
        return L.bursts(self.line.join(self.meetings.select("meeting_id", "type"), "meeting_id"))

    @cached_property
    def fillers(self) -> DataFrame:
        """Fillers and crutch phrases of the owner."""
        crutches = E.crutches(E.crutch_candidates(self.words, C.CRUTCHES)).select("meeting_id", "start_ms", F.col("start_ms").alias("end_ms"), F.lit("crutch").alias("kind"))
        return E.fillers(self.words).where("track = 'mic'").withColumn("kind", F.lit("filler")).select(EVENT).unionByName(crutches)

    @cached_property
    def spoken(self) -> DataFrame:
        """The events that words and speech alone tell of, and that metrics count."""
        pauses, interruptions = E.pauses(self.words, self.speech).select(EVENT), E.interruptions(D.raw_of(self.words)).select(EVENT)
        return self.fillers.unionByName(pauses).unionByName(interruptions)

    @cached_property
    def events(self) -> DataFrame:
        """meeting_id, start_ms, end_ms, kind of everything that was noticed."""
        self.ahead("sentences", "speech")
        self.ahead("line", "decays", "rises")
        out = self.spoken.unionByName(self.questions.withColumn("kind", F.lit("question_from_other")).select(EVENT))
        out = out.unionByName(P.decay_events(self.decays, self.sentences).select(EVENT)).unionByName(P.rise_events(self.rises, self.sentences).select(EVENT))
        out = out.unionByName(self.bursts.select("meeting_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), F.lit("fast_burst").alias("kind")))
        return self.kept(out, "events")

    @cached_property
    def counts(self) -> DataFrame:
        return self.events.groupBy("meeting_id", "kind").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def counted(self) -> DataFrame:
        """counts of the events that metrics count, without a list of events."""
        return self.kept(self.spoken.groupBy("meeting_id", "kind").agg(F.count(F.lit(1)).alias("n")), "counts")

    @cached_property
    def tone(self) -> DataFrame:
        return self.kept(P.word_tone(self.mine, D.framed()), "tone")

    @cached_property
    def diversity(self) -> DataFrame:
        return self.kept(M.mtld(M.tokens(self.words), "meeting_id", "tokens").select("meeting_id", "mtld"), "diversity")

    @cached_property
    def wide(self) -> DataFrame:
        """A row of all metrics for each meeting; what does not need each other is worked out at the same time."""
        self.ahead("sentences", "speech", "diversity", "tone")
        self.ahead("line", "decays", "rises", "counted")
        voice = self.tone.join(P.ends(self.decays, self.rises), "meeting_id", "left")
        return self.kept(M.metrics(self.words, self.sentences, self.speech, self.counted, L.medians(self.line), self.meetings, voice, self.diversity), "metrics")

    @cached_property
    def named(self) -> DataFrame:
        """The references of every metric of each meeting, which do not depend on its values."""
        each = F.explode(F.array(*map(F.lit, C.METRICS))).alias("metric")
        return M.judged(self.meetings.select("meeting_id", "type", "speaker", each).withColumn("value", F.lit(None).cast("double"))).drop("status")

    @cached_property
    def long(self) -> DataFrame:
        return M.long_form(self.wide)

    @cached_property
    def judged(self) -> DataFrame:
        return M.judged(self.long)

    @cached_property
    def base(self) -> DataFrame:
        """speaker, metric, n, mean, std of each speaker's first meetings."""
        ready = self.meetings.where("status = 'ready' AND type <> 'training'").select("meeting_id", "started_at")
        return staged(M.baseline(self.long.join(ready, "meeting_id"), ["speaker", "metric"]), "base")

    @cached_property
    def history(self) -> DataFrame:
        """The judged metrics of ready meetings with their time."""
        return self.judged.join(self.meetings.where("status = 'ready'").select("meeting_id", "started_at"), "meeting_id")
