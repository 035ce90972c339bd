"""What an application asks of the engine: meetings, reports, progress. Every call that returns data returns a DataFrame.

Reports and the catalog are snapshots below a folder (`sources/snapshots.py`): a call that changes them commits a whole new
one, so that readers never see half of a change, and of two callers that change the same one starts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import constants as C
from meetlake.operators import catalog as K
from meetlake.operators import metrics as M
from meetlake.operators import patterns as P
from meetlake.operators import quotes as Q
from meetlake.operators import rescoring as S
from meetlake.plans.meetings import Meetings
from meetlake.sources.snapshots import Table

CARD = ["meeting_id", "speaker", "type", "title", "started_at", "status", "score"]


class Engine:
    """The engine over a folder of its own; the tables of meetings are given to analyze()."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark = spark
        self.reports, self.catalog = Table(spark, f"{home}/reports"), Table(spark, f"{home}/catalog")

    def analyze(self, sf_dir: str, with_baseline: bool = False) -> DataFrame:
        """Reports of all meetings of the tables below a folder; they replace those of the same meetings. The cards."""
        m = Meetings(self.spark, sf_dir)
        made = S.assembled(m.meetings, m.judged, m.line.select("meeting_id", *S.POINT), m.events, m.base if with_baseline else None)
        made = made.withColumn("title", F.concat(F.lit("Meeting "), "meeting_id"))
        cards = made.select(*CARD)
        if self.reports.newest():
            self.reports.merge(made, ["meeting_id"])
            self.catalog.merge(cards, ["meeting_id"])
        else:
            self.reports.commit(made)
            self.catalog.commit(cards)
        return self.list_meetings()

    def list_meetings(self) -> DataFrame:
        """A card for each meeting, with the score of the speaker's ready meeting before it; newest first."""
        return K.cards(self.catalog.read()).orderBy(F.col("started_at").desc(), F.col("meeting_id").desc())

    def get_meeting(self, meeting_id: int) -> DataFrame:
        return self.catalog.read().where(F.col("meeting_id") == meeting_id)

    def get_report(self, meeting_id: int) -> DataFrame:
        return self.reports.read().where(F.col("meeting_id") == meeting_id)

    def update_meeting(self, meeting_id: int, title: str | None = None, type_: str | None = None) -> DataFrame:
        """Another title, or another type, under which the stored report is judged anew. The card."""
        if type_ is not None and type_ not in C.MEETING_TYPES:
            raise ValueError(f"a meeting is one of {', '.join(C.MEETING_TYPES)}, not {type_}")
        report = self.get_report(meeting_id)
        if report.isEmpty():
            raise KeyError(meeting_id)
        if type_ is not None:
            report = S.rescored(report, F.lit(type_))
        if title is not None:
            report = report.withColumn("title", F.lit(title))
        self.reports.merge(report, ["meeting_id"])
        self.catalog.merge(self.get_report(meeting_id).select(*CARD), ["meeting_id"])
        return self.get_meeting(meeting_id)

    def rescore(self, meeting_id: int, type_: str) -> DataFrame:
        """The stored report under another type, written back."""
        self.update_meeting(meeting_id, type_=type_)
        return self.get_report(meeting_id)

    def delete_meeting(self, meeting_id: int) -> None:
        gone = self.spark.createDataFrame([(meeting_id,)], "meeting_id long")
        for table in (self.reports, self.catalog):
            rows = table.read()
            table.merge(rows.limit(0), ["meeting_id"], gone)

    def ready(self) -> DataFrame:
        """speaker, meeting_id, started_at, type, score and the stored metrics of ready meetings, a row each."""
        own = self.reports.read().where("status = 'ready'")
        return own.select("speaker", "meeting_id", "started_at", "type", "score", F.inline("metrics"))

    def get_progress(self) -> DataFrame:
        """speaker, metric, meeting_id, started_at, value: the course of what progress shows."""
        return self.ready().where(F.col("metric").isin(C.PROGRESS) & F.col("value").isNotNull()).select("speaker", "metric", "meeting_id", "started_at", "value")

    def get_baseline(self) -> DataFrame:
        """speaker, metric, n, mean, std of each speaker's first meetings."""
        return M.baseline(self.ready().where("type <> 'training'"), ["speaker", "metric"])

    def get_patterns(self) -> DataFrame:
        """speaker, metric, run, n_flag, n: what is out of its range again and again."""
        return P.out_of_range(self.ready())

    def weekly(self) -> DataFrame:
        """speaker, text: a summary of each speaker's meetings."""
        scores = self.catalog.read().where("status = 'ready'").select("speaker", "started_at", "meeting_id", "score")
        return P.summary(scores, P.worst(self.ready()))

    def list_training_tasks(self) -> DataFrame:
        """speaker, place, task, minutes: exercises for each speaker's weakest metrics."""
        own = self.ready()
        return P.exercises(own.select("speaker").distinct(), P.worst(own))

    def prepare_meeting(self, topic: str, type_: str = "other", items: list[str] = (), questions: list[str] = ()) -> DataFrame:
        """topic, type, checklist and likely_questions: what is given, once each, filled from the fixed lists."""
        kind = type_.strip().lower() if type_.strip().lower() in C.MEETING_TYPES else "other"
        rows = self.spark.createDataFrame([(" ".join(topic.split()) or "untitled", kind, list(items), list(questions))], "topic string, type string, items array<string>, asked array<string>")
        return rows.select("topic", "type", Q.checklist(F.col("items")).alias("checklist"), Q.likely_questions(F.col("asked")).alias("likely_questions"))

    def doctor(self) -> DataFrame:
        """check, ok, detail of what the engine needs."""
        folder = self.spark.conf.get("spark.checkpoint.dir", None)
        checks = [("spark", True, self.spark.version), ("shared folder", bool(folder), folder or "spark.checkpoint.dir is not set"), ("reports", self.reports.newest() is not None, f"version {max(self.reports.versions(), default=0)}")]
        return self.spark.createDataFrame(checks, "check string, ok boolean, detail string")
