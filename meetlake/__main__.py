"""The engine from a shell: python -m meetlake COMMAND --home FOLDER ...; one line of JSON for each row, then a last one that says how it went."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from meetlake.api import Engine
from meetlake.functions.constants import MEETING_TYPES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meetlake", description="speech of meetings, analysed")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *meeting: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        c.add_argument("--home", required=True, help="folder of reports and catalog")
        c.add_argument("--out", help="folder to write the rows to as JSON, instead of printing them")
        for m in meeting:
            c.add_argument(f"--{m}", type=int, required=True)
        return c

    c = command("analyze", "reports of all meetings of a folder of tables")
    c.add_argument("--tables", required=True)
    c.add_argument("--baseline", action="store_true", help="score against each speaker's own baseline too")
    command("list", "a card for each meeting")
    command("report", "the report of a meeting", "meeting")
    c = command("rescore", "a stored report under another type", "meeting")
    c.add_argument("--type", required=True, choices=MEETING_TYPES)
    c = command("rename", "another title for a meeting", "meeting")
    c.add_argument("--title", required=True)
    command("delete", "a meeting and its report go", "meeting")
    command("baseline", "the personal baseline of each speaker")
    command("progress", "the course of each metric")
    command("patterns", "what is out of its range again and again")
    command("tasks", "exercises for each speaker")
    c = command("prepare", "a checklist and likely questions")
    c.add_argument("--topic", required=True)
    c.add_argument("--type", default="other")
    command("doctor", "what the engine needs")
    return p


def asked(engine: Engine, a: argparse.Namespace) -> DataFrame | None:
    """The rows that a command gives."""
    calls = {
        "analyze": lambda: engine.analyze(a.tables, a.baseline),
        "list": engine.list_meetings,
        "report": lambda: engine.get_report(a.meeting),
        "rescore": lambda: engine.rescore(a.meeting, a.type),
        "rename": lambda: engine.update_meeting(a.meeting, a.title),
        "delete": lambda: engine.delete_meeting(a.meeting),
        "baseline": engine.get_baseline,
        "progress": engine.get_progress,
        "patterns": engine.get_patterns,
        "tasks": engine.list_training_tasks,
        "prepare": lambda: engine.prepare_meeting(a.topic, a.type),
        "doctor": engine.doctor,
    }
    return calls[a.command]()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if the command could be done; what went wrong is said in the last line."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("meetlake").getOrCreate()
    try:
        rows, n = asked(Engine(spark, a.home), a), 0
        if rows is not None and a.out:
            rows.write.mode("overwrite").json(a.out)
        elif rows is not None:
            for line in rows.toJSON().toLocalIterator():  # a part at a time, however many rows
                print(line)
                n += 1
        print(json.dumps({"ok": True, "command": a.command} | ({"out": a.out} if a.out else {"rows": n})))
        return 0
    except Exception as e:  # noqa: BLE001  the shell gets one line, not a trace
        print(json.dumps({"ok": False, "command": a.command, "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}))
        return 1


if __name__ == "__main__":
    sys.exit(main())
