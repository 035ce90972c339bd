"""Starts of meetings and layers, by small cases and a plain loop."""

import random

from meetlake.operators import events as E
from meetlake.operators import patterns as P


def test_starts_that_repeat(spark):
    """A filler-ridden start counts from half as many again and a half on, in two meetings or more; a fast one from a tenth more on."""
    rng = random.Random(2)
    rows = [(s, m, rng.choice([None, 0.0, 1.0, 2.0, 3.5]), rng.choice([None, 0.0, 1.0, 2.0]), rng.choice([None, 100.0, 120.0, 130.0]), rng.choice([0.0, 100.0, 110.0])) for s in range(40) for m in range(rng.randint(1, 6))]
    reports = spark.createDataFrame([(*r, r[1]) for r in rows], "speaker long, meeting_id long, fillers_first double, fillers_rest double, wpm_first double, wpm_rest double, started_at long")

    def plain(flag):
        out = {}
        for s in range(40):
            flags = [flag(*r[2:]) for r in rows if r[0] == s]
            if sum(flags) >= 2:
                run = next((i for i, f in enumerate(reversed(flags)) if not f), len(flags))
                out[s] = (run, sum(flags), len(flags))
        return out

    slow_start = plain(lambda ff, fr, wf, wr: ff is not None and fr is not None and ff >= 1.5 * fr + 0.5)
    fast = plain(lambda ff, fr, wf, wr: bool(wf and wr and wf >= wr * 1.1))
    got = lambda flag: {r.speaker: (r.run, r.n_flag, r.n) for r in P.repeated(reports, flag).collect()}
    assert got(P.filler_start()) == slow_start and len(slow_start) > 8
    assert got(P.fast_start()) == fast and len(fast) > 5


def test_first_within(spark):
    marks = [(m, 100 * k + m, k) for m in range(5) for k in range(0, 40, 3)]
    points = [(m, t, "a" if t % 2 else "b") for m in range(6) for t in range(0, 4000, 137)]
    got = {(r.meeting_id, r.start_ms): r.k for r in E.first_within(spark.createDataFrame(points, "meeting_id long, start_ms long, kind string"), spark.createDataFrame(marks, "meeting_id long, start_ms long, k long"), "k", ["kind"], 120).collect()}
    assert len(got) == len(points)
    for m, t, _ in points:
        near = sorted((s, k) for x, s, k in marks if x == m and abs(s - t) < 120)
        assert got[m, t] == (near[0][1] if near else None)
