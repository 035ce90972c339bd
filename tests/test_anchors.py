"""Quotes, anchors, rate limits and values of text, by small cases and plain brute force."""

import random
from difflib import SequenceMatcher

from meetlake.functions import text as T
from meetlake.operators import catalog as K
from meetlake.operators import quotes as Q
from meetlake.operators import segment as G
from meetlake.plans import texts
from meetlake.plans.queries import sentenced
from pyspark.sql import functions as F


def best_ratio(query, keys, slack=3):
    """Every window compared, by words."""
    n = len(query)
    rows = [(SequenceMatcher(None, query, keys[a : a + k], autojunk=False).ratio(), -abs(k - n), -k, -a) for k in range(max(1, n - slack), n + slack + 1) for a in range(len(keys) - k + 1)]
    top = max(r[0] for r in rows)
    return max(r for r in rows if r[0] > top - 1e-9) if top >= 0.8 else None


def test_match_is_brute_force():
    rng, hits = random.Random(5), 0
    for _ in range(200):
        keys = [rng.choice("abcdefgh") for _ in range(60)]
        a, n = rng.randrange(40), rng.randrange(5, 12)
        query = keys[a : a + n]
        query[rng.randrange(n)] = "z"
        want, got = best_ratio(query, keys), Q.match(query, keys, by_char=2.0)
        assert (want is None) == (got is None)
        if want:
            hits += 1
            assert abs(got[2] - want[0]) < 1e-9 and got[:2] == (-want[3], -want[2])
    assert hits > 100


def test_match_edges():
    assert Q.match([], ["a"]) is None and Q.match(["a"], []) is None and Q.match(["a", "b"], ["x", "y"]) is None
    assert Q.match(["ээ", "привет"], ["э", "э", "привет"])[0] in (0, 1)


def test_rate_limit(spark):
    rows = [(i, i % 3 if i % 2 else 0, (i * 37) % 5000) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.allowed for r in K.rate_limited(df, 5, 600).collect()}
    held = {}
    for i, user, s in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        recent = [t for t in held.get(user, []) if s - t < 600]
        assert got[i] == (len(recent) < 5)
        held[user] = recent + [s] * (len(recent) < 5)
    assert len(got) == 400


def test_text_values(spark):
    one = lambda f, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(f(F.col("t"))).collect()]
    assert one(T.parse_timecode, "83", "1:23", "[01:23]", "83,5", "1:02:03", "junk", "1:x", None, "") == [83.0, 83.0, 83.0, 83.5, 3723.0, 0.0, 0.0, 0.0, 0.0]
    assert one(T.json_block, 'a {"b": {}} c', 'x ```json\n{"a": 1}\n``` {', "none") == ['{"b": {}}', '{"a": 1}', None]
    assert one(lambda c: T.as_enum(c, ["one_on_one"], {"1_1": "one_on_one"}, "other"), " One-on one", "1-1", None) == ["one_on_one", "one_on_one", "other"]


def test_anchor(spark):
    said = spark.createDataFrame([(1, 0, 0, False, "we begin here"), (1, 1, 5000, True, "when is the launch date?"), (1, 2, 9000, False, "in the launch week")], "meeting_id long, sentence_i long, start_ms long, is_question boolean, text string")
    asked = spark.createDataFrame([(1, 0, 9000, "the launch date"), (1, 1, 9000, "unheard words"), (1, 2, 90_000, "unheard words")], "meeting_id long, question_id long, start_ms long, question string")
    assert {r.question_id: (r.sentence_i, r.score) for r in Q.anchor(asked, said).collect()} == {0: (1, 1.1), 1: (1, None), 2: (None, None)}


def test_anchor_terms(spark):
    words = spark.createDataFrame([(1, i, 1000 * i, w) for i, w in enumerate("we use a feature flag to ship".split())], "meeting_id long, i long, start_ms long, text string")
    said = spark.createDataFrame([(1, 0), (1, 4000)], "meeting_id long, start_ms long")
    terms = spark.createDataFrame([(1, 0, 0, "Feature flag"), (1, 1, 3500, "canary"), (1, 2, 90_000, "canary"), (2, 0, 70, "canary")], "meeting_id long, term_id long, start_ms long, term string")
    got = {(r.meeting_id, r.term_id): (r.at_ms, r.how) for r in Q.anchor_terms(terms, words, said).collect()}
    assert got == {(1, 0): (3000, "said"), (1, 1): (4000, "near"), (1, 2): (90_000, "own"), (2, 0): (70, "own")}


def test_anchor_question_is_brute_force(spark, sf):
    """Every sentence of the track against every sentence of its meeting."""
    keys = lambda t: {k for k in t if len(k) > 2} or set(t) - {""}
    s = G.sentences(sentenced(spark, sf)).where("track = 'system'").withColumn("ks", F.transform(F.split("text", r"\s+"), T.match_key))
    s = s.withColumn("qs", F.transform(F.split(F.regexp_replace("text", r"^\S+\s+", ""), r"\s+"), T.match_key))
    of = {}
    for r in s.collect():
        of.setdefault(r.meeting_id, []).append(r)
    want, unsaid = {}, 0
    for m, own in of.items():
        for q in own:
            d, qk, best = lambda r: abs(r.start_ms - q.start_ms), keys(q.qs), None  # noqa: B023, E731
            for r in own:
                like = SequenceMatcher(None, [k for k in q.qs if k], [k for k in r.ks if k], autojunk=False).ratio()
                if qk and (like := max(like, len(qk & keys(r.ks)) / len(qk))) >= 0.5:
                    rank = (round(like + 0.1 * r.is_question, 6), -d(r), -r.sentence_i)
                    best = max(best or rank, rank)
            if best:
                want[m, q.sentence_i] = (-best[2], best[0])
                continue
            unsaid += 1
            near = [r for r in own if r.is_question and d(r) <= 20_000] or [r for r in own if d(r) <= 20_000]
            want[m, q.sentence_i] = (min(near, key=lambda r: (d(r), r.start_ms, r.sentence_i)).sentence_i, None)
    got = {(r.meeting_id, r.question_id): (r.sentence_i, r.score) for r in texts.anchor_question(spark, sf).collect()}
    assert set(got) == set(want) and len(want) > 5 * len(of)
    for k, (i, score) in want.items():
        assert got[k][0] == i and (got[k][1] is None) == (score is None) and (score is None or abs(got[k][1] - score) < 1e-6)


def test_ratio_join_keeps_every_pair(spark):
    """Texts of one meeting in all pairs: no pair whose ratio reaches a half is left out, and few others are met."""
    rng = random.Random(8)
    texts = [(1, i, [rng.choice("abcdefghijklmnopqrstuvwxyzabab") for _ in range(rng.randrange(0, 14))]) for i in range(120)]
    said = spark.createDataFrame(texts, "meeting_id long, sentence_i long, sa array<string>")
    asked = spark.createDataFrame([(1, i, k) for _, i, k in texts[:60]], "meeting_id long, question_id long, qa array<string>")
    met = {(r.question_id, r.sentence_i) for r in Q.alike(asked, said).collect()}
    alike = {(i, j) for _, i, a in texts[:60] for _, j, b in texts if a and b and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.5}
    assert alike <= met and len(alike) > 60 and len(met) < 0.7 * 60 * 120
    got = spark.createDataFrame([(a, b) for _, _, a in texts[:30] for _, _, b in texts[:30]], "a array<string>, b array<string>").withColumn("r", Q.sequence_ratio("a", "b")).collect()
    for r in got:
        want = SequenceMatcher(None, r.a, r.b, autojunk=False).ratio() if r.a or r.b else 0
        assert r.r == want if want >= 0.5 else r.r in (0, want) or not (r.a or r.b)


def test_find_by_blocks_is_match_over_whole_meetings(spark):
    """Blocks of a few words, one meeting far longer than the others; quotes with wrong words and wrong letters."""
    rng = random.Random(11)
    word = lambda: rng.choice(["lantern", "meadow", "copper", "signal", "harbor", "willow", "ember", "quartz", "thicket", "marble"]) + rng.choice(["", "s", "ed"])
    said = {m: [word() if rng.random() > 0.1 else "..." for _ in range(n)] for m, n in ((1, 400), (2, 30), (3, 9), (4, 1))}
    words = spark.createDataFrame([(m, 2 * i, 100 * i, w) for m, own in said.items() for i, w in enumerate(own)], "meeting_id long, i long, start_ms long, text string")
    asked = []
    for m, own in said.items():
        for _ in range(25):
            a, n = rng.randrange(len(own)), rng.randrange(1, 10)
            q = own[a : a + n]
            if rng.random() < 0.5:
                q[rng.randrange(len(q))] = rng.choice(["zzz", "lanterm", "signall"])
            elif rng.random() < 0.5:
                q = [w[:-1] if len(w) > 4 else w for w in q]
            asked.append((m, len(asked), " ".join(q)))
    asked += [(1, 900, ""), (1, 901, "..."), (9, 902, "lantern"), (4, 903, "lantern meadow copper signal harbor")]
    got = {r.quote_id: r for r in Q.find(spark.createDataFrame(asked, "meeting_id long, quote_id long, quote string"), words, block=8).collect()}
    key = lambda w: "" if w == "..." else w
    found = 0
    for m, i, q in asked:
        held = [(k, w) for k, w in enumerate(said.get(m, [])) if key(w)]
        want = Q.match([w for w in q.split() if key(w)], [w for _, w in held])
        assert (i in got) == (want is not None), (m, i, q)
        if want:
            a, n, ratio = want
            found += 1
            assert (got[i].start_ms, got[i].word_to, got[i].ratio) == (100 * held[a][0], 2 * held[a + n - 1][0], round(ratio, 6)), (m, i, q)
    assert found > 70
