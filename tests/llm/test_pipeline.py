"""The pipeline's stages against what each is to do with its own input."""

from collections import Counter
from itertools import combinations

import corpus_pipeline
from meetlake.llm import near_dedup
from meetlake.llm.common import table
from tests.llm.helpers import SCHEMA


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(after.count())
        if name in ("exact_dedup", "near_dedup"):
            assert after.groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "exact_dedup":
            assert {r.text or "" for r in after.collect()} == {r.text or "" for r in docs.collect()} and after.count() == len({r.text or "" for r in after.collect()})
        if name == "packing":
            tokens = Counter()
            for r in after.collect():
                tokens[r.doc_id] += r.length
            assert set(tokens) == {r.doc_id for r in docs.collect()}
        docs = after
    assert counts[0] >= counts[1] >= counts[2] > 0


def test_near_copies_are_brute_force(spark, sf):
    """Pairs of similarity 0.74 to 0.9, among them 0.80 to 0.85: what stays is what brute force at 0.8 keeps."""
    rows = []
    for family in range(80):
        base = [f"f{family}w{i}" for i in range(104)]
        rows += [(1000 - 2 * family, " ".join(base)), (1001 - 2 * family, " ".join([*base[: 104 - family % 10 - 5], *(f"f{family}x{i}" for i in range(family % 10 + 5))]))]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in combinations(sorted(sets), 2)}
    assert sum(0.8 <= s < 0.85 for s in alike.values()) == 24 and sum(0.7 < s < 0.8 for s in alike.values()) == 24
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA)
    for least, kept in ((80, corpus_pipeline.drop_near_copies(spark, docs, sf)), (85, near_dedup.keep(docs))):
        assert {r.doc_id for r in kept.collect()} == set(sets) - {b for (_, b), s in alike.items() if 100 * s >= least}


def test_trees_and_sketch_follow_from_the_similarity():
    for percent in (70, 80, 85, 90, 95):
        s, p = near_dedup.Settings(percent), percent / 100
        assert (1 - p**near_dedup.LEVELS) ** s.trees <= near_dedup.MISSED and 0 < s.least < s.hashes * p
    assert (near_dedup.Settings(85).trees, near_dedup.Settings(85).least) == (12, 28)
