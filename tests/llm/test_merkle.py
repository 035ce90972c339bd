"""The manifest against a plain tree, and the awkward cases."""

import hashlib
import random

from meetlake.llm import merkle
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, awkward, crc, empty


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(leaves, fanout):
    """The levels of a tree, and the path of each leaf as lists of the others of its run."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i - i % fanout : i - i % fanout + fanout]
            path.append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def plain(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, path) of rows in the order of SCHEMA."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((-(1 << 63) if r[0] is None else r[0], leaf_of(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: tree([leaf for _, leaf, _ in sorted(langs[x], key=lambda y: y[:2])], fanout) for x in order}
    root, above = tree([built[x][0] for x in order], fanout)
    out = []
    for x, up in zip(order, above):
        for (_, leaf, r), path in zip(sorted(langs[x], key=lambda y: y[:2]), built[x][1]):
            out.append((r[0], leaf, built[x][0], root, tuple((at, tuple(o)) for at, o in path + up)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.at, tuple(s.others)) for s in r.path)) for r in df.collect()), key=repr)


def test_plain(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a", "é\n" * 3, f"t{i}"]), rng.choice([None, "en", "de", "日", "", "x-only"]), rng.choice([None, "s", ""]), rng.choice([None, 3, -7])) for i in range(150)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, SCHEMA)
    for fanout in (2, 3, 7):
        assert got(merkle.manifest(docs, fanout)) == plain(rows, fanout), fanout


def test_tampering_is_found(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de", "s", 2**63 - 1 if i == 1 else None if i % 4 == 0 else i) for i in range(80)]
    found = merkle.verify(merkle.manifest(spark.createDataFrame(rows, SCHEMA))).collect()
    for r in found:
        own = rows[r.doc_id]
        changed = crc(r.doc_id) % 7 == 0 and own[4] is not None
        assert r.verified is (not changed) and r.verified == (r.folded_root == r.root)
        assert r.proof_sha256 == sha(*(o for s in r.path for o in s.others))
        if changed:
            assert r.tampered == leaf_of(*own[:4], own[4] + 1)
    assert any(not r.verified for r in found) and len(found) == 80
    moved = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5, "text")).collect()
    assert {(r.doc_id, r.root, str(r.path)) for r in moved} == {(r.doc_id, r.root, str(r.path)) for r in found}


def test_edges(spark):
    assert merkle.verify(merkle.manifest(empty(spark))).collect() == []
    one = merkle.verify(merkle.manifest(spark.createDataFrame([(1, "a", None, None, None)], SCHEMA))).collect()
    assert one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].path == [] and one[0].proof_sha256 == sha("")
    docs = awkward(spark, extra=True)
    for name in ("tree", "idx", "n", "uid", "range", "path", "children"):
        docs = docs.withColumn(name, F.lit("own"))
    base = awkward(spark)
    assert got(merkle.manifest(docs)) == got(merkle.manifest(base)) == plain([tuple(r) for r in base.collect()], 2)
