"""Alignment against whole texts encoded at once and loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import sentencepiece
from meetlake.llm import alignment
from meetlake.llm.queries import alignment_settings, tokenizer_path
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, awkward, empty
from tokenizers import Tokenizer


def plain(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()
    rows, links = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        names = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(ids_b, names)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        end_a, end_b = (list(accumulate(map(len, parts))) for parts in (bytes_a, bytes_b))
        common, groups, own, i, j = set(end_a) & set(end_b), [], [], 0, 0
        group = ([], [])
        while i < len(ids_a) or j < len(ids_b):
            own.append((ids_a[i], ids_b[j]))
            x, y = end_a[i], end_b[j]
            if x <= y:
                group[0].append(ids_a[i])
                i += 1
            if y <= x:
                group[1].append(ids_b[j])
                j += 1
            if x == y and x in common:
                groups.append(group)
                group = ([], [])
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), len(own), hashlib.sha256(written.encode()).hexdigest()))
        links.append(own)
    count, best = Counter(p for own in links for p in set(own)), defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(*r[:4], sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), r[4]) for r, own in zip(rows, links)]


def got(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = [
    "a", " ", "  ", "a ", " a", "a  b", "a\n b \n\nc", "\n", "\tx  \t y", "x\r\ny \r z", "non breaking   space", "▁x y", "x ▁ y", "<s> </s> <unk> <|endoftext|> <0x41>", "it's we'll  I'd", "日本語 の テキスト", "ȿɐ ɣ 𝔘 🙂🙂 é", "\x00 \x1c \x85 x",
    "1234567 89 $$$ ### ** -- ", "aaaa" * 300, "word " * 500, "ünïcödé ёлка ", "  x 　 y", "x" * 70 + " " + "x" * 70,
]


def test_plain(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(3)
    odd = ODD + ["".join(rng.choice(" \n\té▁a b.'s日🙂\r") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = [*docs, *((1000 + i, t) for i, t in enumerate(odd)), (5000, None), (5001, ""), (5002, docs[0][1]), (5002, docs[0][1])]
    want = sorted((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    assert got(alignment.align(table, alignment_settings())) == want
    small = alignment_settings(chunk_bytes=100_000, split_chunks=3, stripes=1000, held_keys=500)  # many chunks, splits and forgotten words
    assert got(alignment.align(table, small)) == want


def test_edges(spark):
    assert alignment.align(empty(spark), alignment_settings()).collect() == []
    s = alignment_settings()
    plain_rows = alignment.align(awkward(spark), s)
    extra = awkward(spark, extra=True).withColumn("chunk", F.lit("own")).withColumn("n_a", F.lit(-1))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(plain_rows) == key(alignment.align(extra, s))
    rows = {r.doc_id: r for r in plain_rows.collect()}
    assert (rows[4].n_a, rows[4].groups_sha256) == (0, "") == (rows[5].n_a, rows[5].groups_sha256)
    assert rows[None].n_a > 0 and rows[10].n_links >= 60000
    none = alignment.align(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA), s)
    assert [(r.doc_id, r.n_links, r.count_sum) for r in none.orderBy("doc_id").collect()] == [(1, 0, 0), (2, 0, 0)]
