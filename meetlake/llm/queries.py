"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm import alignment, ann, exact_dedup, language_id, language_model, merkle, mixing, near_dedup, packing, quality, suffix_dedup, toxicity, warc
from meetlake.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def alignment_settings(**more) -> alignment.Settings:
    import public_tokenizers

    return alignment.Settings(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN, **more)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.marked(table(spark, sf_dir, "documents"), percent=85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dedup.mark(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")

def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return language_id.predict(docs, language_id.fit(docs, pieces), pieces)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), alignment_settings())


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_toxicity, op4_nearest, op5_near_dedup, op6_quality, op7_exact_dedup, op8_mixing, op9_language_model, op10_warc, op11_language_id, op12_alignment, op13_merkle)}

ORACLE = {
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (10 * (k // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
    "op13_merkle": """
        WITH RECURSIVE d AS (
            SELECT *, [CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text, (n_chars + 1)::VARCHAR]] AS f,
                xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 7 AS crc
            FROM documents
        ),
        h AS (SELECT doc_id, lang, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf, CASE WHEN crc = 0 THEN sha256(f[1] || f[2] || f[3] || f[6] || f[5]) END AS tampered FROM d),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS rid FROM h),
        tree AS (
            SELECT lang, 0 AS step, list(leaf ORDER BY idx) AS xs FROM leaves GROUP BY lang
            UNION ALL
            SELECT lang, step + 1, list_transform(range((len(xs) + 1) // 2), lambda i: sha256(xs[2 * i + 1] || coalesce(xs[2 * i + 2], ''))) FROM tree WHERE len(xs) > 1
        ),
        subroots AS (SELECT lang, xs[1] AS subroot, step AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS sub FROM tree WHERE len(xs) = 1),
        top AS (
            SELECT 0 AS step, list(subroot ORDER BY sub) AS xs FROM subroots
            UNION ALL
            SELECT step + 1, list_transform(range((len(xs) + 1) // 2), lambda i: sha256(xs[2 * i + 1] || coalesce(xs[2 * i + 2], ''))) FROM top WHERE len(xs) > 1
        ),
        steps AS (
            SELECT rid, step, (idx >> step) & 1 AS side, xs[xor(idx >> step, 1) + 1] AS sibling FROM leaves JOIN tree ON leaves.lang IS NOT DISTINCT FROM tree.lang WHERE len(xs) > 1
            UNION ALL
            SELECT rid, height + step, (sub >> step) & 1, xs[xor(sub >> step, 1) + 1] FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.lang, top WHERE len(xs) > 1
        ),
        folds AS (
            SELECT rid, 0 AS step, coalesce(tampered, leaf) AS digest FROM leaves
            UNION ALL
            SELECT f.rid, f.step + 1, CASE side WHEN 0 THEN sha256(digest || coalesce(sibling, '')) ELSE sha256(sibling || digest) END FROM folds f JOIN steps USING (rid, step)
        ),
        proofs AS (SELECT rid, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM leaves LEFT JOIN steps USING (rid) GROUP BY rid),
        ends AS (SELECT rid, max_by(digest, step) AS folded_root FROM folds GROUP BY rid)
        SELECT doc_id, leaf, subroot, r.root, proof_sha256, folded_root, folded_root = r.root AS verified
        FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.lang JOIN proofs USING (rid) JOIN ends USING (rid), (SELECT xs[1] AS root FROM top WHERE len(xs) = 1) r
    """,
}
