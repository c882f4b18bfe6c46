"""The registered queries of the training-data operators: each applies its
operator to the whole table and derives the digest columns from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm import bpe, fim, langid, lattice, licenses, mixing, pii, quality, resample, secrets, sharding, simhash, warc
from vitrine.llm.common import shared_dir, table

#: The languages that the corpus is made of; any other text is undetermined.
LANGUAGES = ("en", "de", "fr", "es")


def tokenizer() -> tuple[str, str]:
    """Path of the rank file, and the pattern that splits text before it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), LANGUAGES, F.col("lang"))
    return d.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "stratum", "rejected_by")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = langid.identify(table(spark, sf_dir, "documents"), LANGUAGES, declared=F.col("lang"), host=F.col("source"))
    return d.withColumnRenamed("id", "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion where markup and addresses are at hand: raw pages."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", langid.host_of(F.col("url")).alias("host"), langid.declared_in_markup(F.col("html")).alias("declared"),
        F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ").alias("text"))
    d = langid.identify(pages, LANGUAGES, declared=F.col("declared"), host=F.col("host"), id_col="page_id")
    return d.withColumnRenamed("id", "page_id")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back: payloads
    of responses are decoded and digested anew, revisits are read from headers alone."""
    path = shared_dir(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.regexp_extract(c, f"^<{warc.URN}(-?[0-9]+)>$", 1).try_cast("long")
    responses = warc.read_warc(spark, path, ("record_id", "record_type", "payload")).where("record_type = 'response'").select(
        number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = warc.read_warc(spark, path, ("record_id", "record_type", "payload_length", "payload_digest", "refers_to"))
    revisits = heads.where("record_type = 'revisit'").select(
        number(F.col("record_id")), "payload_length", F.regexp_replace("payload_digest", "^sha256:", ""), "record_type",
        number(F.col("refers_to")))
    return responses.unionAll(revisits)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id", "kept")


#: No source is repeated more often than this in the mixture.
MAX_REPETITION = 1.5


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per use of a document: its epoch, its block, the block's place in the
    epoch's permutation and the document's slot in the block."""
    docs = table(spark, sf_dir, "documents")
    mixture = mixing.mix(docs, max_repetition=MAX_REPETITION)
    rows = mixing.realise(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("n_tokens")), mixture)
    slot = Window.partitionBy("source", "mix_epoch", "mix_block").orderBy(F.xxhash64("doc_id", "mix_epoch"), "doc_id")
    return rows.select("doc_id", "source", "n_tokens", "mix_epoch", "mix_block", "mix_turn",
                       (F.row_number().over(slot) - 1).alias("mix_slot"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_lattice_near_dedup": op1_lattice_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_secret_scan": op6_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_mixture": op9_mixture,
    "op10_kd_shards": op10_kd_shards,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_contextual_pii": op12_contextual_pii,
    "op13_fill_in_middle": op13_fill_in_middle,
    "language_id_pages": language_id_pages,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS s FROM p),
        f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s)
        SELECT d.page_id, n AS payload_bytes, d.s AS payload_digest,
            CASE WHEN first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> d.page_id THEN first END AS refers_to
        FROM d LEFT JOIN f ON d.s = f.s AND d.n >= 100""",
    # CRC-32 byte by byte, from the table of its 256 steps (polynomial EDB88320)
    "op11_importance_resampling": """
        WITH steps AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i:
            CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
        words_of AS (
            SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
            UNION ALL
            SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        each AS (SELECT side, id, unnest(ws) AS w FROM words_of),
        counted AS (SELECT side, id, w, count(*) AS n FROM each GROUP BY side, id, w),
        vocabulary AS (SELECT w, hex(encode(w)) AS h FROM counted GROUP BY w),
        crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2),
                lambda i: CAST('0x' || substring(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
                lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, steps),
        buckets AS (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t
            FROM counted JOIN crc USING (w) GROUP BY bucket),
        totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
        gain AS (SELECT bucket, floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE))
            / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS g FROM buckets, totals),
        weights AS (SELECT id, CAST(sum(n * g) AS BIGINT) AS weight FROM counted JOIN crc USING (w) JOIN gain USING (bucket)
            WHERE side = 'd' GROUP BY id),
        scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5e0)
                / 4294967296e0))) AS BIGINT) AS score
            FROM (SELECT id AS doc_id, ws FROM words_of WHERE side = 'd') LEFT JOIN weights ON doc_id = id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
            count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
        e AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substring(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1,
            CAST('0x' || substring(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substring(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || substring(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
        f AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
            array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM e)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM f""",
}
