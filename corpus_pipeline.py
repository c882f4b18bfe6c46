"""The corpus pipeline: language ID, near-duplicates, secrets, mixture, token ids.

``STAGES`` lists (name, function); every function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read back as the ``docs``
of the next stage. All but the last return the columns of ``documents``; other
columns of ``docs`` are dropped. Each stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bpe, langid, mixing, secrets, simhash
from vitrine.llm.common import freeze, shared_dir, table
from vitrine.llm.queries import LANGUAGES, MAX_REPETITION, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``_row``, written out: ids may be null or repeated, row numbers may not change."""
    return freeze(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: other scripts, and texts without letters.
    Null, empty and letterless texts go too; every row is judged by itself, whatever its id."""
    rows = _numbered(docs)
    model = langid.fit_text_model(rows, F.col("lang"), LANGUAGES)
    judged = langid.identify(rows, LANGUAGES, declared=F.col("lang"), host=F.col("source"), model=model, id_col="_row")
    gone = judged.where("NOT kept").select(F.col("id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash class stays, the one with the smallest doc_id (nulls
    last, then the first row): three-word shingles, at most three bits apart."""
    rows = _numbered(docs)
    classes = simhash.simhash_classes(rows, id_col="_row", shingle=3, max_bits=3).select(F.col("id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(classes, "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become ``[secret]``, ``n_chars`` follows."""
    docs = docs.select(*COLUMNS)
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources come again, as often as the mixture takes them."""
    docs = docs.select(*COLUMNS)
    return mixing.realise(docs, mixing.mix(docs, max_repetition=MAX_REPETITION)).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decoded_ok``: one row per use of a document."""
    path, pattern = tokenizer()
    docs = docs.select(*COLUMNS)
    enc = bpe.encode(docs, path, pattern, keep=("source",), check=True)
    return enc.select(F.col("id").alias("doc_id"), "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_ok")


STAGES = [
    ("language ID", language),
    ("simhash near-dedup", near_duplicates),
    ("secret scan", secret_scan),
    ("mixture", mixture),
    ("byte-level BPE", token_ids),
]

#: Trigram models, fingerprints, inferred automata and token ids cannot be written in
#: SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the folder
    named by ``spark.checkpoint.dir``."""
    docs, out = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{out}/stage{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
