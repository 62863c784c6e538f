"""A corpus pipeline of five stages, each the table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, minhash, mixing, suffixes, toxicity
from palimpsest.llm.exchange import written
from palimpsest.llm.queries import held_out, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside its held-out fold, calls toxic go."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keys=COLUMNS).filter(~toxicity.toxic()).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return minhash.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out of the text; of a
    character that a cut splits, the rest is marked as U+FFFD."""
    cut = suffixes.remove_repeats(docs, keep=("lang", "source")).withColumn("text", F.expr("make_valid_utf8(cast(kept AS string))"))
    return cut.select(F.col("_id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents are left out, cut, or repeated up to three times."""
    mixed = mixing.mixed_documents(docs.select(*COLUMNS))
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text (little-endian 32-bit), and the hash of what they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keys=("doc_id", "lang", "source"))
    decoded = bpe.decode(encoded, ranks, keep=("doc_id", "lang", "source", "ids"))
    return decoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mix", mix),
    ("bpe", tokenize),
]

#: The stages hold models, samples and merges that SQL cannot state; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
