"""From raw documents to packed training sequences: five stages, each a DataFrame written before the next reads it.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``docs``. Every stage is defined for nulls, empty texts, repeated rows and empty tables as its operator is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from tallyspark.llm.queries import fold
from tallyspark.plans.keyed import cut


def modest_batches(spark: SparkSession) -> None:
    """Hands whole texts to Python in batches of 2,000 rows instead of 10,000: several are held at once on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a language: texts without letters, and those the code cannot decide on, go. Null ``lang`` is filled."""
    modest_batches(spark)
    out = language_id.identify(docs, fold(4) != 2).filter((F.col("lang_pred") != "und") & ~F.col("lang_ambiguous"))
    return out.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of three-line windows; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs).filter((F.col("n_cut") == 0) | (F.col("row.text") != ""))
    length = F.char_length("row.text").cast("long")
    return out.select(*[F.when(F.col("n_cut") > 0, length).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component (five-word shingles, 0.8) the document with the smallest id stays, once for each text of it."""
    modest_batches(spark)
    found = ngram_join.near_duplicates(docs, words=5, percent=80).filter("component_id = doc_id and n_shingles > 0").select("doc_id").distinct()
    worded = F.col("text").rlike(r"[^ \t\n\x0B\f\r]") & F.col("doc_id").isNotNull()
    first = docs.filter(worded).join(found, "doc_id", "left_semi").select(*docs.columns)
    plain = docs.filter(~F.coalesce(worded, F.lit(False)))
    return first.dropDuplicates(["doc_id", "text"]).unionByName(plain)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark passages go; the others stay as they are."""
    modest_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.judged(decontaminate.find_passages(docs, benchmark, whole_rows=True))
    return found.filter("not contaminated").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, at most 2048 ids a sequence."""
    modest_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(packing.tokenize(docs, ranks, public_tokenizers.PATTERN, capacity=2048, end=0), capacity=2048)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Language ID and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
