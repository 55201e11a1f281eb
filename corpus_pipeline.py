"""A corpus pipeline over documents: quality, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last keep the columns of documents.
"""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from tremor.llm import jaccard, mixing, packing, quality, repeats
from tremor.llm.shared import shared_folder
from tremor.storage import files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_copies_stage(spark, docs, sf_dir):
    """Of each group of near copies the document with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def repeats_stage(spark, docs, sf_dir):
    """Passages of 50 words or more are cut from all places but their first."""
    return repeats.cut_repeats(docs)


def mixing_stage(spark, docs, sf_dir):
    """All documents, in the order that keeps every source within a block of its target share."""
    return mixing.in_order(docs)


def packing_stage(spark, docs, sf_dir):
    """Where each piece of each document goes in sequences of 2048 tokens, which are numbered in the order of the mix.

    That order is the one of the files that the stage before wrote, and of the rows in them.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return packing.pack(docs, TOKENIZER, order=(part, F.col("_metadata.row_index")))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The stages learn a model, close a relation and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; between them files in the shared checkpoint folder.

    A stage's files go when the next one is written; the last ones when the session ends.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            there, system = files(spark, before)
            system.delete(there, True)
        before = path
    there, system = files(spark, folder)
    system.deleteOnExit(there)
    return STAGES[-1][1](spark, docs, sf_dir)
