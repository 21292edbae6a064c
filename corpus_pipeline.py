"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept:

1. toxicity: documents that the classifier marks toxic go;
2. quality: documents whose tail probability of a fair grade is too low go;
3. near duplicates: one document of each group of near copies stays (five-word shingles, similarity 0.8);
4. decontamination: passages of benchmark items are cut out, documents that are mostly such passages go;
5. packing: what is left is tokenized and packed into sequences of 4096 ids.

The first four return the columns of ``documents``. ``run`` writes each result as Parquet to the
shared checkpoint folder and reads it again for the next stage, so a lost
executor costs the stage it was in. The classifiers learn from ``labels`` joined to the
rows that are there. Rows with NULLs, empty texts and repeated rows are handled as the operators state;
an empty ``documents`` gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlake.llm import decontaminate, neardup, packing, quality, toxicity
from wardlake.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weight, cuts = quality.fit(docs, quality.ratings(table(spark, sf_dir, "labels")), quality.GRADES)
    return quality.selected(docs, weight, cuts)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs, width=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifiers, the tokenizer or the packing; tests/llm compares every stage with its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row per packed piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
