"""The training-data pipeline over ``documents``: named stages, each written and read again.

toxicity drops documents predicted toxic; exact dedup keeps one document of each
text; the n-gram Jaccard join keeps one of each group of near copies; mixing puts
all of them into a mixture of the sources at their target weights, which sources leave
when they are used up, and adds each one's slot as the column mix_slot; best-fit packing
fills bins from runs of consecutive slots of that column and gives each piece its slot.
The stages before mixing return the columns of documents.
"""

from __future__ import annotations

from corpus_guard.llm.exact_dedup import drop_duplicates
from corpus_guard.llm.mixing import with_slots
from corpus_guard.llm.ngram_join import drop_near_duplicates
from corpus_guard.llm.packing import pack
from corpus_guard.llm.staging import stage
from corpus_guard.llm.toxicity import drop_toxic


def toxicity(spark, docs, sf_dir):
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark, docs, sf_dir):
    return drop_duplicates(docs)


def ngram_jaccard(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


def mixing(spark, docs, sf_dir):
    return with_slots(docs, "mix_slot")


def packing(spark, docs, sf_dir):
    """Runs of consecutive slots, as the stage before has written them."""
    return pack(docs, slot_col="mix_slot")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("packing", packing),
]

#: The scores of the first stage come from a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
