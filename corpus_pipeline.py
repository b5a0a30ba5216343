"""Documents to token ids, stage by stage.

Each stage takes all that its predecessor kept, as a table that was written and
read again; what a stage rejects is gone.  Documents may have any further
columns, under any names; all stages but the last hand them on.  ``run`` deletes
the scratch tables of a stage once its result is written and each stage's table
once the next one is; the last stage is lazy and reads the one table that stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphledger.llm.common import delete, keep_rows, read_table, scratch, shared_dir, shielded
from glyphledger.llm.decontaminate import find_contamination
from glyphledger.llm.exact_dedup import exact_dedup
from glyphledger.llm.near_dedup import near_keepers
from glyphledger.llm.queries import tokenizer_file
from glyphledger.llm.sentencepiece_codec import encode_sentencepiece
from glyphledger.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark, docs, sf_dir):
    """Documents that score a half or more for toxicity go."""
    model = fit_toxicity(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    plain, names = shielded(docs)
    return score_toxicity(plain, model, names).filter(F.col("score") < 0.5).select(*names).toDF(*docs.columns)


def exact(spark, docs, sf_dir):
    """Of documents equal but for white space the longest stays."""
    return keep_rows(docs, exact_dedup(docs.select("doc_id", "text")).filter("kept"))


def near(spark, docs, sf_dir):
    """Of documents linked by five-word shingles, at a Jaccard similarity of 0.8 or more, that with the smallest doc_id stays."""
    return keep_rows(docs, near_keepers(docs.select("doc_id", "text")))


def decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    plain, names = shielded(docs)
    found = find_contamination(plain, read_table(spark, sf_dir, "benchmark"), names)
    return found.filter("n_hit = 0").select(*names).toDF(*docs.columns)


def sentencepiece(spark, docs, sf_dir):
    """Token ids of what is left, with parity and round trip of each text."""
    return encode_sentencepiece(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the learned scores nor the fingerprints' components nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each but the last is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    at, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        if before:
            delete(spark, before)
        before = f"{at}/{k}-{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
