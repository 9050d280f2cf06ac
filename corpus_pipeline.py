"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. A stage decides by row: null
and repeated ids, and a row that is there twice, cost no other text. Extra
columns are carried along, whatever their names; an empty table gives an empty
result in every stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.llm import exact_dedup, langid, packing, simhash, suffix_dedup
from factspark.llm.common import saved

#: Bytes of the repeated strings that the suffix stage removes: 50 words of five bytes, the space included.
REPEAT_BYTES = 250


def language_id(spark, docs, sf_dir):
    """Documents whose language the compression classifier accepts; learned from the stage's own labelled rows.

    Null texts and texts without a letter go; without any labelled row nothing is accepted.
    """
    told = langid.predict(docs, langid.fit_dictionaries(docs, lambda doc_id: F.lit(False)))
    return told.filter("accepted").select("row.*")


def exact(spark, docs, sf_dir):
    """Of equal texts, one row: that with the largest id, any id before a null one. Null counts as empty."""
    return exact_dedup.keep_one(docs)


def near(spark, docs, sf_dir):
    """Of near-duplicates (five words, similarity of 0.8 or more), one row: that with the smallest id, any id before a null one.

    Rows without words have no near-duplicates and stay.
    """
    return simhash.keep_one(docs)


def suffix_array(spark, docs, sf_dir):
    """Texts without the bytes of repeated strings of REPEAT_BYTES, all copies but that of smallest address.

    So each passage stays in one document; a document that is cut and left without
    anything but white space goes. Null, empty and short texts stay as they are. A cut inside a character takes
    that character. n_chars follows the text where there is such a column.
    """
    cut = suffix_dedup.remove_repeats(docs, width=REPEAT_BYTES, keep_first=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length(text)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    left = cut.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike("\\S"))
    return left.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 2048 tokens; null texts are an end id alone."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("suffix_array_dedup", suffix_array), ("packing", pack)]

#: No SQL: compression, tokens and a linear program can't be expressed in it.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of all stages on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
