"""A training corpus from ``documents``: toxic texts out, near copies out, repeated passages out, sources mixed, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet and rereads it for the next.
``docs`` has at least the columns doc_id and text, and source where sources are mixed; n_chars follows the text where it is there.
All other columns are carried unread, whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relengine.llm.common import Scratch, by_place, table
from relengine.llm.mixing import mixed_documents
from relengine.llm.packing import pack, tokenizer_path
from relengine.llm.simhash import one_of_each
from relengine.llm.substring import remove_repeats
from relengine.llm.toxicity import THRESHOLD, with_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity; the rest go.

    A null or empty text scores low and stays; a null doc_id is no matter; repeated rows score alike and all stay or go; at the threshold a
    document goes; a label of a missing document, a null one or one other than 0 and 1 teaches nothing.
    """
    scored = with_scores(spark, docs, table(spark, sf_dir, "labels"), "score")
    plain = scored.toDF(*[f"c{i}" for i in range(len(scored.columns))])
    score = plain.columns[-1]
    return plain.where(F.col(score) < THRESHOLD).drop(score).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least doc_id.

    Rows without a doc_id come last, so they stay only where a group has no other; all null, empty and blank texts are one group.  Of rows of
    one doc_id, the one of the text of least hash stays, of those that are still tied, the least by all columns.
    """
    return one_of_each(spark, docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that one of smaller doc_id has; texts that lost nothing are unchanged.

    A null text stays null, one that lost all its words becomes empty; rows without a doc_id neither lose words nor make others lose them;
    rows of equal doc_id, as repeated ones, don't affect each other.
    """
    plain, name = by_place(docs)
    special = {name[c]: c for c in ("doc_id", "text", "n_chars") if c in name}
    carried = tuple(c for c in plain.columns if c not in special)
    found = remove_repeats(spark, plain.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"), *carried), carry=carried)
    column = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[column[special[c]] if c in special else F.col(f"c_{c}") for c in plain.columns]).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them: a row for each epoch that one is in, cut at each source's budget.

    A null source is one, the last; documents without words (null texts too) aren't taken; repeated rows each count; ties of the random order
    are settled by doc_id, size and a hash of the text, and rows that are still tied at a cut are each cut there.
    """
    return mixed_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 ids.

    A null or empty text is the end id alone; repeated rows are packed each; a null doc_id is kept; other columns are left out.
    """
    plain, name = by_place(docs)
    return pack(spark, plain.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text")), tokenizer=tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", drop_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: A learned stage and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier one's are a table in the shared folder."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if i > 0:
            scratch.drop(STAGES[i - 1][0])
    return docs
