"""A training corpus from raw documents, in five stages of this package's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs.

Cases, in all stages: null and empty texts are documents like any other; no text is cut off, however long; ties
fall to the least doc_id, then to hashes of the text and the row, so that reruns agree; an empty table gives an
empty one; columns besides those of documents, whatever their names, are passed on unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, lines, mixing, neardup, quality
from lattica.llm._common import free_names, stash, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels outside the held-out fold, doesn't reject.

    Null and empty texts are scored as texts without words; repeated rows share a score; with fewer than two
    labels of a class, or none, every score is the share of label 1 (0.5 without labels), and all stay or go.
    """
    return quality.reject_poor(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that stand earlier; n_chars is that of the text left.

    Null text stays null; a text all of whose lines go becomes empty; rows that agree in doc_id and text
    are one document and keep the same; null doc_id comes first.
    """
    short = lines.dedup_runs(docs, names=free_names(docs, "n_lines", "n_removed"))
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return short.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate class.

    Null and empty texts are one class; texts without words are copies only of themselves; null doc_id comes
    last; of rows with the same doc_id and text, the one with the least hash of its other columns stays.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts are clean; repeated rows are judged alike; with an empty benchmark all stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: documents whose text is what the mix takes of it, with size, source_size, target and taken.

    Size is in words, of the text before; null and empty texts take nothing and become empty; null source is a
    source of its own; n_chars is that of the new text. Where documents has columns of the added names, these get
    underscores.
    """
    names = free_names(docs, "size", "source_size", "target", "taken", "mixed_text")
    new = names.pop("mixed_text")
    out = mixing.mixed(docs, names={**names, "mixed_text": new})
    text = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.length(new).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(text).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(c) for c in names.values()])


STAGES = [
    ("quality", keep_quality),
    ("lines", dedup_lines),
    ("near_duplicates", keep_one_of_near),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Neither the classifier nor the classes of near duplicates can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, f"pipeline-{name}")
    return docs
