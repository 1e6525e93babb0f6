"""A corpus pipeline of five operators: language ID, line dedup, n-gram Jaccard join, secret scans, packing.

Every stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and all but the last return the columns of
documents. run() writes each stage's rows as Parquet into the shared folder and reads them back for the next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import language, line_dedup, ngram_join, packing, secret_scan
from tidemill.llm.common import fold, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Share of rightly told rows that may lie under the level found there, and the part of that level which rejects.
TAIL, PART = 0.001, 0.6
#: Bins of a round in which ranks are followed: a round gathers so many counts at most for each of two ranks of a size.
BINS = 256


def low_levels(scores: DataFrame) -> dict[int, float]:
    """The score that a share of TAIL lies under, of each size in scores (size, score), as percentile() tells it from all rows.

    The two ranks at that place are followed by rounds of histograms until one value is left, so no group is gathered whole.
    """
    spans = scores.groupBy("size").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    at = {r["size"]: TAIL * (r["n"] - 1) for r in spans}
    found = {(r["size"], rank): (0, r["lo"], r["hi"]) for r in spans for rank in {math.floor(at[r["size"]]), math.ceil(at[r["size"]])}}
    bin_ = F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("bin")
    while wide := [(*key, *span[1:]) for key, span in found.items() if span[1] < span[2]]:
        asked = scores.sparkSession.createDataFrame(wide, "size int, rank long, lo double, hi double")
        met = scores.join(F.broadcast(asked), "size").where("score between lo and hi")
        bins = met.groupBy("size", "rank", bin_).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most")).collect()
        below = {(size, rank): found[size, rank][0] for size, rank, *_ in wide}
        for size, rank, _, n, least, most in sorted(bins):
            if below[size, rank] <= rank < below[size, rank] + n:
                found[size, rank] = (below[size, rank], least, most)
            below[size, rank] += n
    low, high = ({size: found[size, side(x)][1] for size, x in at.items()} for side in (math.floor, math.ceil))
    return {size: low[size] if low[size] == high[size] else (math.ceil(x) - x) * low[size] + (x - math.floor(x)) * high[size] for size, x in at.items()}


def least_score(told: DataFrame) -> Column:
    """The score under which a text is of no language that the machines know, by all labelled rows of told, which are outside the fit; 0 without any.

    Short texts score low and may be fine, so every doubling of length has its own level, and a length that no such doc has takes the lowest.
    Rows that repeat id, lang and text count once.
    """
    size = F.length(F.bin(F.length("text").cast("long")))
    right = told.where("lang_pred = lang").select("doc_id", "lang", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"), size.alias("size"), "score")
    levels = {size: PART * level for size, level in low_levels(stored(right.distinct().select("size", "score"), "scores")).items()}
    least = F.lit(min(levels.values(), default=0.0))
    for n, level in sorted(levels.items()):
        least = F.when(size == n, level).otherwise(least)
    return least


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Machines learn from docs themselves, of which a third is left out.

    Those without a letter go, and those that the machines score clearly lower than what they tell rightly in that third.
    Where nothing can be learned (no lang, or no text with a letter), only those without a letter go. Null texts go; null and
    repeated ids are judged by their text. Columns other than those of documents are dropped.
    """
    out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language.fit(docs.where(~out))
    if model.top is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = stored(language.identify(docs.select(*COLUMNS), model), "told")
    least = least_score(told.where(out))
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred earlier; one that is left with nothing by this goes.

    Exact repeats of every line that is not empty go. Near copies of lines may differ by more edits the longer they are. Null and
    empty texts, and rows without an id, stay as they are; repeated ids as in line_dedup. Other columns than those of documents are dropped.
    """
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS), line_dedup.grown, 1)
    gone = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    return cut.where(~gone | F.col("text").isNull()).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every class of near copies; documents without an id stay.

    Of rows that repeat both id and text one stays, with the least other columns; rows that repeat an id with another text are
    documents of their own. Null and empty texts are near to nothing. Columns other than those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    lead = ngram_join.told_apart(docs).where("leads and doc_id is not null").select("doc_id", "h1", "h2").distinct()
    hashed = docs.where("doc_id is not null").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), F.col("text"))})
    rest = F.struct("lang", "source", "n_chars")
    one = hashed.join(lead, ["doc_id", "h1", "h2"], "left_semi").groupBy("doc_id", "h1", "h2").agg(F.first("text").alias("text"), F.min(rest).alias("rest"))
    return one.select("doc_id", "text", "rest.*").unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret found replaced by a mark. Null texts, null and repeated ids stay; other columns are dropped."""
    return secret_scan.redact(docs.select(*COLUMNS))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all documents; a null text is empty, null and repeated ids have pieces of their own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_tokens),
]

#: SQL can express neither the models nor the tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = stored(docs, name)
    return docs
