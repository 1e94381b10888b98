"""Exact deduplication by sorting content.

Texts are compared after deleting white space. Sampled splitters deal the
normalised bytes into ranges, each range is sorted (Spark's sort spills), and
rows are grouped with their neighbours by comparing whole normalised texts.

The splitter key is a fixed-size digest of the normalised bytes, led by their
first ones, so the sample that reaches the driver has a bounded size whatever
the texts are. Its last part is a salt from the document id with as many
values as there are ranges: a text that makes up a third of all rows spreads
over many ranges, each holding some runs of it. Runs of one text are joined
afterwards from one small row per run.

Defined cases: a null text counts as empty, empty texts equal each other;
a null id comes after all others; of rows equal in text, length and id, one
is kept. Other columns stay as they are (columns of the result's names are
replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import documents, keep_one, tasks, text_key
from lumenframe.session import cut

LEAD = 8  # leading normalised bytes in the splitter key


def normalised(text: str = "text"):
    """Text without the six ASCII white-space characters."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\f\r", "")


def sorted_runs(df: DataFrame, text: str, ident: str) -> DataFrame:
    """Rows beside their equals: ``df`` with text_sha256 and, for its run (equal
    text, equal salt), _place (1 for the run's best row), _rows and _best."""
    n = tasks(df.sparkSession)
    keyed = df.withColumn("_norm", normalised(text)).withColumns({
        "text_sha256": F.sha2(F.col("_norm").cast("binary"), 256),
        "_lead": F.substring(F.col("_norm").cast("binary"), 1, LEAD),
        "_salt": F.pmod(F.xxhash64(ident), F.lit(n)).cast("int"),
        "_size": F.char_length(F.coalesce(F.col(text), F.lit("")))})
    # Grouping columns contain the range columns, so the window reuses the ranges and only sorts.
    ranged = keyed.repartitionByRange(n, "_lead", "text_sha256", "_salt")
    run = Window.partitionBy("_lead", "text_sha256", "_salt", "_norm")
    best = run.orderBy(F.desc("_size"), F.col(ident).asc_nulls_last())
    return ranged.select(
        *[c for c in keyed.columns if c != "_norm"],
        F.row_number().over(best).alias("_place"),
        F.count(F.lit(1)).over(run).alias("_rows"))


def exact_copies(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``df`` without its text, with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays.
    """
    plain = df.drop("keep_id", "group_size", "kept", "text_sha256")
    runs = cut(sorted_runs(plain, text, ident).drop(text))
    heads = runs.filter("_place = 1").select(
        "text_sha256", "_lead", "_salt", "_rows",
        F.struct((-F.col("_size")).alias("a"), F.col(ident).isNull().alias("b"), F.col(ident).alias("id"),
                 F.col("_salt").alias("salt")).alias("_best"))
    # At most one row per salt, and only of texts that have copies.
    whole = Window.partitionBy("text_sha256", "_lead")
    groups = (heads.withColumns({"_group": F.sum("_rows").over(whole), "_best": F.min("_best").over(whole)})
              .filter("_group > 1")
              .select("text_sha256", "_lead", "_salt", "_group", F.col("_best.id").alias("_keep"),
                      F.col("_best.salt").alias("_keep_salt")))
    alone = F.col("_group").isNull()
    return (runs.join(groups, ["text_sha256", "_lead", "_salt"], "left").select(
        *[c for c in plain.columns if c != text],
        F.when(alone, F.col(ident)).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_group", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("_place") == 1) & (F.col("_salt") == F.col("_keep_salt")))).alias("kept"),
        "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """Documents without their exact copies, columns unchanged."""
    decided = exact_copies(docs.select("doc_id", "text", text_key().alias("text_key")))
    return keep_one(docs, decided.select("doc_id", "text_key", "kept"))


@query("""
    WITH t AS (SELECT doc_id, coalesce(text, '') raw,
                      regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') norm FROM documents),
    g AS (SELECT *, row_number() OVER w place, count(*) OVER (PARTITION BY norm) n,
                 first_value(doc_id) OVER w keep_id
          FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id))
    SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    return exact_copies(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")
