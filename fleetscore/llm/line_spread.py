"""Removal of lines that many distinct sites share.

A line is a text's part between line feeds, trimmed of blanks, tabs and carriage returns. Each distinct line
(128-bit hash) gets a HyperLogLog sketch of the sites it is on; sketches are built in the map tasks and merged
by the aggregation, so a line that is everywhere shuffles one sketch per task. Lines whose estimate is far from
the threshold are decided by it; those within four standard errors get an exact count of distinct sites. A
shared line stays in one place, its first: the smallest (doc_id, text hash, place). All steps are DataFrame
functions.

A null site counts as a site of its own. Null texts stay null; empty lines are never shared lines, and neither are lines of
fewer than `min_words` words, if a caller asks for more than one; in a script without blanks each character counts as a word. Rows equal in doc_id and text are treated alike. In a null doc_id's text lines are
removed like in others; nulls come first in the order that picks a line's place to stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import UNIT, settle, text_key

KEY = ["l1", "l2"]
BLANKS = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """(doc_id, t1, t2, pos, l1, l2, site) of every line that may be a shared one."""
    t1, t2 = text_key(F.col("text"))
    lines = docs.where("text is not null").select(
        "doc_id", t1.alias("t1"), t2.alias("t2"),
        F.when(F.col(site).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(site))).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.regexp_count("line", F.lit(UNIT)) >= min_words)
    l1, l2 = text_key(F.col("line"))
    return lines.select("doc_id", "t1", "t2", "site", "pos", l1.alias("l1"), l2.alias("l2"))


def shared_lines(lines: DataFrame, min_sites: int = 5, lg_k: int = 12) -> DataFrame:
    """(l1, l2, home) of the lines on at least min_sites sites, from rows of _lines."""
    slack = 4 * 1.04 / 2 ** (lg_k / 2)
    seen = settle(lines.groupBy(*KEY).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
        F.min(F.struct("doc_id", "t1", "t2", "pos")).alias("home")).where(F.col("sites") >= min_sites * (1 - slack)), "spread")
    sure = seen.where(F.col("sites") > min_sites * (1 + slack)).select(*KEY, "home")
    near = seen.where(F.col("sites") <= min_sites * (1 + slack)).select(*KEY, "home")
    exact = lines.join(near.select(*KEY), KEY, "left_semi").select(*KEY, "site").distinct().groupBy(*KEY).agg(F.count("*").alias("n"))
    return sure.unionByName(near.join(exact.where(F.col("n") >= min_sites).select(*KEY), KEY))


def remove_shared_lines(docs: DataFrame, site: str = "source", min_sites: int = 5, min_words: int = 1, lg_k: int = 12) -> DataFrame:
    """Every row of docs with its text without shared lines, and n_lines, n_removed and emptied (all that was not
    blank is gone). Columns of docs with these names are replaced; n_chars, where present, follows the text.
    """
    lines = settle(_lines(docs, site, min_words), "lines")
    shared = settle(shared_lines(lines, min_sites, lg_k), "shared")
    marks = (
        lines.join(shared, KEY)
        .where(~F.struct("doc_id", "t1", "t2", "pos").eqNullSafe(F.col("home")))
        .groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("_gone"))
        .withColumnsRenamed({"doc_id": "_id", "t1": "_r1", "t2": "_r2"}))
    t1, t2 = text_key(F.col("text"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")]
    # The parts are made below the join, so that they are a column and not split again for every line.
    parts = docs.withColumn("_t1", t1).withColumn("_t2", t2).withColumn("_parts", F.split("text", "\n")).drop("text")
    held = parts.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_r1")) & (F.col("_t2") == F.col("_r2")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")
    left = F.when(F.col("_gone").isNull(), F.col("_parts")).otherwise(F.transform(stay, lambda i: F.get("_parts", i)))
    out = (
        held.withColumn("text", F.array_join(left, "\n"))
        .withColumn("n_lines", F.coalesce(F.size("_parts"), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long")))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines"))).withColumn(
        "n_removed", F.greatest("n_removed", F.lit(0).cast("long"))).withColumn(
        "emptied", (F.col("n_removed") > 0) & (F.btrim("text", F.lit(BLANKS + "\n")) == ""))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns, "n_lines", "n_removed", "emptied")
