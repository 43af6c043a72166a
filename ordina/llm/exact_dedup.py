"""Exact dedup: 128-bit content hash groups, bytes compared inside groups, largest id kept. JVM functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def _digests(norm: Column) -> tuple[Column, Column]:
    return F.unhex(F.md5(norm)), F.sha2(norm, 256)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Column, list[str]]:
    """(tied, groups, third digest, key): ids of each text with the times that they have it; per text keep_id, keep_times
    and group_size; and what tells collided texts apart. The key of a text is (h, text_sha256, more).

    The hashes alone are grouped, so
    a hot text is one row per map task. Then bytes are compared: the least and the largest text of each hash that
    several rows share have to be the same. That is a partial aggregate too: a task sends two texts of a group at
    most, however many copies it holds, and texts that nothing shares a hash with are not compared.
    """
    norm = common.ascii_lower(F.col(text_col))
    h, sha = _digests(norm)
    key = ["h", "text_sha256", "more"]
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), h.alias("h"), sha.alias("text_sha256"))
    shared = common.stage(base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "exact-hashes")
    texts = base.select("h", "text_sha256", "norm")
    if common.few(shared):
        again = texts.join(F.broadcast(shared.select("h")), "h", "left_semi")
    else:
        hot, cold = common.split_hot(shared, "n", df.count())
        again = texts.join(F.broadcast(hot.select("h")), "h", "left_semi").unionByName(texts.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold.select("h"), "h", "left_semi"))
    sides = again.groupBy("h", "text_sha256").agg(F.min("norm").alias("least"), F.max("norm").alias("largest"))
    collided = common.stage(sides.filter("least <> largest").select("h", "text_sha256"), "exact-collisions")
    # Never met with these digests: a collision gives every text one of another length beside them.
    collides = not collided.isEmpty()
    more = F.sha2(norm, 512) if collides else F.lit("")
    rows = base.withColumn("more", F.sha2("norm", 512) if collides else F.lit(""))
    tied = common.stage(rows.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("times")), "exact-tied")
    largest = F.max(F.struct("doc_id", "times")).alias("top")
    groups = tied.groupBy(*key).agg(largest, F.sum("times").alias("group_size"))
    groups = common.stage(groups.select(*key, F.col("top.doc_id").alias("keep_id"), F.col("top.times").alias("keep_times"), "group_size"), "exact-groups")
    return tied, groups, more, key


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id stays.

    * null text counts as empty; all empty texts are one group;
    * null id sorts before every other id: such a row stays only where its group has no other id;
    * rows repeating both id and text tie: exactly one of them stays;
    * an empty table gives an empty result; other columns, whatever their names, are not read.

    Plan: see ``_keyed``; then narrow rows without texts meet their groups, hot groups by broadcast.
    """
    tied, groups, _, key = _keyed(df, id_col, text_col)
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    out = common.lookup(tied, groups, key, "group_size", total)
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    out = out.select("doc_id", "keep_id", "group_size", "text_sha256", copy)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without its exact copies; columns as in ``df``, whatever their names.

    Of each text the row stays that ``exact_groups`` keeps; of rows that repeat both id and text one does, and rows
    repeating an id with different texts are each judged by their own text. Rows without an id keep one row per text.

    Only groups of several rows are looked up: by broadcast where they are few, else by a join that moves each row
    once. Rows are only compared with each other again where one id has one text several times.
    """
    _, groups, more, key = _keyed(df, id_col, text_col)
    several = groups.filter("group_size > 1").select(*key, "keep_id", "keep_times", "group_size")
    h, sha = _digests(common.ascii_lower(F.col(text_col)))
    wide = common.packed(df, F.col(id_col).cast("long").alias("id"), h.alias("h"), sha.alias("text_sha256"), more.alias("more"))
    if common.few(several):
        met = wide.join(F.broadcast(several), key, "left")
    else:
        met = common.lookup(wide, several, key, "group_size", df.count(), "left")
    stay = F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    met = met.filter(stay)
    if several.filter("keep_times > 1").isEmpty():
        return met.select("row.*")
    once = F.coalesce(F.col("keep_times"), F.lit(1)) == 1
    return met.filter(once).select("row").unionByName(met.filter(~once).dropDuplicates(key).select("row")).select("row.*")
