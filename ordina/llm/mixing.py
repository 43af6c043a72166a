"""Mixing sources to target weights: budgets down a domain-language-source tree, then a token prefix of each leaf."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The vocabulary that tokens are counted in, that of packing.
VOCABULARY = "byte_bpe_50k"
LEVELS = ("domain", "lang", "source")
#: Rows of a leaf that share a bucket of its seeded order, on average.
BUCKET_ROWS = 2048
#: Leaves up to which their table is broadcast; beyond, it meets the rows by a join with its hot leaves split off.
BROADCAST_LEAVES = 10_000


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenizing import encoder

        ids = encoder(vocabulary).ids
        for batch in batches:
            last = batch.num_columns - 1
            tokens = pa.array([len(ids(t.as_py() or "")) // 4 for t in batch.column(last)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], tokens], names=[*batch.schema.names[:last], "tokens"])

    return run


def _weight(path: Sequence[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    """The weight of a node by its path; a node that has none given weighs 1."""
    out = F.lit(1.0)
    for at, w in weights.items():
        if w <= 0:
            raise ValueError(f"the weight of {at} has to be positive")
        if len(at) == len(path):
            same = F.lit(True)
            for c, v in zip(path, at, strict=True):
                same = same & (F.col(c) == v)
            out = F.when(same, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, total: int, levels: Sequence[str], weights: Mapping[tuple[str, ...], float]) -> DataFrame:
    """``leaves`` (levels, cap: long) with ``budget``: whole tokens that add up to the least of total and all caps.

    Level by level from the root, a node's budget is shared among its children in proportion to their
    weights, none above its subtree's cap: what a full child cannot take goes to its siblings by weight, and
    only what a whole family cannot take has been left to the parent's own siblings before. The share is found
    in closed form: children sorted by cap over weight, the full ones are a prefix of that order.
    """
    levels = list(levels)
    whole = min(total, leaves.agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0])
    up = None
    for depth in range(1, len(levels) + 1):
        path, above = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(path, weights))
        met = nodes.withColumn("given", F.lit(whole)) if up is None else nodes.join(up.withColumnRenamed("budget", "given"), above)
        order = Window.partitionBy(*above).orderBy(F.col("cap") / F.col("w"), *[F.col(c) for c in path])
        family = Window.partitionBy(*above)
        met = met.withColumn("rate", (F.col("given") - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        met = met.withColumn("full", F.col("cap") <= F.col("rate") * F.col("w"))
        share = F.max(F.when(~F.col("full"), F.col("rate"))).over(family)
        met = met.withColumn("exact", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share * F.col("w"))))
        met = met.withColumn("low", F.floor(F.col("exact") + F.lit(1e-9)).cast("long"))
        left = F.least(F.col("given"), F.sum("cap").over(family)) - F.sum("low").over(family)
        rank = F.row_number().over(family.orderBy((F.col("cap") > F.col("low")).desc(), (F.col("exact") - F.col("low")).desc(), *[F.col(c) for c in path]))
        up = met.withColumn("left", left).withColumn("rank", rank).select(*path, (F.col("low") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).alias("budget"))
        up = common.stage(up, "mix-level")
    return leaves.join(up, levels)


def _named(levels: Mapping[str, str]) -> list[Column]:
    return [F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(n) for n, c in levels.items()]


def _rows(df: DataFrame, levels: Mapping[str, str], id_col: str, text_col: str, tokens: Column | None) -> DataFrame:
    """(levels, doc_id, tokens) of every row, staged, so that each text is tokenized once."""
    keys = [*_named(levels), F.col(id_col).cast("long").alias("doc_id")]
    if tokens is not None:
        return common.stage(df.select(*keys, tokens.alias("tokens")), "mix-rows")
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in levels), T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType())])
    return common.stage(df.select(*keys, F.col(text_col).cast("string").alias("__text")).mapInArrow(_count(VOCABULARY), schema), "mix-rows")


def _order(seed: int) -> Column:
    """A row's place in its leaf's seeded order of the leaf's last epoch."""
    return F.xxhash64(F.lit(seed), F.col("full_epochs"), F.col("doc_id"))


def plan(rows: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], float], share: float, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: n, available, budget, full_epochs, and where its last epoch is cut.

    A row belongs to the last epoch when (order, doc_id) is at most (cut_order, cut_id), the row at the cut
    with its first cut_tokens tokens. The cut is found from token sums of buckets of the seeded order, and
    rows of the one bucket that holds it, so a leaf with a third of all rows is never sorted in one task.
    """
    levels = list(levels)
    leaves = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("available"))
    leaves = common.stage(leaves.withColumn("cap", F.col("available") * max_epochs), "mix-leaves")
    have, total = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    leaves = budgets(leaves, int(have * share), levels, weights).drop("cap")
    full = F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(F.lit(0)).cast("long")
    leaves = leaves.withColumn("full_epochs", full).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("available"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET_ROWS))).cast("int")
    leaves = common.stage(leaves.withColumn("bits", bits), "mix-budgets")
    met = common.lookup(rows, leaves.filter("rest > 0"), levels, "n", total).withColumn("order", _order(seed))
    # The order's sign bit is flipped so that buckets of its leading bits sort as the order itself does.
    met = met.withColumn("bucket", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftrightunsigned(order ^ -9223372036854775808L, 64 - bits) END"))
    met = common.stage(met.select(*levels, "doc_id", "tokens", "order", "bucket", "rest"), "mix-ordered")
    sums = met.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("sum"), F.max("rest").alias("rest"))
    before = F.sum("sum").over(Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")
    cut = sums.withColumn("before", before).filter("before < rest AND before + sum >= rest").select(*levels, "bucket", "before")
    near = met.join(cut, [*levels, "bucket"])
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    near = near.withColumn("start", running).filter("start < rest")
    last = F.max(F.struct("order", "doc_id", (F.col("rest") - F.col("start")).alias("cut_tokens"))).alias("last")
    cuts = near.groupBy(*levels).agg(last).select(*levels, F.col("last.order").alias("cut_order"), F.col("last.doc_id").alias("cut_id"), F.col("last.cut_tokens").alias("cut_tokens"))
    return common.stage(leaves.join(cuts, levels, "left").drop("bits", "rest"), "mix-plan")


def _selected(rows: DataFrame, seed: int) -> DataFrame:
    order = _order(seed)
    inside = (order < F.col("cut_order")) | ((order == F.col("cut_order")) & (F.col("doc_id") < F.col("cut_id")))
    at = (order == F.col("cut_order")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    last = F.when(inside, F.col("tokens")).when(at, F.least(F.col("tokens"), F.col("cut_tokens"))).otherwise(F.lit(0))
    return rows.withColumn("epochs", F.col("full_epochs")).withColumn("last_tokens", F.coalesce(last, F.lit(0)).cast("long"))


def mix(df: DataFrame, levels: Mapping[str, str], weights: Mapping[tuple[str, ...], float], share: float = 0.8, max_epochs: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, the levels, tokens, leaf_budget, epochs, last_tokens.

    ``levels`` are SQL expressions by name, from the root down; ``weights`` are by path of their values.
    ``share`` of all tokens (``tokens``; where not given, the text's ids in VOCABULARY, as packing encodes it but
    without its document end) is budgeted among the
    leaves of the tree ``levels`` (see ``budgets``), no leaf more than ``max_epochs`` times what it has. A leaf
    gives each row ``epochs`` whole times and, from one more seeded order of its rows, the prefix of tokens
    that fills its budget: ``last_tokens`` of the row. So epochs * tokens + last_tokens adds up to the budget.

    * a null level is the level ""; null or empty text has no tokens and is taken where its place is inside
      the prefix, with zero tokens; a leaf without tokens gives none;
    * rows repeating an id tie at one place of the order: where the cut falls among them they all get its tokens;
    * weights have to be positive; an empty table gives an empty result; other columns are not read.
    """
    names = list(levels)
    rows = _rows(df, levels, id_col, text_col, tokens)
    leaves = plan(rows, names, weights, share, max_epochs, seed)
    met = _selected(common.lookup(rows, leaves, names, "n", rows.count()), seed)
    return met.select("doc_id", *names, "tokens", F.col("budget").alias("leaf_budget"), "epochs", "last_tokens")


def take(df: DataFrame, levels: Mapping[str, str], weights: Mapping[tuple[str, ...], float], share: float = 0.8, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that a mixture of at most one epoch takes, whole; columns as in ``df``.

    Tokens are counted as in ``mix``. The row at a leaf's cut is taken whole. Texts are not shuffled: the plan, one row per leaf, is broadcast
    up to BROADCAST_LEAVES leaves and joined by leaf beyond.
    """
    names = list(levels)
    rows = _rows(df, levels, id_col, text_col, None)
    leaves = plan(rows, names, weights, share, 1, seed)
    # The cut is in the plan: of a row's own tokens only whether it has any matters from here on, and any text has.
    tokens = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) > 0).cast("long")
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_named(levels), F.col(id_col).cast("long").alias("doc_id"), tokens.alias("tokens"))
    few = leaves.count() <= BROADCAST_LEAVES
    met = wide.join(F.broadcast(leaves), names) if few else common.lookup(wide, leaves, names, "n", rows.count())
    return _selected(met, seed).filter("epochs > 0 OR last_tokens > 0").select("row.*")
