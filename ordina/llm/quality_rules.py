"""Quality rules with thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Vocabulary

#: Words in a window whose repetition counts.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

#: Ratio -> (numerator, denominator, unit). The unit is the least that can be found at once: one character or mark,
#: one repeated window of words, and a line of about as many; a mean has none.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars", 1),
    "dup_line_ratio": ("n_dup_line_words", "n_words", WINDOW),
    "repeat_ratio": ("n_repeat_words", "n_words", WINDOW),
    "upper_ratio": ("n_upper", "word_chars", 1),
    "bang_ratio": ("n_bangs", "n_words", 1),
    "mean_word": ("word_chars", "n_words", 0),
}
#: Upper limit: third quartile and so many interquartile ranges.
SPREAD = 6.0
#: Rows that a group's parent counts for in what the group has.
PRIOR_ROWS = 20
SKETCH_K = 200

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_dup_line_words")
_UPPER = bytes(range(65, 91))


def measure(text: str | None, vocabulary: Vocabulary) -> tuple[int, ...]:
    """MEASURES of one whole text; null counts as empty."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    solid = data.translate(None, common.ASCII_SPACE)
    chars = len(solid.decode())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if n > WINDOW:
        windows = vocabulary.windows(vocabulary.codes(words), WINDOW)
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeats = int((np.cumsum(edge[:n]) > 0).sum())
    count = lambda drop: len(solid) - len(solid.translate(None, drop))
    again = sum(len(x.split()) * (k - 1) for x, k in Counter(lines).items() if k > 1)
    return n, chars, count(SYMBOLS), len(lines) - len(set(lines)), repeats, len(lines), count(_UPPER), solid.count(b"!"), again


_MEASURED = pa.struct([(m, pa.int64()) for m in MEASURES])


def measured(text: Column) -> Column:
    """A struct of MEASURES of a text column; only that column goes to Python."""

    @F.arrow_udf(returnType=", ".join(f"{m} long" for m in MEASURES))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary()
        for texts in batches:
            rows = [measure(t.as_py(), vocabulary) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], fields=list(_MEASURED))

    return run(text)


def _ratio(name: str, smooth: bool = False) -> Column:
    """A ratio of the document; ``smooth``: by the rule of succession, as if one more unit in two had been seen."""
    top, bottom, unit = RATIOS[name]
    if smooth and unit:
        return (F.col(top) + unit) / (F.col(bottom) + 2 * unit)
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _shrunk(own: Column, rows: str, parent: Column) -> Column:
    """A value by its rows and PRIOR_ROWS rows of the parent's."""
    return (F.coalesce(F.col(rows) * own, F.lit(0.0)) + PRIOR_ROWS * parent) / (F.col(rows) + PRIOR_ROWS)


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source, group_rows and one upper limit ``<ratio>_max`` per ratio, for every group of ``rows``.

    A limit is the third quartile of the group's smoothed ratios and SPREAD times their spread: their interquartile
    range, or the mean one of the language's groups where that is wider, as a group of copies has none of its own. So
    where documents have none of what a ratio counts, their lengths decide: smoothed ratios are what such lengths
    leave room for, and no constant stands in for a spread. Quartile and mean spread are drawn towards their parent's
    (language, whole table, and for the spread the range of all ratios together) by PRIOR_ROWS, in one formula for
    groups of every size.

    Sketches of base_failed rows are left out, so junk does not widen its own limits. Each group is
    sketched once; its language's and the whole table's sketches are merged from those.
    """
    sound = [F.kll_sketch_agg_double(F.when(~F.col("base_failed"), _ratio(r, True)), F.lit(SKETCH_K)).alias(r) for r in RATIOS]
    own = common.stage(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("group_rows"), F.count_if(~F.col("base_failed")).alias("n"), *sound), "quality-sketches")

    def quartile(r: str, p: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(r, F.lit(p)))

    widths = [(quartile(r, 0.75) - quartile(r, 0.25)).alias(f"{r}_width") for r in RATIOS]
    own = own.select("*", *widths, *[quartile(r, 0.75).alias(f"{r}_high") for r in RATIOS])
    level = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r).alias(r) for r in RATIOS], *[(F.sum(F.col("n") * F.col(f"{r}_width")) / F.sum("n")).alias(f"{r}_mean") for r in RATIOS]]
    by_lang = own.groupBy("lang").agg(*level)
    by_lang = by_lang.select("lang", F.col("n").alias("n_lang"), *[f"{r}_mean" for r in RATIOS], *[quartile(r, 0.75).alias(f"{r}_lang") for r in RATIOS])
    whole = own.agg(*level).select("n", *[f"{r}_mean" for r in RATIOS], *widths, *[quartile(r, 0.75).alias(f"{r}_high") for r in RATIOS]).first()
    each, limits = own.join(by_lang, "lang"), []
    for r in RATIOS:
        n, mean, width, high = (whole[c] or 0.0 for c in ("n", f"{r}_mean", f"{r}_width", f"{r}_high"))
        q = _shrunk(F.col(f"{r}_high"), "n", _shrunk(F.col(f"{r}_lang"), "n_lang", F.lit(high)))
        usual = _shrunk(F.col(f"{r}_mean"), "n_lang", F.lit((n * mean + PRIOR_ROWS * width) / (n + PRIOR_ROWS)))
        limits.append((q + SPREAD * F.greatest(usual, f"{r}_width")).alias(f"{r}_max"))
    return each.select("lang", "source", "group_rows", *limits)


def _judged(df: DataFrame, text_col: str, lang_col: str, source_col: str, carried: Column) -> DataFrame:
    """The column ``carried`` of every row, lang, source, MEASURES, base_failed, broken and kept."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]
    rows = df.select(carried, *named, measured(F.col(text_col).cast("string")).alias("m")).select("carried", "lang", "source", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = common.stage(rows.withColumn("base_failed", failed), "quality-measures")
    limits = common.stage(thresholds(rows), "quality-limits")
    met = common.lookup(rows, limits, ["lang", "source"], "group_rows", rows.count())
    # A group of one value has it as its limit, up to the rounding of means.
    broken = [F.when(_ratio(r) > F.col(f"{r}_max") * F.lit(1 + 1e-9), F.lit(r)) for r in RATIOS]
    met = met.withColumn("broken", F.array_compact(F.array(*broken)))
    return met.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, measures, base_failed, broken, kept.

    base_failed: under MIN_WORDS words, or more than MAX_REPEAT_PERCENT percent of the words in repeated
    windows. kept: not base_failed and every ratio at most its group's limit (see ``thresholds``); broken names those
    that are above it.

    * null or empty text has no words and fails; null lang or source is a group like any other;
    * repeated rows are judged alike; an empty table gives an empty result; other columns are not read.

    The measured rows, about a hundred bytes each, are staged once. Sketches are partial sums per map
    task, so a hot source moves one sketch per task, and its limits are broadcast as a bounded table.
    """
    met = _judged(df, text_col, lang_col, source_col, F.col(id_col).cast("long").alias("carried"))
    return met.select(F.col("carried").alias("doc_id"), *MEASURES, "base_failed", "broken", "kept")


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``df`` without the rows that ``judge`` rejects; columns as in ``df``, whatever their names.

    Each row is judged by itself, so rows without an id, or with one that is repeated, are like any other. Whole rows
    are staged beside their measures; texts are not shuffled, but for those of sources too small to be hot, whose
    limits meet them by a join where all limits together are too many to broadcast.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("carried")
    return _judged(df, text_col, lang_col, source_col, row).filter("kept").select("carried.*")
