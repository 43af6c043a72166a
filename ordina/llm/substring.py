"""Substring dedup: windows of words that occur twice anywhere, found by super-k-mers partitioned by minimiser."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Vocabulary

#: Words in a window.
WINDOW = 35
#: Words in the m-grams among which a window's minimiser is chosen.
GRAM = 8
#: Longer grams whose minimisers part the windows of a bucket of too many strings; the last is the window itself.
FINER = (20, WINDOW)
#: Distinct strings of one minimiser that one task sorts; a bucket of more is parted by the next finer minimiser.
BUCKET_STRINGS = 512

RUNS = "doc_id long, th long, m long, c long, start int, n_win int"
STRINGS = "m long, c long, n long, doc_id long, th long, start int, packed binary, large boolean"
PARTS = "m long, c long, n long, doc_id long, th long, start int, n_win int, packed binary"
SPANS = "doc_id long, th long, start int, n_win int"


def super_kmers(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each run of windows that share a minimiser's occurrence.

    The leftmost of equal minimisers counts, so equal windows of one text always lie in different runs.
    """
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = Vocabulary.windows(codes, gram)
    span = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return start, np.diff(np.concatenate((start, [n]))), grams[at[start]]


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            parts: list[tuple[int | None, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for d, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                codes = vocabulary.codes((text.as_py() or "").encode().split())
                start, count, least = super_kmers(codes, window, gram)
                if len(start):
                    raw = memoryview(codes.tobytes())
                    ends = 8 * (start + count + window - 1)
                    content = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a : b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)), np.uint64, len(start))
                    parts.append((d, th, least, content, start, count))
            if not parts:
                continue
            sizes = [len(p[2]) for p in parts]
            ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
            columns = [ids, pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), sizes))]
            columns += [pa.array(np.concatenate([p[i] for p in parts]).view(np.int64)) for i in (2, 3)]
            columns += [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int32)) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "m", "c", "start", "n_win"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_STRINGS = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("packed", pa.binary()), ("large", pa.bool_())])
_PARTS = pa.schema([*list(_STRINGS)[:6], pa.field("n_win", pa.int32()), pa.field("packed", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _strings(window: int):
    """Packs the asked runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, th, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = (text or "").encode().split()
                out += [(a["m"], a["c"], a["n"], d, th, a["start"], b" ".join(words[a["start"] : a["start"] + a["n_win"] + window - 1]), a["large"]) for a in asked]
            yield _batch(out, _STRINGS)

    return run


def _parts(window: int, gram: int):
    """The super-k-mers of packed strings under a longer minimiser, beside their bucket's own one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            out = []
            for m, n, d, th, start, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = packed.split(b" ")
                for at, count, least in zip(*(x.tolist() for x in super_kmers(vocabulary.codes(words), window, gram)), strict=True):
                    part = b" ".join(words[at : at + count + window - 1])
                    key = xxhash.xxh3_64_intdigest(least.to_bytes(8, "little"), m & (1 << 64) - 1)
                    out.append((_signed(key), _signed(xxhash.xxh3_64_intdigest(part)), n, d, th, start + at, count, part))
            yield _batch(out, _PARTS)

    return run


def _sorted_buckets(window: int):
    """Counts windows of each minimiser's strings by sorting; rows come sorted by minimiser."""

    def spans(rows: list[tuple]) -> Iterator[tuple]:
        windows = []
        for k, row in enumerate(rows):
            words = row[6].split(b" ")
            windows += [(b" ".join(words[i : i + window]), k, i) for i in range(len(words) - window + 1)]
        windows.sort()
        found: dict[int, list[int]] = {}
        for _, same in groupby(windows, key=lambda w: w[0]):
            same = list(same)
            if len(same) > 1 or rows[same[0][1]][2] > 1:
                for _, k, i in same:
                    if rows[k][2] == 1:
                        found.setdefault(k, []).append(i)
        for k, offs in found.items():
            offs.sort()
            _, _, _, d, th, start, _ = rows[k]
            first = 0
            for i in range(1, len(offs) + 1):
                if i == len(offs) or offs[i] != offs[i - 1] + 1:
                    yield d, th, start + offs[first], i - first
                    first = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n_win", pa.int32())])
        pending: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return _batch([s for _, same in groupby(rows, key=lambda r: r[0]) for s in spans(list(same))], schema)

        for batch in batches:
            pending += zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)
            cut = len(pending)
            while cut and pending[cut - 1][0] == pending[-1][0]:
                cut -= 1
            if cut:
                yield emit(pending[:cut])
                pending = pending[cut:]
        if pending:
            yield emit(pending)

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                spans = spans.as_py()
                n = len(words)
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n_win"] + window - 1] -= 1
                    gone = np.cumsum(edge[:n]) > 0
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _with(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    rows = rows.withColumnsRenamed({"doc_id": "__d", "th": "__t"})
    return texts.join(rows, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")), how).drop("__d", "__t")


def _in_buckets(strings: DataFrame, window: int) -> DataFrame:
    """Spans of the ``strings`` (m, c, n, doc_id, th, start, packed) of buckets that one task each can sort."""
    rows = strings.select("m", "c", "n", "doc_id", "th", "start", "packed")
    return rows.repartition("m").sortWithinPartitions("m").mapInArrow(_sorted_buckets(window), SPANS)


def _finer(strings: DataFrame, window: int, gram: int, last: bool) -> tuple[list[DataFrame], DataFrame]:
    """(spans, strings of buckets that are still too large) of ``strings`` of large buckets, under a longer minimiser.

    Equal windows share every minimiser, so they meet in one part of their bucket. Equal parts are counted first, and
    one of each is sorted in its bucket with the others, as before.
    """
    parts = common.stage(strings.select("m", "n", "doc_id", "th", "start", "packed").mapInArrow(_parts(window, gram), PARTS), "sub-parts")
    rep = F.min(F.struct("doc_id", "th", "start", "packed")).alias("rep")
    each = common.stage(parts.groupBy("m", "c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), rep), "sub-strings")
    copied = common.lookup(parts.filter("n = 1").drop("n", "packed"), each.filter("n > 1").select("m", "c", "rows"), ["m", "c"], "rows", parts.count())
    spans = [copied.select("doc_id", "th", "start", "n_win")]
    sizes = common.stage(each.groupBy("m").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "sub-buckets")
    met = common.lookup(each.drop("rows"), sizes, ["m"], "k", each.count()).select("m", "c", "n", "rep.*", "k")
    met = common.stage(met, "sub-mixed")
    small = F.lit(True) if last else F.col("k") <= BUCKET_STRINGS
    spans.append(_in_buckets(met.filter(small), window))
    return spans, met.filter(~small)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th (hash of the text), spans: runs of windows whose word sequence also starts elsewhere.

    Runs of windows that share a minimiser (super-k-mers) are first compared by hashes alone: a minimiser
    met once cannot hold a repeated window, and a minimiser whose runs all are one string holds repeated
    windows only. Only strings of the other minimisers travel, one copy of each, to their bucket, where
    windows are sorted and counted as word sequences. A bucket of more than BUCKET_STRINGS strings, that of a phrase
    in many surroundings, is parted into buckets of longer minimisers (FINER) first, so it never meets in one task;
    under the longest, the window itself, a bucket holds copies of one window only, which count as one string.
    """
    texts = _texts(df, id_col, text_col)
    runs = common.stage(texts.mapInArrow(_runs(window, gram), RUNS), "sub-runs")
    total = runs.count()
    by_m = runs.groupBy("m").agg(F.count(F.lit(1)).alias("m_n"), (F.min("c") != F.max("c")).alias("mixed")).filter("m_n > 1")
    met = common.stage(common.lookup(runs, common.stage(by_m, "sub-minimisers"), ["m"], "m_n", total).drop("m_n"), "sub-met")

    rep = F.min(F.struct("doc_id", "th", "start", "n_win")).alias("rep")
    strings = common.stage(met.filter("mixed").groupBy("m", "c").agg(F.count(F.lit(1)).alias("n"), rep), "sub-strings")
    n_strings = strings.count()
    sizes = common.stage(strings.groupBy("m").agg(F.count(F.lit(1)).alias("k")), "sub-buckets")
    asked = common.lookup(strings, sizes, ["m"], "k", n_strings).select("rep.doc_id", "rep.th", F.struct("m", "c", "n", "rep.start", "rep.n_win", (F.col("k") > BUCKET_STRINGS).alias("large")).alias("a"))
    asked = asked.groupBy("doc_id", "th").agg(F.collect_list("a").alias("asked"))
    packed = common.stage(_with(texts, asked, "inner").mapInArrow(_strings(window), STRINGS), "sub-packed")

    copies = strings.filter("n > 1").select("m", "c", "n")
    copied = common.lookup(met.filter("mixed").drop("mixed"), copies, ["m", "c"], "n", total).select("doc_id", "th", "start", "n_win")
    spans = [met.filter("NOT mixed").select("doc_id", "th", "start", "n_win"), copied, _in_buckets(packed.filter("NOT large"), window)]
    large = packed.filter("large")
    finer = [g for g in FINER if gram < g < window] + [window]
    for g in finer:
        if large.isEmpty():
            break
        more, large = _finer(large, window, g, g == window)
        spans += more
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n_win")).alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Each word covered by a window of ``window`` words whose sequence also starts elsewhere, in the same
    text or another, is removed; windows are judged on the input.

    * null text counts as empty: no words, digest of the empty string; texts shorter than a window stay whole;
    * repeated rows repeat each other's windows, so all their windows go; null ids are carried through;
    * an empty table gives an empty result; other columns are not read.
    """
    spans = common.stage(repeated_spans(df, id_col, text_col, window, gram), "sub-spans")
    texts = _with(_texts(df, id_col, text_col), spans, "left").select("doc_id", "text", "spans")
    return texts.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
