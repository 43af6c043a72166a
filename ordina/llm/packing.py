"""Packing: documents' tokens into sequences, first-fit decreasing by a tournament tree in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
#: Pieces a randomised group has on average.
GROUP_PIECES = 8192
#: Id put after each document.
DOCUMENT_END = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; equal lengths keep their order.

    A binary tournament over the bins holds in each node the largest free capacity below it, so the
    first bin that an item fits is found from the root in a logarithm of the number of bins.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * leaves)
    out: list[tuple[int, int]] = [(0, 0)] * n
    for i in sorted(range(n), key=lambda k: -lengths[k]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        out[i] = (node - leaves, capacity - free[node])
        free[node] -= need
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return out


def _pieces(sequence: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenizing import encoder

        ids = encoder(vocabulary).ids
        end = DOCUMENT_END.to_bytes(4, "little")
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids(text.as_py() or "") + end
                n = len(data) // 4
                for at in range(0, n, sequence):
                    part = data[4 * at : 4 * (at + sequence)]
                    doc.append(d)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(sequence: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("tie", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins = first_fit_decreasing(group.column("length").to_pylist(), sequence)
        base = key[0].as_py() << 32
        group = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return group.append_column("sequence_id", pa.array([base + b for b, _ in bins], pa.int64())).append_column("offset", pa.array([o for _, o in bins], pa.int64()))

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, vocabulary: str = "byte_bpe_50k", group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then DOCUMENT_END; it is cut at multiples of ``sequence`` only, so all but
    its last piece fill a sequence alone. Pieces are numbered once, in a stage table, and dealt by a seeded hash of
    that number into groups of about ``group_pieces``, each packed by itself, so no task grows with the input, even
    where all rows share one id.

    * null or empty text is a document of one id; repeated rows are separate documents;
    * an added token of the vocabulary that stands in a text is that token's id;
    * null doc_id is carried through; an empty table gives an empty result; other columns are not read;
    * very long texts give many pieces, which the hash spreads over all groups.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = texts.mapInArrow(_pieces(sequence, vocabulary), PIECES).withColumn("uid", F.monotonically_increasing_id())
    pieces = common.stage(pieces, "pack-pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    tie = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32")
    dealt = pieces.withColumn("tie", tie).withColumn("grp", F.pmod(F.xxhash64(F.lit(seed + 1), "uid"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(sequence), PACKED)
