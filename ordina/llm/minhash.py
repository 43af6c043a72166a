"""MinHash near-dedup: chosen-path similarity join over minwise tokens, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import Vocabulary, mix

#: Words in a shingle, and the least Jaccard similarity of a link in percent, where a caller sets none.
SHINGLE = 5
PERCENT = 80
#: Minwise tokens of a document.
TOKENS = 96
#: Independent trees. A node passes each document on by TOKENS / (TOKENS * BRANCH) tokens on average, so a pair
#: at the threshold is still together in a tree after one, two, three levels with probability 0.66, 0.50, 0.41.
TREES = 24
BRANCH = 0.75
#: Documents of a node, or of a block of a larger group, that one task compares with each other.
NODE = 200
DEPTH = 4
#: Shingles of a block that one task holds.
BLOCK_SHINGLES = 400_000
#: Share of agreeing one-byte tokens from which a pair is confirmed on full sets: 4.5 standard deviations below 0.8.
SKETCH = 0.62

_RANDOM = np.random.default_rng(20170717)
_FACTORS = _RANDOM.integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
_SALT = np.uint64(0x632BE59BD9B4E019)


def shingles(text: str | None, vocabulary: Vocabulary, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size``-word shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(Vocabulary.windows(vocabulary.codes(words), min(size, len(words))))


def minwise(found: np.ndarray) -> np.ndarray:
    """TOKENS 32-bit minwise tokens of a set."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[at : at + 2048, None] * _FACTORS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            n, low, high, tokens = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), vocabulary, size)
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                n.append(len(found))
                low.append(digest & 2**63 - 1)
                high.append(digest >> 65)
                tokens.append(minwise(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "n", "s1", "s2", "tokens"])

    return run


def _chosen(node: np.ndarray) -> np.ndarray:
    """For each node, which tokens it branches on: a function of the node alone, so no task has to be told."""
    position = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * _SALT)
    return mix(node[:, None] ^ position[None, :]) < np.uint64(int(2**64 / (TOKENS * BRANCH)))


def _child(node: np.ndarray, position: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node + position.astype(np.uint64) * _SALT) ^ token.astype(np.uint64))


def _branch(roots: bool):
    """(node, k) rows one level down; with ``roots``, from all trees' roots."""
    trees = mix(np.arange(TREES, dtype=np.uint64) + np.uint64(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                k = np.asarray(batch.column(0))
                tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
                if roots:
                    tree, position = np.nonzero(_chosen(trees))
                    node = _child(trees[tree][None, :], position[None, :], tokens[:, position]).ravel()
                    k = np.repeat(k, len(position))
                else:
                    parent = np.asarray(batch.column(2)).view(np.uint64)
                    row, position = np.nonzero(_chosen(parent))
                    node, k = _child(parent[row], position, tokens[row, position]), k[row]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(k)], names=["node", "k"])

    return run


def forest(links: Iterator[tuple[int, int]], n: int) -> list[int]:
    """The least member of each item's group under ``links``."""
    low = list(range(n))

    def root(x: int) -> int:
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            low[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def _grouped(keys: int, work: Callable[[list[tuple]], list[tuple[int, int]]]):
    """Runs ``work`` on each run of rows with equal leading ``keys``; rows come sorted by them."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        first = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][:keys] != rows[first][:keys]:
                if i - first > 1:
                    out += work(rows[first:i])
                first = i
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                pending += zip(*(c.to_pylist() for c in batch.columns), strict=True)
                cut = len(pending)
                while cut and pending[cut - 1][:keys] == pending[-1][:keys]:
                    cut -= 1
                if cut:
                    yield emit(pending[:cut])
                    pending = pending[cut:]
        if pending:
            yield emit(pending)

    return run


def _star(k: list[int], low: list[int]) -> list[tuple[int, int]]:
    return [(k[i], k[low[i]]) for i in range(len(k)) if low[i] != i]


def _alike(rows: list[tuple]) -> list[tuple[int, int]]:
    """Stars of documents of one node whose one-byte sketches agree in enough places. Rows: node, i, j, k, sketch."""
    k = [r[3] for r in rows]
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), TOKENS)
    need = int(np.ceil(SKETCH * TOKENS))

    def links() -> Iterator[tuple[int, int]]:
        for i in range(len(k) - 1):
            for j in np.flatnonzero((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= need).tolist():
                yield i, i + 1 + j

    return _star(k, forest(links(), len(k)))


def _confirmed(size: int, percent: int):
    """Stars of documents linked on their full sets. Rows: group, i, j, k, text."""

    def work(rows: list[tuple]) -> list[tuple[int, int]]:
        vocabulary = Vocabulary()
        sets = [shingles(r[4], vocabulary, size) for r in rows]
        k = [r[3] for r in rows]
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        posting, ends = owner[order], np.cumsum(sizes)

        def links() -> Iterator[tuple[int, int]]:
            for i in range(len(sets)):
                mine = code[ends[i] - sizes[i] : ends[i]]
                mine = mine[count[mine] > 1]
                if not len(mine):
                    continue
                reach = count[mine]
                at = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
                both = np.bincount(posting[at], minlength=len(sets))
                for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
                    if j > i:
                        yield i, j

        return _star(k, forest(links(), len(k)))

    return work


def _blocks(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Sends each row of a group to the pairs (i, j) of blocks that its own block is part of.

    So any two rows of a group meet in one task, each task holds two blocks, and no group of any size is
    gathered; a group of one block is one unit.
    """
    own = F.pmod(F.xxhash64("k"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rest = [c for c in rows.columns if c not in (group, blocks, "own", "other")]
    return rows.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rest)


def candidates(classes: DataFrame) -> DataFrame:
    """Candidate links (u, v) between classes (k, tokens): stars of sketch-alike documents of each node."""
    sketch = classes.select("k", "tokens")
    nodes = common.stage(sketch.mapInArrow(_branch(True), "node long, k long"), "near-nodes")
    leaves: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        counts = common.stage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-counts")
        most = counts.agg(F.max("m"), F.sum("m")).first()
        if most[0] is None:
            break
        last = depth == DEPTH or most[0] <= NODE
        met = common.lookup(nodes, counts, ["node"], "m", most[1])
        if last:
            leaves.append(met.select("node", "k", F.ceil(F.col("m") / NODE).alias("blocks")))
            break
        met = common.stage(met, "near-members")
        leaves.append(met.filter(F.col("m") <= NODE).select("node", "k", F.lit(1).cast("long").alias("blocks")))
        large = met.filter(F.col("m") > NODE).join(sketch, "k").select("k", "tokens", "node")
        nodes = common.stage(large.mapInArrow(_branch(False), "node long, k long"), "near-nodes")
    if not leaves:
        return sketch.select(F.col("k").alias("u"), F.col("k").alias("v")).limit(0)
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionByName(more)
    byte = F.expr(f"unhex(concat_ws('', transform(sequence(1, {4 * TOKENS}, 4), p -> hex(substring(tokens, p, 1)))))")
    small = classes.select("k", byte.alias("sketch"))
    rows = _blocks(members.join(common.stage(small, "near-sketch"), "k"), "node", "blocks").select("node", "i", "j", "k", "sketch")
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "k").mapInArrow(_grouped(3, _alike), "u long, v long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their sets of lower-cased ``shingle``-word
    shingles; component_id is the smallest id reachable, and the document that has it is kept.

    * null or empty text has no shingles, links with nothing and is its own component;
    * fewer words than a shingle: the whole sequence is the one shingle;
    * repeated rows have equal sets and share a component; rows that share an id count as linked, and all
      rows with the component's id are kept;
    * a row without an id is not linked: component_id null, kept false;
    * an empty table gives an empty result; other columns are not read.

    Documents with equal sets become one class first, so copies cost nothing. Chosen paths find candidates:
    each tree's nodes pass a document on by the minwise tokens that the node's hash selects; nodes of up to
    NODE documents are compared by sketches, larger ones branch again, and what is still large after DEPTH
    levels is compared in blocks. Candidate groups are then confirmed on full sets, in blocks too.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = common.stage(texts.mapInArrow(_features(shingle), "doc_id long, n long, s1 long, s2 long, tokens binary"), "near-features")
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("k"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = common.stage(classes, "near-classes")

    groups = common.stage(components(candidates(classes)), "near-groups")
    sized = groups.join(classes.groupBy("k").agg(F.max("n").alias("n")), F.col("node") == F.col("k")).select("k", "component", "n")
    sized = common.stage(sized, "near-sized")
    totals = common.stage(sized.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")), "near-totals")
    totals = totals.select("component", "m", F.greatest(F.ceil(F.col("m") / NODE), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = common.lookup(sized.drop("n"), totals, ["component"], "m", sized.count()).select("k", "component", "blocks")
    full = texts.join(placed, F.col("doc_id") == F.col("k")).select("component", "blocks", "k", "text")
    units = _blocks(full, "component", "blocks").select("component", "i", "j", "k", "text")
    units = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "k")
    linked = components(units.mapInArrow(_grouped(3, _confirmed(shingle, percent)), "u long, v long"))

    whole = classes.select("s1", "s2", "k", "size").join(linked, F.col("k") == F.col("node"), "left")
    whole = common.stage(whole.select("s1", "s2", F.coalesce("component", "k").alias("component_id"), "size"), "near-linked")
    narrow = rows.select("doc_id", "n", "s1", "s2")
    total = whole.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    out = common.lookup(narrow.filter("n > 0 AND doc_id IS NOT NULL"), whole, ["s1", "s2"], "size", total).select("doc_id", "n", "component_id")
    out = out.unionByName(narrow.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``df`` with one document of each group, the one with the smallest id; columns as in ``df``, whatever their names.

    Rows without an id link with nothing and stay; rows that share an id are one document and stay or go together.
    Ids that go leave by broadcast where they are few, else by an anti-join that moves each row once.
    """
    gone = near_groups(df, id_col, text_col, shingle, percent).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("k")).distinct()
    gone = common.stage(gone, "near-gone")
    met = common.packed(df, F.col(id_col).cast("long").alias("k"))
    return met.join(F.broadcast(gone) if common.few(gone) else gone, "k", "left_anti").select("row.*")
