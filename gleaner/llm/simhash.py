"""Near duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints of equal documents are one row before anything is compared.  Two
fingerprints that differ in few bits agree in some of their blocks, so rows meet by
shared blocks; there a table of Hamming distances to reference fingerprints discards
pairs (a distance to a pivot changes by no more than the pair's own distance), and
only survivors are compared.  A block shared by very many fingerprints is cut into
chunks, and tasks compare pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, worker_cache
from gleaner.llm.components import components
from gleaner.plans.sizing import materialise

SHINGLE = 3
MAX_BITS = 3
# Bounds of five blocks of the 64 bits; three changed bits leave two of them untouched.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
# The pivots: 16 reference fingerprints, from a fixed generator.
PIVOTS = np.random.default_rng(7).integers(0, 2**64, 16, dtype=np.uint64)
# Fingerprints of one block key that meet in one task; larger keys are cut into chunks.
CHUNK = 4096
TILE = 512

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint; text without a word gives zero."""
    from xxhash import xxh64_intdigest

    # bytes.split() knows exactly the six ASCII white-space characters.
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: n - 1]]
    stops = [e - 1 for e in ends[min(size, len(words)) - 1 :]]
    hashes = np.fromiter(
        (xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, n
    )
    votes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp holds the 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints")
        for batch in batches:
            bits = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of the two arrays within ``bits`` bits."""
    pivots_a = np.bitwise_count(a[:, None] ^ PIVOTS).astype(np.int8)
    pivots_b = np.bitwise_count(b[:, None] ^ PIVOTS).astype(np.int8)
    i, j = np.nonzero(np.abs(pivots_a[:, None, 0] - pivots_b[None, :, 0]) <= bits)
    for k in range(1, len(PIVOTS)):
        fits = np.abs(pivots_a[i, k] - pivots_b[j, k]) <= bits
        i, j = i[fits], j[fits]
    fits = np.bitwise_count(a[i] ^ b[j]) <= bits
    return i[fits], j[fits]


def _roots(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places, from labels known so far."""
    while True:
        low = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, labels[i], low)
        np.minimum.at(new, labels[j], low)
        new = new[new]
        new = new[labels]
        if np.array_equal(new, labels):
            return labels
        labels = new


def linked(left: np.ndarray, right: np.ndarray | None, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (member, root) joined by links within ``left``, or between left and right.

    Rows are compared tile by tile in the order of their distance to the first pivot, so
    tiles that are too far apart in that coordinate are never opened.  One row per
    linked member is returned, however many pairs link it.
    """
    both = left if right is None else np.concatenate([left, right])
    first = np.bitwise_count(both ^ PIVOTS[0]).astype(np.int16)
    sides = [np.arange(len(left))] * 2 if right is None else [np.arange(len(left)), len(left) + np.arange(len(right))]
    sides = [s[np.argsort(first[s], kind="stable")] for s in sides]
    labels = np.arange(len(both))
    for x in range(0, len(sides[0]), TILE):
        one = sides[0][x : x + TILE]
        for y in range(x if right is None else 0, len(sides[1]), TILE):
            two = sides[1][y : y + TILE]
            if first[two[0]] - first[one[-1]] > bits:
                break
            if first[one[0]] - first[two[-1]] > bits:
                continue
            i, j = _near(both[one], both[two], bits)
            labels = _roots(len(both), one[i], two[j], labels)
    members = np.flatnonzero(labels != np.arange(len(both)))
    return members, labels[members]


def _link_runs(bits: int):
    """Rows sorted by (key, cell) -> edges between the nodes of each run of equal keys."""

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        same = (rows[["key", "cell"]].values[1:] == rows[["key", "cell"]].values[:-1]).all(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        ends = np.append(starts[1:], len(rows))
        fp, node, side = rows["fp"].values.view(np.uint64), rows["node"].values, rows["side"].values
        a, b = [], []
        # Short runs together: the table of distances once, neighbours at each step.
        pivots = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
        run = np.repeat(np.arange(len(starts)), ends - starts)
        long = (ends - starts > 32)[run]
        for step in range(1, 32):
            i = np.flatnonzero((run[step:] == run[:-step]) & ~long[step:])
            if not len(i):
                break
            i = i[np.abs(pivots[i] - pivots[i + step]).max(axis=1, initial=0) <= bits]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
            a.append(node[i])
            b.append(node[i + step])
        for s, e in zip(starts, ends, strict=True):
            if e - s > 32:
                here = side[s:e] == 0
                own = np.concatenate([np.arange(s, e)[here], np.arange(s, e)[~here]])
                left, right = own[: here.sum()], own[here.sum() :]
                member, root = linked(fp[left], fp[right] if len(right) else None, bits)
                a.append(node[own[member]])
                b.append(node[own[root]])
        return pd.DataFrame({"a": np.concatenate(a or [[]]).astype(np.int64), "b": np.concatenate(b or [[]]).astype(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = (frame["key"].values == frame["key"].values[-1]) & (frame["cell"].values == frame["cell"].values[-1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut == 0 and waiting and tuple(waiting[-1].iloc[-1][["key", "cell"]]) == tuple(frame.iloc[0][["key", "cell"]]):
                waiting.append(frame)
                continue
            yield edges(pd.concat([*waiting, frame.iloc[:cut]])) if waiting or cut else edges(frame.iloc[:0])
            waiting = [frame.iloc[cut:]]
        if waiting:
            yield edges(pd.concat(waiting))

    return run


def near_links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (node, fp) within ``bits`` bits.

    Edges connect what pairs connect; they are not one row per pair.
    """
    if bits != MAX_BITS:
        raise ValueError("the blocks are laid out for three bits")
    keys = []
    for k, kept in enumerate(combinations(range(len(BLOCKS)), 2)):
        mask = sum(((1 << (BLOCKS[b][1] - BLOCKS[b][0])) - 1) << BLOCKS[b][0] for b in kept)
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.struct(F.lit(k).alias("blocks"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select(
        "node", "fp", F.xxhash64("k.blocks", "k.value").alias("key")
    )
    # Keys with one row have no pair; keys with more than a chunk are cut.
    met = materialise(
        rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    )
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    shared = (
        rows.join(met, "key")
        .withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("chunks")).cast("int"))
    )
    # A row of chunk c meets its own chunk in cell (c, c) and every other in (low, high).
    cells = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(
            (F.least(o, F.col("chunk")) * F.col("chunks") + F.greatest(o, F.col("chunk"))).alias("cell"),
            (F.col("chunk") > o).cast("int").alias("side"),
        ),
    )
    placed = shared.select("key", "node", "fp", F.explode(cells).alias("c")).select(
        "key", "c.cell", "c.side", "node", "fp"
    )
    return (
        placed.repartition("key", "cell")
        .sortWithinPartitions("key", "cell", "side")
        .mapInPandas(_link_runs(bits), "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most three bits, the
    row's own included.  Null and empty texts have fingerprint zero and are linked like
    any other.  Rows that repeat an id or text share their component; among rows of one
    fingerprint null ids are passed over, and a fingerprint that only null ids have is
    compared with no other.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, size))
    nodes = materialise(
        prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null")
    )
    # An id that is the smallest of two fingerprints (repeated ids) joins them.
    found = components(near_links(nodes))
    merged = materialise(
        nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    )
    return prints.join(merged, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
