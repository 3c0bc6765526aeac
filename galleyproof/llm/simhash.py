"""SimHash near-duplicates found through the anchors of a covering code.

A fingerprint is cut into blocks. Where two fingerprints differ in at most d bits, some block differs in
at most d // blocks bits (the slack). The points of a covering code - a Hamming [15, 11] code on a
block's first 15 bits, its other bits as they are - are the anchors of a block: every value has one
within the covering radius of 1, its home. A fingerprint is sent to its home and, as a visitor, to every
anchor within radius plus slack, so near fingerprints meet at a home of either; each anchor then
compares its residents with its visitors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .cluster import components, cut

RADIUS = 1
CODED = 15
PAIRS = 1 << 19

# Byte v as eight bytes of 0 or 1, so that sums of up to 255 rows add eight counters at a time.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_SYNDROME = np.zeros(1 << CODED, np.uint8)
for _bit in range(CODED):
    _SYNDROME ^= np.where(np.arange(1 << CODED) >> _bit & 1, _bit + 1, 0).astype(np.uint8)


def shingles(part: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 values of the word shingles of some texts, one text after the other, and the number of each."""
    hashes, counts = [], np.zeros(len(bounds) - 1, np.int64)
    whole = part.tobytes().lower()
    for i in range(len(counts)):
        words = whole[bounds[i] : bounds[i + 1]].split()
        if not words:
            continue
        text = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(xxhash.xxh64_intdigest(text, 42))
            counts[i] = 1
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        hashes += [xxhash.xxh64_intdigest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        counts[i] = len(words) - shingle + 1
    return np.array(hashes, np.uint64), counts


def vote(h: np.ndarray, counts: np.ndarray, lanes: int) -> np.ndarray:
    """The majority of each bit, a row of ``lanes`` words for each run of hashes; no run is empty."""
    out = np.zeros((len(counts), lanes), np.uint64)
    if not len(counts):
        return out
    steps = -(-counts // 255)
    step, owner = arrays.ranges(np.zeros(len(counts), np.int64), steps)
    cuts = (np.cumsum(counts) - counts)[owner] + 255 * step
    first = np.cumsum(steps) - steps
    for lane in range(lanes):
        spread = _SPREAD[(arrays.mix(h + np.uint64(lane)) if lane else h).view(np.uint8).reshape(-1, 8)]
        ones = np.add.reduceat(spread, cuts, axis=0).view(np.uint8).reshape(-1, 64)
        ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
        bits = (2 * ones > counts[:, None]).astype(np.uint8)
        out[:, lane] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def sketch(column, shingle: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, one row of ``lanes`` words for each text of an Arrow column, and the number of shingles of each."""
    data, offsets = arrays.buffers(column)
    out, sizes = np.zeros((len(offsets) - 1, lanes), np.uint64), np.zeros(len(offsets) - 1, np.int64)
    for at, to, part, bounds in arrays.chunks(data, offsets):
        h, counts = shingles(part, bounds, shingle)
        sizes[at:to] = counts
        full = np.flatnonzero(counts)
        out[at + full] = vote(h, counts[full], lanes)
    return out, sizes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, lanes: int = 1) -> DataFrame:
    """(id, f0, ..., n): the SimHash of the XXH64 values of each text's word shingles, one column a lane, and their number.

    A-Z are lowered and words part at ASCII white space. Texts of fewer words are one shingle; a text
    without words (null, empty, blank) has fingerprint zero. Further lanes mix the same shingle hashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(f"f{k}" for k in range(lanes)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, n = sketch(b.column(1), shingle, lanes)
            columns = [b.column(0), *(pa.array(np.ascontiguousarray(f[:, k]).view(np.int64)) for k in range(lanes)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([f"id {kind}", *(f"f{k} long" for k in range(lanes)), "n long"])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@lru_cache
def flips(width: int, slack: int) -> list[np.ndarray]:
    """For each syndrome of a block's coded bits, the differences to all anchors within radius + slack; the home's first."""
    reach, raw = RADIUS + slack, [1 << b for b in range(CODED, width)]

    def sums(bits: list[int], most: int) -> list[tuple[int, int]]:
        out = [(0, 0)]
        for b in bits:
            out += [(x | b, w + 1) for x, w in out if w < most]
        return out

    plain = sums(raw, reach)
    found: list[list[tuple[int, int]]] = [[] for _ in range(16)]
    for x, w in sums([1 << b for b in range(CODED)], reach):
        found[_SYNDROME[x]] += [(w + v, x | y) for y, v in plain if w + v <= reach]
    return [np.array([x for _, x in sorted(f)], np.int64) for f in found]


def blocks_of(lanes: int, per_lane: int) -> list[tuple[int, int, int]]:
    """(lane, first bit, width) of the blocks; the last of a lane takes the bits that are left over."""
    width = 64 // per_lane
    return [(lane, k * width, width if k < per_lane - 1 else 64 - k * width) for lane in range(lanes) for k in range(per_lane)]


def _unite(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def meet(key: np.ndarray, home: np.ndarray, f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) linked at the anchors in key (sorted): residents against all who are there, in blocks of pairs.

    A block's links are cut to a spanning forest, so that a dense group gives links in proportion to its rows.
    """
    bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[bounds, len(key)])
    group = np.repeat(np.arange(len(bounds)), sizes)
    residents = np.flatnonzero(home & (sizes[group] > 1))
    if not len(residents):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    work = np.cumsum(sizes[group[residents]])
    got: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(residents):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, "right")))
        r = residents[at:to]
        other, owner = arrays.ranges(bounds[group[r]], sizes[group[r]])
        one = r[owner]
        apart = np.bitwise_count(f[one, 0] ^ f[other, 0]).astype(np.int16)
        if f.shape[1] > 1:
            close = np.flatnonzero(apart <= most)
            one, other, apart = one[close], other[close], apart[close]
            for lane in range(1, f.shape[1]):
                apart += np.bitwise_count(f[one, lane] ^ f[other, lane])
        linked = np.flatnonzero((apart <= most) & (one != other))
        if len(linked):
            nodes, places = np.unique(np.r_[one[linked], other[linked]], return_inverse=True)
            root = _unite(places[: len(linked)], places[len(linked) :], len(nodes))
            got.append((nodes, nodes[root]))
        at = to
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*got))
    return a[a != b], b[a != b]


def meetings(at_anchors: DataFrame, names: list[str], link: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b), a > b: what ``link`` joins of the rows (anchor, home, node, fingerprint columns) that stand together at an anchor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(final: bool):
            t = pa.Table.from_batches(held).combine_chunks()
            key = t["anchor"].to_numpy()
            end = len(key) if final else int(np.searchsorted(key, key[-1]))
            left = t.slice(end).to_batches()
            if end:
                home, node = t["home"].to_numpy()[:end], t["node"].to_numpy()[:end]
                f = np.stack([t[c].to_numpy()[:end].view(np.uint64) for c in names], axis=1)
                a, b = link(key[:end], home, f)
                a, b = node[a], node[b]
                if len(a):
                    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
                    both = both[both[:, 0] != both[:, 1]]
                    return left, pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
            return left, None

        due = 300_000
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= due:
                held, out = flush(False)
                rows = sum(x.num_rows for x in held)
                due = max(300_000, 2 * rows)
                if out is not None:
                    yield out
        if held:
            _, out = flush(True)
            if out is not None:
                yield out

    return at_anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def visits(f: np.ndarray, places: list[tuple[int, int, int]], slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where the rows of f (fingerprints, a column for each lane) are sent, in parts: rows, anchors, and whether that is their home."""
    for block, (lane, first, width) in enumerate(places):
        value = f[:, lane] >> np.uint64(first)
        value = (value & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = _SYNDROME[value & ((1 << CODED) - 1)]
        for s, masks in enumerate(flips(width, slack)):
            rows = np.flatnonzero(syndrome == s)
            for lo in range(0, len(rows), max(1, 200_000 // len(masks))):
                part = rows[lo : lo + max(1, 200_000 // len(masks))]
                anchor = (value[part][:, None] ^ masks[None, :]) | (block << 32)
                home = np.zeros(anchor.shape, bool)
                home[:, 0] = True
                yield np.repeat(part, len(masks)), anchor.ravel(), home.ravel()


def links(prints: DataFrame, lanes: int, most: int, per_lane: int, slack: int) -> DataFrame:
    """(a, b): links between the node numbers of prints (node, f0, ...) at ``most`` differing bits or fewer, a > b.

    At each anchor the compared pairs are exhaustive. The links given join what all links would join.
    """
    places = blocks_of(lanes, per_lane)
    names = [f"f{k}" for k in range(lanes)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for source, anchor, home in visits(np.stack([c.view(np.uint64) for c in cols[1:]], axis=1), places, slack):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), *(pa.array(c[source]) for c in cols)], ["anchor", "home", "node", *names])

    at_anchors = prints.select("node", *names).mapInArrow(spread, "anchor long, home boolean, node long, " + ", ".join(f"{c} long" for c in names))
    return meetings(at_anchors, names, lambda key, home, f: meet(key, home, f, most))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, lanes: int = 1, most: int = 4, per_lane: int = 3, slack: int | None = None) -> DataFrame:
    """(id, f0, ..., n, component): documents whose fingerprints differ in ``most`` bits or fewer, joined transitively.

    Documents of equal fingerprints are one node before anything is compared, so a group of copies costs
    one fingerprint. component is the smallest id that can be reached (null ids are passed over; a
    component of null ids only has null); n is the number of shingles. Null and empty texts have fingerprint zero
    and are linked like any other; repeated ids are rows of their own; an empty table gives an empty
    result. With one lane and the default slack the search is exhaustive. With several lanes and a given slack it
    finds a link where some block of the lanes * per_lane differs in ``slack`` bits or fewer.
    """
    names = [f"f{k}" for k in range(lanes)]
    slack = most // (lanes * per_lane) if slack is None else slack
    prints = cut(fingerprints(docs, id_col, text_col, shingle, lanes))
    node = F.col("f0") if lanes == 1 else F.xxhash64(*names)
    classes = cut(prints.groupBy(*names).agg(F.min("id").alias("first")).withColumn("node", node))
    joined = components(links(classes, lanes, most, per_lane, slack))
    named = classes.join(joined, "node", "left").withColumn("component_node", F.coalesce("component", "node"))
    lowest = named.groupBy("component_node").agg(F.min("first").alias("component"))
    labels = named.drop("component").join(lowest, "component_node").select(*names, "component")
    return prints.join(labels, names, "left").select("id", *names, "n", "component")
