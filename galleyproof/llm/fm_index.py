"""Benchmark decontamination with an FM-index over the words of each shard of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .cluster import columns_without

WINDOW = 10
SHARD_BYTES = 3 << 20
SAMPLE = 16
PHRASE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word: digits, letters and all beyond ASCII, A-Z lowered."""
    low = _LOWER[data]
    starts, ends, rows = arrays.word_bounds(low, offsets, _WORD)
    return arrays.span_hashes(low, starts, ends), starts, ends, rows


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s in the order of their suffixes: doubling that looks again only at suffixes still tied."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    size = int(s.max()) + 2
    depth = max(1, min(8, int(62 // math.log2(size))))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key *= size
        key[: max(0, n - k)] += s[k:].astype(np.int64) + 1
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    live = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(live):
        at = order[live]
        nxt = np.full(len(at), -1, np.int64)
        inside = at + depth < n
        nxt[inside] = rank[at[inside] + depth]
        group = rank[at]
        by = np.lexsort((nxt, group))
        order[live] = at[by]
        group, nxt = group[by], nxt[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        rank[order[live]] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector a level (the levels of the tree side by side)."""

    def __init__(self, s: np.ndarray, size: int):
        self.bits = max(1, (size - 1).bit_length())
        self.ones, self.zeros, self.raw = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.raw.append(bit)
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi."""
        start = np.zeros(len(symbols), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbols >> (self.bits - 1 - k) & 1).astype(bool)
            start, lo, hi = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, lo, hi))
        return lo - start, hi - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before it."""
        symbol, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for raw, ones, zeros in zip(self.raw, self.ones, self.zeros):
            bit = raw[at]
            symbol = symbol << 1 | bit
            start, at = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, at))
        return symbol, at - start


class FMIndex:
    """Finds sequences of words in a shard. Words are given by their hashes; texts are parted by a symbol of its own."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, n_rows: int):
        self.alphabet, symbols = np.unique(hashes, return_inverse=True)
        counts = np.bincount(rows, minlength=n_rows)
        # Each text is followed by symbol 1; symbol 0 ends the whole, so that suffixes and rotations have one order.
        self.first = np.cumsum(counts + 1) - (counts + 1)
        self.counts = counts
        s = np.ones(len(hashes) + n_rows + 1, np.int64)
        s[-1] = 0
        self.places = np.arange(len(hashes)) + rows
        s[self.places] = symbols + 2
        self.n = len(s)
        size = len(self.alphabet) + 2
        order = suffix_array(s)
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=size))]
        self.tree = WaveletTree(s[order - 1], size)
        self.sampled = order % SAMPLE == 0
        self.kept = np.r_[0, np.cumsum(self.sampled)]
        self.sample = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase (a row of word hashes); only phrases that occur."""
        if not len(phrases) or not len(self.alphabet):
            return (np.zeros(0, np.int64),) * 3
        symbols = np.searchsorted(self.alphabet, phrases)
        known = (self.alphabet[np.minimum(symbols, len(self.alphabet) - 1)] == phrases).all(axis=1)
        which = np.flatnonzero(known)
        symbols = symbols[which] + 2
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            lo, hi = (self.before[symbols[:, k]] + x for x in self.tree.rank(symbols[:, k], lo, hi))
            alive = lo < hi
            which, symbols, lo, hi = which[alive], symbols[alive], lo[alive], hi[alive]
        return which, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text position of each suffix row: step back through the text to a row whose position is kept."""
        out, steps, open_ = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(open_):
            hit = self.sampled[at[open_]]
            done = open_[hit]
            out[done] = self.sample[self.kept[at[done]]] + steps
            open_ = open_[~hit]
            symbol, earlier = self.tree.access(at[open_])
            at[open_] = self.before[symbol] + earlier
            steps += 1
        return out


def phrases_of(items: list[tuple[str, str]], window: int) -> dict[int, tuple[np.ndarray, list[list[str]]]]:
    """By length: distinct windows as rows of word hashes, and the items of each. Items of fewer words are one window; none, none."""
    found: dict[int, dict[bytes, set[str]]] = {}
    data, offsets = arrays.buffers(pa.array([t or "" for _, t in items], pa.large_string()))
    for at, to, part, bounds in arrays.chunks(data, offsets):
        hashes, _, _, rows = words_of(part, bounds)
        cuts = np.searchsorted(rows, np.arange(to - at + 1))
        for i in range(to - at):
            h = hashes[cuts[i] : cuts[i + 1]]
            n = min(window, len(h))
            for k in range(len(h) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(h[k : k + n].tobytes(), set()).add(items[at + i][0])
    return {n: (np.frombuffer(b"".join(w), np.uint64).reshape(-1, n), [sorted(x) for x in w.values()]) for n, w in found.items()}


def hits(hashes: np.ndarray, rows: np.ndarray, n_rows: int, phrases: dict) -> tuple[np.ndarray, list[set[str]]]:
    """For each word whether it lies in an occurrence of a phrase; for each text the items whose phrases occur."""
    index = FMIndex(hashes, rows, n_rows)
    cover = np.zeros(index.n + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_rows)]
    for length, (windows, owners) in phrases.items():
        which, lo, hi = index.search(windows)
        if not len(which):
            continue
        suffixes, owner = arrays.ranges(lo, hi - lo)
        at = index.locate(suffixes)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        row = np.searchsorted(index.first, at, "right") - 1
        for r, w in np.unique(np.stack([row, which[owner]], axis=1), axis=0).tolist():
            items[r].update(owners[w])
    return (np.cumsum(cover)[:-1] > 0)[index.places], items


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", _SPANS), ("items", T.ArrayType(T.StringType()))]


def _pass(docs: DataFrame, items: list[tuple[str, str]], text_col: str, window: int) -> DataFrame:
    at = docs.columns.index(text_col)
    phrases = phrases_of(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.buffers(b.column(at))
            for lo, hi, part, bounds in arrays.chunks(data, offsets, SHARD_BYTES):
                hashes, starts, ends, rows = words_of(part, bounds)
                hit, found = hits(hashes, rows, hi - lo, phrases)
                edge = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
                opens = hit & (edge | ~np.r_[False, hit[:-1]]) if len(hit) else hit
                closes = hit & np.r_[edge[1:] | ~hit[1:], True] if len(hit) else hit
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                for r, a, z in zip(rows[opens].tolist(), starts[opens].tolist(), ends[closes].tolist()):
                    spans[r].append({"start": a - int(bounds[r]), "end": z - int(bounds[r])})
                part_of = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    *part_of.columns,
                    pa.array(np.bincount(rows, minlength=hi - lo)),
                    pa.array(np.bincount(rows[hit], minlength=hi - lo)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ], [*part_of.schema.names, *(n for n, _ in _FIELDS)])
        arrays.trim()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in _FIELDS)]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """The columns of docs and: n_words, n_hit, spans (UTF-8 byte ranges of hit words, merged), items (as strings, ordered).

    A word is hit if it lies in an occurrence of ``window`` consecutive words of a benchmark item, or of a shorter
    item as a whole. Runs of texts of about 3 MB are the shards; a longer text is a shard alone. The documents
    never move. The benchmark's texts go to all tasks where they have ``phrase_bytes`` bytes at most;
    a larger benchmark is dealt into parts of that size, and the documents are searched once for each.
    Null and empty texts have no words. Null item texts, and items without words, hit nothing; a null item_id is not
    listed, but its words count as hit; an empty one is an id like any other. Repeated rows are judged alike. Columns of docs named
    like the new ones are replaced. Words of an item are shipped at about 13 times its bytes, so a part takes some 52 MB of a worker.
    """
    docs = columns_without(docs, [text_col], [n for n, _ in _FIELDS])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // phrase_bytes))
    out = None
    for k in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        rows = [("=" + r[0] if r[0] is not None else "", r[1]) for r in block.collect()]  # the mark tells an empty id from none
        if out is None:
            out = _pass(docs, rows, text_col, window)
            continue
        more = _pass(out.select(*docs.columns, *(F.col(n).alias(f"__{n}") for n, _ in _FIELDS)), rows, text_col, window)
        spans = F.array_sort(F.concat("__spans", "spans"))
        joined = F.aggregate(spans, F.array().cast("array<struct<start: long, end: long>>"), lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))))
        out = more.select(*docs.columns, "n_words", F.col("n_hit").alias("__n"), F.col("__n_hit"), joined.alias("spans"), F.array_sort(F.array_union("__items", "items")).alias("items"))
        out = _count_hits(out, docs, text_col)
    return out.withColumn("items", F.transform(F.filter("items", lambda x: x != ""), lambda x: F.substring(x, 2, 1 << 30)))


def _count_hits(df: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """n_hit of spans joined over several passes: the words that they hold."""
    at, fields = docs.columns.index(text_col), [*docs.columns, "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.buffers(b.column(at))
            _, starts, _, rows = words_of(data, offsets)
            cuts, counts = np.searchsorted(rows, np.arange(len(offsets))), []
            for i, spans in enumerate(b.column(b.schema.get_field_index("spans")).to_pylist()):
                s = starts[cuts[i] : cuts[i + 1]] - offsets[i]
                counts.append(sum(int(np.searchsorted(s, x["end"]) - np.searchsorted(s, x["start"])) for x in spans))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], [*b.schema.names, "n_hit"])

    picked = df.select(*fields)
    out = picked.mapInArrow(run, T.StructType([*picked.schema.fields, T.StructField("n_hit", T.LongType())]))
    return out.select(*docs.columns, *(n for n, _ in _FIELDS))


def cut_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """found with the byte ranges in spans taken out of its texts; other texts stay as they are. Ranges begin and end beside ASCII bytes or at an end."""
    raw, zero = F.col(text_col).cast("binary"), F.array(F.lit(0).cast("long"))
    kept = F.zip_with(F.concat(zero, F.col("spans.end")), F.concat(F.col("spans.start"), F.array(F.octet_length(text_col).cast("long"))), lambda a, z: F.substring(raw, (a + 1).cast("int"), (z - a).cast("int")).cast("string"))
    return found.withColumn(text_col, F.when(F.size("spans") > 0, F.array_join(kept, "")).otherwise(F.col(text_col)))
