"""Removal of long byte strings that occur more than once, by a sparse, distributed suffix array.

A string of ``length`` bytes that occurs twice is a suffix whose first ``length`` bytes it shares with another.
Sorting every suffix would move each byte ``length`` times, so suffixes travel in families. The token of a window
of ``length`` bytes is its leftmost minimal ``token``-gram under a hash; windows with the same token at the same
place, which follow each other, are a family, stored once as the stretch of bytes they cover. Equal windows have
equal tokens at equal offsets, so:

1. Tokens that occur once in the corpus can't belong to a repeated window; their families go no further.
2. Equal stretches are counted before anything is moved: a family whose stretch occurs twice is repeated,
   and one copy of it stands for all in what follows.
3. The remaining stretches are range-partitioned by their suffixes from the token on, at sampled splitters. A splitter
   is cut short to the token where that parts it from the sample before it, so that only a token that fills a bucket is split.
4. Each bucket sorts the suffixes of its stretches by multikey quicksort, eight bytes a character, and likewise the
   reversed bytes before the token. Windows are equal if both sides are: the common prefixes of neighbours say which.
5. Across a boundary a window can only be equal to another if both share the boundary's bytes from the token to the
   window's end. One copy of each such window goes on, in stretches, to a second range partition by the bytes before
   the token; what lies across a boundary there too is decided by digests.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .cluster import columns_without, cut_to_table, discard, join_skewed, release

LENGTH = 400
TOKEN = 100
BLOCK = 1 << 20
BUCKET = 1 << 21
SAMPLES = 16


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values (van Herk and Gil-Werman)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def families(data: np.ndarray, length: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one text by token: first and last window start, token position, token hash."""
    got = []
    for lo in range(0, len(data) - length + 1, BLOCK):
        part = data[lo : lo + BLOCK + length - 1]
        sums = arrays.prefix_sums(part)
        n = len(part) - token + 1
        grams = arrays.mix((sums[token:] - sums[:n]) * arrays.powers(n)[1])
        ordered = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        place = (_sliding_minimum(ordered, length - token + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        got.append((first + lo, last + lo, place[first] + lo, grams[place[first]]))
    if not got:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*got))


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def multikey_order(words: np.ndarray, sizes: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Rows of words (strings as big-endian numbers of eight bytes, padded with zeros) in lexical order within each group.

    Multikey quicksort taken breadth first: strings still tied are split by their next eight bytes, and one that stands
    alone is not looked at again. ``sizes`` are the strings' lengths; a prefix of a string comes before it.
    """
    n = len(words)
    group = np.zeros(n, np.int64) if group is None else group
    order = np.argsort(group, kind="stable")
    old = group[order]
    live = np.arange(n)
    for depth in range(words.shape[1] + 1):
        if not len(live):
            break
        word = words[order[live], depth] if depth < words.shape[1] else sizes[order[live]]
        by = np.lexsort((word, old))
        order[live] = order[live[by]]
        word, old = word[by], old[by]
        new = np.r_[True, (word[1:] != word[:-1]) | (old[1:] != old[:-1])]
        old = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        alone = new & np.r_[new[1:], True]
        live, old = live[~alone], old[~alone]
    return order


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of x with y's, ``most`` at most."""
    differ = x != y
    first = differ.argmax(1) if x.shape[1] else np.zeros(len(x), np.int64)
    return np.minimum(np.where(differ.any(1), first, x.shape[1]), most)


def _matrix(data: np.ndarray, starts: np.ndarray, step: int, sizes: np.ndarray, width: int) -> np.ndarray:
    """data[s], data[s + step], ... for each start, ``size`` bytes of it, padded with zeros to a multiple of eight."""
    at = np.arange(-(-width // 8) * 8)
    inside = at[None] < sizes[:, None]
    return np.where(inside, data[np.where(inside, starts[:, None] + step * at[None], 0)], 0).astype(np.uint8)


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column, the row at which the run of each row begins, and whether the run is that row alone."""
    rows = np.arange(len(breaks), dtype=np.int32)[:, None]
    alone = breaks.copy()
    alone[:-1] &= breaks[1:]
    return np.maximum.accumulate(np.where(breaks, rows, 0), axis=0), alone


#: place of the token in the stretch, key, digest of the stretch, times it occurs, offset of the piece in the stretch
Piece = tuple[int, bytes, bytes, int, int]


def _key(piece: bytes, place: int, token: int, ahead: bool) -> bytes:
    """What a piece is sorted by, and is stored as: the bytes from the token on and, in reverse, those before it; or the token first, then those before."""
    before = piece[:place][::-1]
    return piece[place:] + before if ahead else piece[place : place + token] + before + piece[place + token :]


def _unkeyed(key: bytes, place: int, token: int, ahead: bool) -> bytes:
    if ahead:
        return key[len(key) - place :][::-1] + key[: len(key) - place]
    return key[token : token + place][::-1] + key[:token] + key[token + place :]


def compare(rows: list[Piece], low: bytes | None, high: bytes | None, length: int, token: int, ahead: bool) -> tuple[list[tuple], list[tuple]]:
    """The repeated windows of a bucket, and those to be compared across its boundaries.

    The first are (stretch, first offset, offset after the last); the second (row, smallest and largest bytes before the
    token), one row for each window or, where windows of the bucket are equal, for one of them.
    """
    n, width = len(rows), length - token
    place = np.fromiter((r[0] for r in rows), np.int64, n)
    size = np.fromiter((len(r[1]) for r in rows), np.int64, n)
    data = np.frombuffer(b"".join(_unkeyed(r[1], r[0], token, ahead) for r in rows), np.uint8)
    starts = np.cumsum(size) - size
    after = _matrix(data, starts + place, 1, size - place, length)
    before = _matrix(data, starts + place - 1, -1, place, width)

    by = multikey_order(after.view(">u8").astype(np.uint64), size - place)
    rows, place, size, after, before = [rows[i] for i in by], place[by], size[by], after[by], before[by]
    rest = size - place
    near = np.r_[-1, _common(after[1:], after[:-1], np.minimum(rest[1:], rest[:-1]))]
    same_token = np.cumsum(near < token)
    by = multikey_order(before.view(">u8").astype(np.uint64), place, same_token)
    near_before = np.r_[-1, _common(before[by[1:]], before[by[:-1]], np.minimum(place[by[1:]], place[by[:-1]]))]
    near_before[np.r_[True, same_token[by[1:]] != same_token[by[:-1]]]] = -1

    # Windows by row and number of bytes before the token; equal ones are in one run on both sides.
    offsets = np.arange(width + 1)
    valid = (offsets >= (place - size + length)[:, None]) & (offsets <= place[:, None])
    run_after, alone = _runs(near[:, None] < length - offsets)
    sorted_before, alone_before = _runs(near_before[:, None] < offsets)
    run_before = np.empty_like(sorted_before)
    run_before[by] = sorted_before
    alone[by] |= alone_before
    maybe = np.flatnonzero(valid & ~alone)
    row, offset = np.divmod(maybe, width + 1)
    classes = (run_after.ravel()[maybe].astype(np.int64) * n + run_before.ravel()[maybe]) * (width + 1) + offset
    into = np.argsort(classes, kind="stable")
    ordered = classes[into]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    tied, spare = np.zeros((2, *valid.shape), bool)
    tied.ravel()[maybe[into[~(new & np.r_[new[1:], True])]]] = True
    spare.ravel()[maybe[into[~new]]] = True  # equal to one that stands for it
    tied |= valid & (np.fromiter((r[3] for r in rows), np.int64, n) > 1)[:, None]

    edges = np.diff(np.pad(tied.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edges == 1)
    hi = np.nonzero(edges == -1)[1]
    base = np.fromiter((r[4] for r in rows), np.int64, n)[row] + place[row]
    hits = [(rows[i][2], a, z) for i, a, z in zip(row.tolist(), (base - hi + 1).tolist(), (base - lo + 1).tolist())]

    far = np.full(n, -1)
    for edge in (low, high):
        if edge is not None and len(edge) > token:
            of = np.full(length + width + 8, -1, np.int16)
            of[: min(len(edge), len(of))] = np.frombuffer(edge, np.uint8)[: len(of)]
            own = _common(after, of[None, : after.shape[1]], rest)
            if not ahead:
                own = np.where(own >= token, token + _common(before, of[None, token : token + before.shape[1]], place), own)
            far = np.maximum(far, own)
    across = valid & ~spare & (far[:, None] >= (length - offsets if ahead else token + offsets))
    some = np.flatnonzero(across.any(1))
    least, most = across[some].argmax(1), width - across[some][:, ::-1].argmax(1)
    pieces = [(rows[i], a, z, np.flatnonzero(across[i]).tolist()) for i, a, z in zip(some.tolist(), least.tolist(), most.tolist())]
    return hits, pieces


def splitters(keys: list[bytes], parts: int, token: int) -> list[bytes]:
    """At most parts - 1 boundaries from sampled keys. A boundary moves back to the first sample of its token if that is near, and is no longer than parts it from the sample before."""
    keys = sorted(set(keys))
    step, out = len(keys) / max(1, parts), set()
    for i in {int(step * k) for k in range(1, parts)} - {0}:
        back = i
        while back and i - back <= step / 2 and keys[back - 1][:token] == keys[i][:token]:
            back -= 1
        i = back if back and keys[back - 1][:token] != keys[i][:token] else i
        common = next((k for k, (x, y) in enumerate(zip(keys[i - 1], keys[i])) if x != y), len(keys[i - 1]))
        out.add(keys[i][: max(token, common + 1)])
    return sorted(out)


def _compared(pieces: DataFrame, rows: int, length: int, token: int, ahead: bool, bucket: int) -> DataFrame:
    """Pieces by range of their keys, compared in each bucket: rows with stop are repeated windows, others what lies across boundaries.

    The latter hold a piece for the next round, or, where that is over, digests of windows.
    """
    spark = pieces.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLES * parts / max(1, rows))
    edges = splitters([bytes(r[0]) for r in pieces.select("key").sample(share, 7).collect()], parts, token)

    def place_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(edges, k) for k in b.column(1).to_pylist()], pa.int32())], [*b.schema.names, "bucket"])

    def judge(held: list[Piece], low: bytes | None, high: bytes | None) -> Iterator[pa.RecordBatch]:
        hits, pieces = compare(held, low, high, length, token, ahead)
        out = [(s, a, z, None, None, None) for s, a, z in hits]
        for (place, key, stretch, _, base), least, most, offsets in pieces:
            whole = _unkeyed(key, place, token, ahead)
            if ahead:
                out.append((stretch, base + place - most, None, most, _key(whole[place - most : place + length - least], most, token, False), None))
            else:
                out += [(stretch, base + place - o, None, None, None, _digest(whole[place - o : place - o + length])) for o in offsets]
        for lo in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 20_000]), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["stretch", "start", "stop", "place", "key", "digest"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Piece] = []
        size, now, low = 0, -1, None
        for b in batches:
            for *r, at in zip(*(c.to_pylist() for c in b.columns)):
                if held:
                    parted = held[-1][1][:token] != r[1][:token]
                    if at != now or size > bucket and parted or size > 2 * bucket:
                        yield from judge(held, low, edges[now] if at != now else None if parted else r[1])
                        low = None if parted else r[1]
                        held, size = [], 0
                if at != now:
                    now, low = at, edges[at - 1] if at else None
                held.append(tuple(r))
                size += len(r[1])
        if held:
            yield from judge(held, low, edges[now] if now < len(edges) else None)
        arrays.trim()

    fields = "place long, key binary, stretch binary, n long, base long"
    placed = pieces.select("place", "key", "stretch", "n", "base").mapInArrow(place_in, f"{fields}, bucket int")
    ordered = placed.repartitionById(max(1, len(edges) + 1), "bucket").sortWithinPartitions("bucket", "key")
    return cut_to_table(ordered.mapInArrow(sort, "stretch binary, start long, stop long, place long, key binary, digest binary"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, token: int = TOKEN, bucket: int = BUCKET) -> DataFrame:
    """(id, text_key, spans): for each document with repeated strings, byte ranges [start, end) that cover them.

    A string of ``length`` UTF-8 bytes is repeated if it also starts anywhere else in the corpus, in the
    same document included. The ranges can overlap; merged() orders and joins them. text_key is a digest of the text: rows that
    share an id are told apart by it, and rows that share both count as two documents (so each covers the other).
    Null is the empty text. Texts shorter than ``length`` have no spans.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.buffers(b.column(1))
            rows, cols, size = [], [[], [], [], []], 0

            def out():
                ids = b.column(0).take(pa.array(np.concatenate([r for r, _ in rows])))
                return pa.RecordBatch.from_arrays([ids, pa.array([x for _, k in rows for x in k], pa.binary()), *(pa.array(np.concatenate(c)) for c in cols[:3]), pa.array([x for c in cols[3] for x in c], pa.binary())], ["id", "text_key", "first", "last", "token", "stretch"])

            for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
                part = data[offsets[i] : offsets[i + 1]]
                raw = part.tobytes()
                first, last, _, gram = families(part, length, token)
                rows.append((np.full(len(first), i), [_digest(raw)] * len(first)))
                for c, x in zip(cols, (first, last, gram.view(np.int64), [_digest(raw[a : z + length]) for a, z in zip(first.tolist(), last.tolist())])):
                    c.append(x)
                size += len(first)
                if size > 50_000:
                    yield out()
                    rows, cols, size = [], [[], [], [], []], 0
            if rows:
                yield out()

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut_to_table(named.mapInArrow(scan, f"id {kind}, text_key binary, first long, last long, token long, stretch binary"))

    families_found = found.count()
    uses = cut_to_table(found.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1"))
    shared = cut_to_table(join_skewed(found, uses.drop("uses"), "token", uses, families_found).drop("token"))
    discard(found, uses)
    found = shared
    release(docs.sparkSession)
    kinds = found.groupBy("stretch").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "id", "first", "last")).alias("at"))

    # One copy of each stretch is fetched, from the text that its smallest place names.
    wanted = kinds.select(F.col("at.text_key").alias("at_key"), F.col("at.id").alias("at_id"), F.struct("at.first", "at.last", "stretch", "n").alias("cut"))
    wanted = wanted.groupBy("at_key", "at_id").agg(F.collect_list("cut").alias("cuts"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, text_keys(b.column(1))], ["id", "text", "text_key"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["place", "key", "stretch", "n", "base"])

        seen: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            for text, cuts in zip(b.column(0), b.column(1)):
                raw, cuts = text.as_py().encode(), cuts.as_py()
                if cuts[0]["stretch"] in seen:  # a row that occurs twice, id and text
                    continue
                seen.add(cuts[0]["stretch"])
                for c in cuts:
                    piece = raw[c["first"] : c["last"] + length]
                    place = int(families(np.frombuffer(piece, np.uint8), length, token)[2][0])
                    out.append((place, _key(piece, place, token, True), c["stretch"], c["n"], 0))
                if len(out) > 5_000:
                    yield send(out)
                    out = []
            if out:
                yield send(out)

    texts = named.where(F.octet_length("text") >= length).mapInArrow(keyed, f"id {kind}, text string, text_key binary")
    sources = texts.join(wanted, (texts.text_key == wanted.at_key) & texts.id.eqNullSafe(wanted.at_id)).select("text", "cuts")
    pieces = cut_to_table(sources.mapInArrow(cut_out, "place long, key binary, stretch binary, n long, base long"))
    release(docs.sparkSession)

    n_pieces = pieces.count()
    judged = _compared(pieces, n_pieces, length, token, True, bucket)
    release(docs.sparkSession)
    decided = judged.where("stop is not null").select("stretch", "start", "stop")
    further = judged.where("key is not null")
    n_further = further.count()
    if n_further:
        again = _compared(further.select("place", "key", "stretch", F.lit(1).cast("long").alias("n"), F.col("start").alias("base")), n_further, length, token, False, bucket)
        across = again.where("digest is not null")
        common = across.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        met = across.join(common, "digest").select("stretch", "start", (F.col("start") + 1).alias("stop"))
        decided = decided.union(again.where("stop is not null").select("stretch", "start", "stop")).union(met)
    hits = decided.groupBy("stretch").agg(F.collect_list(F.struct("start", "stop")).alias("hits"))

    each = join_skewed(found.select("id", "text_key", "first", "stretch"), hits, "stretch", pieces.select("stretch", F.col("n").alias("uses")), families_found)
    spans = F.transform("hits", lambda h: F.struct((F.col("first") + h["start"]).alias("start"), (F.col("first") + h["stop"] - 1 + length).alias("end")))
    return each.groupBy("id", "text_key").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def merged(spans) -> list[dict]:
    """Ordered, disjoint spans that cover what the given ones cover."""
    out: list[dict] = []
    for a, z in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], z)
        else:
            out.append({"start": a, "end": z})
    return out


def text_keys(column) -> pa.Array:
    """A digest of each text."""
    data, offsets = arrays.buffers(column)
    return pa.array([_digest(data[a:z].tobytes()) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, token: int = TOKEN, bucket: int = BUCKET) -> DataFrame:
    """The columns of docs and: n_bytes, spans (removed byte ranges), kept (the other bytes, joined, as binary).

    One row for each row of docs. Null text has 0 bytes and nothing to remove. Kept bytes can end inside a character.
    Columns of docs named like the new ones are replaced.
    """
    docs = columns_without(docs, [id_col, text_col], ["n_bytes", "spans", "kept"])
    spans = repeated_spans(docs, id_col, text_col, length, token, bucket)
    names = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, text_keys(b.column(at))], [*names, "__key"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            data, offsets = arrays.buffers(b.column(at))
            size, kept, all_spans = [], [], []
            for i, s in enumerate(b.column(len(names)).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                s = merged((x["start"], x["end"]) for x in s or [])
                edges = [0, *(e for x in s for e in (x["start"], x["end"])), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])))
                size.append(len(raw))
                all_spans.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(size, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], [*names, "n_bytes", "spans", "kept"])

    plain = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    left = docs.mapInArrow(key, f"{plain}, __key binary")
    right = spans.select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key"), F.col("spans").alias("__spans"))
    joined = left.join(right, (left["__key"] == right["__text_key"]) & left[id_col].eqNullSafe(right["__id"]), "left")
    return joined.select(*(left[n] for n in names), "__spans").mapInArrow(drop, f"{plain}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
