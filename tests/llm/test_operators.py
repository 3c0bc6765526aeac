"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from galleyproof.llm import bpe, fm_index, line_runs, multi_index, resampling, sharding, simhash, suffixes, url_trees

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
rng = np.random.default_rng(3)
LONG = " ".join(rng.choice(WORDS, 400))
TEXTS = [None, "", "  \n ", "one", LONG, LONG, LONG[:900] + " omega " + LONG[900:], "x" * 1500, "é" * 300 + LONG[100:700], "a\nb\n" + LONG + "\nc", " ".join(rng.choice(WORDS, 3000))]
SCHEMA = "doc_id long, text string, id string, n int"
ROWS = [(i, x, "clash", 1) for i, x in enumerate(TEXTS)] + [(4, LONG, "clash", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, empty):
    def print_of(x):
        w = (x or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    prints = [print_of(x) for _, x, _, _ in ROWS]
    assert sorted((r.id, r.f0 % 2**64) for r in got) == sorted((r[0], p) for r, p in zip(ROWS, prints))
    low = list(prints)
    best = {p: min(r[0] for r, q in zip(ROWS, prints) if q == p) for p in prints}
    for _ in low:
        best = {p: min(best[q] for q in best if (p ^ q).bit_count() <= 4) for p in best}
    assert all(r.component == best[r.f0 % 2**64] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_suffixes(spark, docs, empty):
    words = np.random.default_rng(5)
    passage = " ".join(words.choice(WORDS, 200))
    cut = [passage[int(words.integers(0, 300)) : int(words.integers(700, len(passage)))] for _ in range(80)]
    hot = [" ".join(words.choice(WORDS, 60)) + x + " ".join(words.choice(WORDS, 60)) for x in cut] + ["\0" * 900 + "a" + "\0" * 600, "ab\0" * 200]
    many = [(i, x, "clash", 1) for i, x in enumerate(hot)]
    for rows, table, bucket in ((ROWS, docs, suffixes.BUCKET), (many, spark.createDataFrame(many, SCHEMA).withColumnsRenamed({"id": "spans", "n": "kept"}), 4_000)):
        raw = [(r[1] or "").encode() for r in rows]
        seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
        want = []
        for b in raw:
            gone = bytearray(len(b))
            for i in range(len(b) - 399):
                if seen[b[i : i + 400]] > 1:
                    gone[i : i + 400] = b"\1" * 400
            runs = sum(g and not h for g, h in zip(gone, b"\0" + gone))
            want.append((len(b), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
        got = suffixes.remove_repeats(table, bucket=bucket).collect()
        assert sorted((r.n_bytes, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == sorted(want)
    assert suffixes.remove_repeats(empty).count() == 0


def test_bpe_round_trip(docs, empty):
    path, pattern = bpe.default_files()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.token_ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    ids = docs.sparkSession.createDataFrame([(None,), ([],), ([5, 6],), (None,), ([7],)], "token_ids array<int>")
    tokens = bpe.bytes_by_rank(bpe.load_ranks(path))
    assert Counter(r.decoded and bytes(r.decoded) for r in bpe.decode(ids, path, pattern).collect()) == Counter([None, None, b"", tokens[5] + tokens[6], tokens[7]])
    with pytest.raises(Exception, match="out of bounds"):
        bpe.decode(docs.sparkSession.createDataFrame([([10**6],)], "token_ids array<int>"), path, pattern).collect()
    assert bpe.length_histogram(empty, path, pattern).count() == 0
    totals = bpe.context_totals(bpe.length_histogram(docs, path, pattern)).collect()
    n = np.array([len(r.token_ids) for r in got])
    for t in totals:
        want = ((n == t.context_limit).sum(), (n <= t.context_limit).sum(), n[n <= t.context_limit].sum(), (n > t.context_limit).sum(), np.minimum(n, t.context_limit).sum(), (n <= t.context_limit).mean())
        assert (t.n_docs, t.docs_within, t.tokens_within, t.docs_beyond, t.tokens_truncated) == want[:5] and abs(t.quantile - want[5]) < 1e-12
    table = bpe.context_totals(bpe.length_histogram(docs, path, pattern), width=5)
    limits = [0, 1, 7, 500, 10**6]
    for t in bpe.totals_at(table, limits).collect():
        c = t.context_limit
        assert (t.docs_within, t.tokens_within, t.docs_beyond, t.tokens_truncated) == ((n <= c).sum(), n[n <= c].sum(), (n > c).sum(), np.minimum(n, c).sum())
    for t in bpe.length_quantiles(table, [0.1, 0.5, 0.9, 1.0]).collect():
        assert t.length == np.sort(n)[int(np.ceil(t.share * len(n) - 1e-9)) - 1]
    assert bpe.totals_at(bpe.context_totals(bpe.length_histogram(empty, path, pattern)), limits).count() == 5
    clashing = docs.withColumnsRenamed({"id": "token_ids", "n": "decoded"})
    assert bpe.decode(bpe.encode(clashing, path, pattern), path, pattern).columns == ["doc_id", "text", "token_ids", "decoded"]


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, 5).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.row_of([r.shard for r in got], [r.slot for r in got], len(got), 5).tolist() == [r.row for r in got]
    raw = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.id, r["size"], r.text_crc32) for r in got) == raw
    assert [r.row for r in sorted(got, key=lambda r: r.row)] == list(range(len(ROWS))) and [r.id for r in sorted(got, key=lambda r: r.row)] == sorted(r[0] for r in ROWS)
    assert got == sharding.assign_shards(docs.repartition(3), 5).collect() or sorted(got) == sorted(sharding.assign_shards(docs.repartition(3), 5).collect())
    assert sharding.assign_shards(empty).count() == 0


def test_lines(spark, empty):
    run = "one two three four five\nsix seven eight nine ten eleven"
    rows = [(1, "head\n" + run + "\ntail", "c", 1), (2, run + "\n\nother", "c", 1), (3, "one two three four five", "c", 1), (4, None, "c", 1), (5, "", "c", 1), (6, run, "c", 1)]
    got = {r.doc_id: r for r in line_runs.remove_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].kept for i in range(1, 7)] == [rows[0][1], "\nother", rows[2][1], None, "", ""]
    assert got[2].removed == [0, 1] and got[4].n_lines == 0
    assert line_runs.remove_repeated_lines(empty).count() == 0


def test_lines_against_brute_force(spark):
    """Runs of 50 lines, repeated rows, ties, blank lines, a hot line, clashing columns."""
    r = random.Random(6)
    prose = [" ".join(r.choices(WORDS, k=r.randint(1, 6))) + f" {i}" for i in range(200)]
    run, hot = prose[:50], "licence text of many words that stands in every third document here"
    texts = []
    for i in range(60):
        own = [f"line {i} {j} " + " ".join(r.choices(WORDS, k=3)) for j in range(r.randint(1, 8))]
        cut = r.randint(0, 30)
        texts.append("\n".join([*own[:2], *([hot] if i % 3 == 0 else []), "", *(run[cut : cut + r.randint(1, 50)] if i % 2 else []), *own[2:], *(prose[100 + i % 5 : 103 + i % 5])]))
    texts += ["\n".join(run), "\n".join(run), "\n".join(run * 2), None, "", "\n \n"]
    rows = [(i, x, "clash", 1) for i, x in enumerate(texts)] + [(7, texts[7], "clash", 1), (None, "\n".join(run[:9]), "clash", 1)]
    got = line_runs.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, kept string, longest int")).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "n_lines", "removed", "kept", "longest"}
    once = sorted({(-1 if i is None else i, x) for i, x, *_ in rows if x is not None})
    filled = {key: [(n, c) for n, c in enumerate(key[1].split("\n")) if c.split()] for key in once}
    seen, gone = {}, {key: set() for key in once}
    for key in once:  # earlier documents first; of one document earlier lines first
        lines = filled[key]
        for a in range(len(lines)):
            for z in range(a + 1, min(a + 10, len(lines)) + 1):
                window = tuple(c for _, c in lines[a:z])
                if sum(len(c.split()) for c in window) >= 10 and seen.setdefault(window, (key, a)) != (key, a):
                    gone[key] |= {n for n, _ in lines[a:z]}
    for row in got:
        if row.text is not None:
            want = gone[(-1 if row.doc_id is None else row.doc_id, row.text)]
            assert row.removed == sorted(want) and row.kept == "\n".join(c for n, c in enumerate(row.text.split("\n")) if n not in want)
    by = {row.doc_id: row for row in got}
    assert by[61].longest == 32 and by[61].kept == "" and by[63].kept is None and by[64].n_lines == 1


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([(1, LONG[50:200]), (2, "nowhere to be found"), (3, None), (4, "omega"), (5, "")], "item_id long, text string")
    for size in (fm_index.PHRASE_BYTES, 60):
        got = fm_index.find_contamination(docs, items, phrase_bytes=size).collect()
        by = {r.text: r for r in got}
        assert by[LONG].items == ["1"] and by[TEXTS[6]].items == ["1", "4"] and by["one"].n_hit == 0 and by[None].n_words == 0
        cut = {r.doc_id: r for r in fm_index.cut_spans(fm_index.find_contamination(docs, items, phrase_bytes=size)).collect()}
        for r in got:
            edges = [0, *(e for s in r.spans for e in (s.start, s.end)), len((r.text or "").encode())]
            want = b"".join((r.text or "").encode()[a:z] for a, z in zip(edges[::2], edges[1::2])).decode()
            assert (cut[r.doc_id].text or "") == want and (cut[r.doc_id].text is None) == (r.text is None)
    assert fm_index.find_contamination(empty, items).count() == 0
    unnamed = spark.createDataFrame([("", LONG[50:200]), (None, "omega"), ("b", "omega"), ("b", "omega")], "item_id string, text string")
    clashing = docs.withColumnsRenamed({"id": "spans", "n": "n_words"})
    got = {r.text: r for r in fm_index.find_contamination(clashing, unnamed).collect()}
    assert got[LONG].items == [""] and got[TEXTS[6]].items == ["", "b"] and set(got[LONG].asDict()) == {"doc_id", "text", "n_words", "n_hit", "spans", "items"}


def test_suffix_array_and_wavelet_tree():
    s = rng.integers(0, 3, 300)
    order = fm_index.suffix_array(s)
    assert order.tolist() == sorted(range(300), key=lambda i: s[i:].tolist())
    tree = fm_index.WaveletTree(s, 3)
    lo, hi = tree.rank(np.array([2, 0]), np.array([5, 7]), np.array([300, 200]))
    assert (lo.tolist(), hi.tolist()) == ([int((s[:5] == 2).sum()), int((s[:7] == 0).sum())], [int((s == 2).sum()), int((s[:200] == 0).sum())])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest(spark, kind):
    x = np.random.default_rng(1).normal(size=(400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, [0.0] * 8), (401, None), (402, [float("nan")] * 8), (403, [1.0] * 7), (500, x[7].tolist()), (None, x[1].tolist())]
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, rank int, key string")
    got = multi_index.nearest(table, recall=1.0).collect()
    x = np.concatenate([x, x[7:8]]).astype(float)
    ids = np.array([*range(400), 500])
    for q in (0, 100, 200, 300, 500):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r[1])] == want
    assert multi_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_repeated_ids(spark):
    """Candidates are all rows but the query's own, so rows that share its id count."""
    x = np.random.default_rng(2).normal(size=(30, 8)).astype(np.float32)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(100, x[3].tolist())] * 14 + [(200, x[3].tolist())] * 4 + [(200, x[9].tolist())] + [(300 + i, x[3].tolist()) for i in range(12)]
    got = multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=1.0).collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).astype(float)
    for q in (100, 200, 300):
        want = Counter()
        for at in np.flatnonzero(ids == q):
            d = np.sqrt(((v - v[at]) ** 2).sum(1))
            want.update((rank, int(ids[i])) for rank, i in enumerate([i for i in np.lexsort((ids, d)) if i != at][:10], 1))
        assert Counter((r["rank"], r.id) for r in got if r.query_id == q) == want


def test_nearest_skips_cells(spark):
    """On vectors that hardly cluster, and on some that do, the share learnt finds nine in ten without reading all."""
    r = np.random.default_rng(3)
    for name, x in (("flat", r.normal(size=(12_000, 16))), ("clustered", r.normal(size=(60, 16))[r.integers(0, 60, 12_000)] * 3 + r.normal(size=(12_000, 16)) * 0.3)):
        x = x.astype(np.float32)
        vectors = spark.createDataFrame(pd.DataFrame({"vec_id": range(12_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
        got = {(r.query_id, r.id) for r in multi_index.nearest(vectors, sample_rows=6_000).collect()}
        x, hits = x.astype(float), 0
        for q in range(0, 12_000, 100):
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += sum((q, int(i)) in got for i in np.argsort(d, kind="stable")[:10])
        assert hits / 1_200 >= 0.9
        sample = x[:6_000]
        books = [multi_index.codebook(sample[:, :8], 128), multi_index.codebook(sample[:, 8:], 128)]
        assert multi_index.share_for(sample, books, 10, 0.95) < {"flat": 0.4, "clustered": 0.1}[name]


def tokens(text):
    """The n-grams of a text, counted: words, their beginnings, shapes of tokens, a word five times running."""
    low = [w for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shape = lambda t: re.sub(r"(.)\1+", lambda m: m[1] if m[1] in "0Aa" else m[0], re.sub(r"[a-z\x80-\U0010ffff]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t))))
    begin = [(n, x.encode()[:n]) for x in low for n in resampling.BEGINNINGS if len(x.encode()) > n]
    return Counter([("w", x) for x in low] + [("b", x) for x in begin] + [("s", shape(x)) for x in re.split(r"[ \t-\r]+", text or "") if x] + [("r",) for i in range(len(low) - 4) if len(set(low[i : i + 5])) == 1])


def test_quality_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" + "beginning" * (k % 7 == 0) for k in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(2, 60)) + (["zqx"] * r.randint(1, 2) + ["Vkw!!"] if i % 4 == 0 else [])) for i in range(600)] + [None, "", " \n", "spam " * 9, texts_long := " ".join(r.choices(words, k=40_000)), texts_long]
    docs = spark.createDataFrame([(i, x, "clash", 1.5) for i, x in enumerate(texts)] + [(7, texts[7], "clash", 1.5)], "doc_id long, text string, selected string, log_weight double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(3, None, 0), (5, 1, None), (9_999, 1, 0)], "doc_id long, quality int, toxic int")
    model = resampling.fit(docs, labels)
    got = resampling.resample(docs, model, k=200).collect()
    assert len(got) == len(texts) + 1 and set(got[0].asDict()) == {"doc_id", "text", "log_weight", "gumbel_key", "selected"}

    # The models by hand: copies count once; held-out rows are those that the operator's hash names.
    out = {x[0] for x in labels.where(f"pmod(xxhash64({resampling.HELD_OUT}, doc_id), {resampling.HELD_OUT}) = 0").collect()}
    grams, once = [tokens(x) for x in texts], []
    for i, x in enumerate(texts):
        if x not in texts[:i] and (len((x or "").split()) > 1 or i == texts.index(" \n")):
            once.append(i)
    target, raw = Counter(), Counter()
    for i in once:
        raw.update(set(grams[i]))
        if i < 300 and i % 4 and i not in out:
            target.update(set(grams[i]))
    share = sum(i < 300 and i % 4 > 0 and i not in out for i in once) / len(once)
    ratio = {}
    for g, n in raw.items():
        e = n * share
        evidence = (target[g] * np.log(target[g] / e) if target[g] else 0) - target[g] + e
        ratio[g] = np.log((target[g] + resampling.PRIOR) / (e + resampling.PRIOR)) / (1 + resampling.ODDS * np.exp(-evidence))
    want = [sum(ratio.get(g, 0) * (1 + np.log(n)) for g, n in grams[i].items()) for i in range(len(texts))]
    assert all(abs(row.log_weight - want[row.doc_id]) < 0.05 + 0.05 * abs(want[row.doc_id]) for row in got)  # n-grams can share a bucket
    assert min(want) < -4 and max(ratio.values()) > 0 > min(ratio.values())
    last = sorted((row.gumbel_key for row in got), reverse=True)[199]
    assert all(row.selected == (row.gumbel_key >= last) for row in got)
    kept = [row.doc_id for row in resampling.resample(docs, model).where("selected").collect()]
    assert len(set(kept) & {i for i in range(600) if i % 4}) > 400 and len(set(kept) & {i for i in range(0, 600, 4)}) < 8
    none = spark.createDataFrame([], docs.schema)
    assert resampling.resample(none, resampling.fit(none, labels)).count() == 0
    assert resampling.resample(docs, resampling.fit(docs, labels.limit(0))).where("selected").count() == len(texts) + 1


def test_quality_counts_all_texts_and_labels(spark):
    """Texts that share what is smallest in them count apart, and labels do so at any rank of their ids' hashes, beyond 40,000 too."""
    score = lambda model, *texts: resampling.log_weights(pa.array(texts), model.weights).tolist()
    rows = [(i, ("marvel", "rubbish")[i % 2] + str(i)) for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good, bad = score(resampling.fit(docs, docs.select("doc_id", ((F.col("doc_id") + 1) % 2).alias("quality"), F.lit(0).alias("toxic"))), "marvel0000", "rubbish0000")
    assert good > 0.3 and bad < -1

    last = spark.range(43_000).withColumn("last", F.row_number().over(Window.orderBy(F.xxhash64("id"))) > 41_000)
    docs = last.select(F.col("id").alias("doc_id"), F.when(F.col("last"), F.concat(F.lit("zebra q"), "id")).otherwise(F.concat(F.lit("heron q"), "id")).alias("text"), "last")
    labels = docs.select("doc_id", (F.col("last") | (F.col("doc_id") % 2 == 0)).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert score(resampling.fit(docs.drop("last"), labels), "zebra")[0] > 0.3


def test_urls(spark):
    urls = [None, "no scheme", "http://A.net/x", "https://m.example.net/en/1?q=2#f", "http://www.example.com/de/9", "http://b.org/fr/", "http://b.org/en/1", "http://xnet/1"]
    got = {r.id: r for r in url_trees.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(8)] == [None, None, "net/", "example.net/en/", "example.com/de/", "org/fr/", None, None]
    assert [got[i].verdict for i in range(2, 6)] == ["block", "allow", "block", "allow"] and (got[3].host, got[3].path) == ("m.example.net", "/en/1")


def test_url_trees(spark):
    """The trees against a plain reading of them, and on URLs that no rule decides."""
    r = np.random.default_rng(8)
    x = np.c_[r.normal(size=(3_000, 3)), r.integers(0, 4, 3_000)].astype(float)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] >= 2)).astype(float)
    trees = url_trees.fit_trees(x[:2_000], y[:2_000])
    margin = trees.margin(x[2_000:])

    def walk(row):
        total = trees.base
        for feature, threshold, leaves in zip(trees.features, trees.thresholds, trees.leaves):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaves[node - len(feature)]
        return total

    assert np.allclose(margin[:200], [walk(row) for row in x[2_000:2_200]])
    assert ((margin > 0) == (y[2_000:] > 0.5)).mean() > 0.95
    urls = [f"https://a{i}.net/{i}" for i in range(300)] + [f"https://www.example.net/en/{i}" for i in range(300)] + [None, "", "://", "x" * 50_000, "http://é.org/" + "é" * 2_000]
    rows = [(i, u, "clash", 0.5) for i, u in enumerate(urls)] + [(0, urls[0], "clash", 0.5)]
    got = url_trees.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, block_score double")).collect()
    assert len(got) == len(rows) and all(g.verdict in ("allow", "block") and 0 <= g.block_score <= 1 for g in got)
    assert url_trees.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = resampling.fit(docs, labels.where("doc_id % 2 = 0"))
    kept = resampling.resample(docs, model, carry=["doc_id"]).select("doc_id", "selected").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = (kept.quality == 1) & (kept.toxic == 0)
    assert kept[good].selected.mean() > 0.95 and kept[kept.toxic == 1].selected.mean() < 0.25 and kept[kept.quality == 0].selected.mean() < 0.1
