"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule holds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): host before the first slash, path from it on.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2 = 60, 4, 0.2, 32, 1.0

LEXICAL = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "has_fragment", "longest_segment", "first_segment"]
SUFFIX = ["suffix_share", "suffix_block_rate", "segment_share", "segment_block_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" to "/", "?", "#" or the end, A-Z lowered. Path: from there to "?", "#" or the end. Null or no "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the host or a parent domain of it and with whose path the path begins; else null. Of equal length, the first."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        domain, slash, prefix = rule.partition("/")
        out = F.when(((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix), F.lit(rule)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def first_segment(path: Column) -> Column:
    return F.substring_index(F.substring(path, 2, 1 << 30), "/", 1)


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The features named in LEXICAL."""
    url = url or ""
    raw, host_raw = np.frombuffer(url.encode(), np.uint8), np.frombuffer(host.encode(), np.uint8)
    query = url.partition("?")[2].partition("#")[0]
    segments = [s for s in path.split("/") if s]
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits / max(1, len(raw)), float(((host_raw >= 48) & (host_raw <= 57)).sum()),
        host.count("-"), _entropy(np.bincount(raw, minlength=1)), _entropy(np.bincount(host_raw, minlength=1)), len([p for p in query.split("&") if p]), float("#" in url),
        max(map(len, segments), default=0), len(segments[0]) if segments else 0,
    ]


@dataclass
class Trees:
    """Boosted regression trees of a fixed depth on the logistic loss: split features, thresholds and leaf values, heap order."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(feature))]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram boosting with second-order gains; deterministic."""
    inner = (1 << DEPTH) - 1
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    margin = np.full(len(x), base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            gains_at = [(0, np.inf)] * width
            local = node - first
            for j, e in enumerate(edges):
                cell = local * (BINS + 1) + binned[:, j]
                gs = np.bincount(cell, g, width * (BINS + 1)).reshape(width, -1)
                hs = np.bincount(cell, h, width * (BINS + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, : len(e)], hs.cumsum(1)[:, : len(e)]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                for k in range(width):
                    b = int(gain[k].argmax())
                    if gain[k, b] > best[k] + 1e-9:
                        best[k], gains_at[k] = gain[k, b], (j, e[b])
            for k, (j, t) in enumerate(gains_at):
                feature[first + k], threshold[first + k] = j, t
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        place = node - inner
        leaf = -RATE * np.bincount(place, g, 1 << DEPTH) / (np.bincount(place, h, 1 << DEPTH) + L2)
        margin += leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def _matrix(b: pa.RecordBatch, first: int) -> np.ndarray:
    urls, hosts, paths = (b.column(first + k).to_pylist() for k in range(3))
    words = np.array([lexical(u, h, p) for u, h, p in zip(urls, hosts, paths)]).reshape(b.num_rows, len(LEXICAL))
    stats = np.stack([b.column(first + 3 + k).to_numpy(zero_copy_only=False) for k in range(len(SUFFIX))], axis=1)
    return np.concatenate([words, stats], axis=1)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, block_score): every row's verdict, by the longest rule that fits, else by the trees.

    The labelled URLs are those that a rule decides. Host suffixes (last two labels) and first path segments get, over all
    rows, their logarithmic count and a smoothed rate of blocks among the labelled; the trees are fitted on at
    most ``train_rows`` labelled rows, those of smallest URL hash. block_score is the trees' probability of a
    block, given for all rows; the trees block from 0.5 on. Null URLs and those without "://" have an empty host and
    path, fit no rule, and are judged by their features. Without labelled rows every score is 0.5 and every
    verdict allow. Repeated rows are judged alike; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    blocks = [r for r, v in rules if v == "block"]
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({"label": F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocks).cast("int")), "suffix": suffix_of(F.col("host")), "segment": first_segment(F.col("path"))})

    def stats(key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.log1p(F.count("*")).alias(f"{key}_share"), ((F.coalesce(F.sum("label"), F.lit(0)) + 1) / (F.count("label") + 2)).alias(f"{key}_block_rate"))

    rows = rows.join(stats("suffix"), "suffix").join(stats("segment"), "segment").select("id", "url", "host", "path", *SUFFIX, "rule", "label")
    sample = rows.where("label is not null").orderBy(F.xxhash64("url"), "url", "id").limit(train_rows).select("url", "host", "path", *SUFFIX, "label").toArrow().combine_chunks()
    batch = sample.to_batches()[0] if sample.num_rows else None
    x = _matrix(batch, 0) if batch else np.zeros((0, len(LEXICAL) + len(SUFFIX)))
    y = sample["label"].to_numpy().astype(float) if batch else np.zeros(0)
    trees = fit_trees(x, y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = 1 / (1 + np.exp(-trees.margin(_matrix(b, 1)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(8), pa.array(p)], ["id", "host", "path", "rule", "block_score"])

    judged = rows.drop("label").mapInArrow(score, f"id {kind}, host string, path string, rule string, block_score double")
    by_rule = F.when(F.col("rule").isin(blocks), "block").when(F.col("rule").isNotNull(), "allow")
    by_trees = F.when(F.col("block_score") > 0.5 if not len(y) else F.col("block_score") >= 0.5, "block").otherwise("allow")
    return judged.select("id", "host", "path", "rule", F.coalesce(by_rule, by_trees).alias("verdict"), "block_score")
