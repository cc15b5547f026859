"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained in NumPy from a small labelled URL table (a parameter; ``LABELLED`` by default, a few dozen rows)
and has a fixed size. Rules are a list in code or config: a rule fits its host and all subdomains when the path starts
with the rule's path; the longest rule wins.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to
``?``, ``#`` or the end. Null, or without ``://``: both empty; then no rule fits and nothing speaks for blocking: such
rows are allowed. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import lower_ascii

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_BAD = ("casino-win", "online-casino", "lucky-casino", "poker-win", "win-slots", "free-bets", "sport-bets", "bets-bonus",
        "cheap-pills", "diet-pills", "pills-shop", "viagra-pills", "adult-x", "x-adult", "adult-cams", "xxx-video",
        "spam-farm", "link-farm", "spam-links", "content-farm", "ads-track", "track-ads", "popup-ads", "ads-click")
_GOOD = ("river-news", "garden", "weather", "city-library", "museum", "the-herald", "open-school", "recipes", "history",
         "physics", "letters", "theatre", "nation", "thereon", "ration", "station", "motion", "other", "theory", "ashore",
         "mathematics", "bridges", "travel", "health-service", "that-one", "within", "everything", "thrush", "another", "northern",
         "earth", "heather", "feather", "breath", "the-smith", "thatched")
_PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/en/{}.html", "/de/{}/")
_FRONT = ("", "www.", "blog.", "m.")
_BACK = ("example.com", "example.net", "example.org", "test")
#: The labelled table: (url, label), label 1 to block. Hosts of both classes come with the same prefixes, ends and paths.
LABELLED = tuple(
    (f"https://{_FRONT[(i + j) % 4]}{host}.{_BACK[(i + 2 * j) % 4]}{_PATHS[(i + j) % 6].format(101 + 137 * i)}", label)
    for label, hosts in ((1, _BAD), (0, _GOOD)) for i, host in enumerate(hosts) for j in range(2))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def probability(self, host: str, path: str) -> float:
        ids = features(host, path, len(self.weights))
        if not ids:
            return 0.0  # nothing to block
        z = self.bias + self.weights[ids].sum() / math.sqrt(len(ids))
        return 1 / (1 + math.exp(-z))


def features(host: str, path: str, buckets: int) -> list[int]:
    """Buckets of the distinct 3- to 5-grams of host and path, each marked with the part it is from."""
    grams = set()
    for mark, part in (("h", f"^{host}$" if host else ""), ("p", f"^{path}$" if path else "")):
        grams |= {mark + part[i:i + n] for n in (3, 4, 5) for i in range(len(part) - n + 1)}
    return sorted({xxhash.xxh32_intdigest(g) % buckets for g in grams})


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as the column expressions below."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    stop = next((i for i, c in enumerate(rest) if i >= end and c in "?#"), len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]


def train(labelled: Sequence[tuple[str, int]] = LABELLED, buckets: int = 1 << 15, steps: int = 600, rate: float = 4.0, decay: float = 1e-4) -> UrlModel:
    """Batch gradient descent with decay from (url, 0/1) rows; rows without url or label are left out."""
    rows = [(features(*split_url(u), buckets), y) for u, y in labelled if u is not None and y is not None]
    weights, bias = np.zeros(buckets), 0.0
    rows = [(ids, y) for ids, y in rows if ids]
    if not rows:
        return UrlModel(weights, bias - 0.01)
    flat = np.concatenate([np.array(ids) for ids, _ in rows])
    length = np.array([len(ids) for ids, _ in rows])
    row_of = np.repeat(np.arange(len(rows)), length)
    scale = 1 / np.sqrt(length)
    y = np.array([label for _, label in rows], float)
    for _ in range(steps):
        z = np.bincount(row_of, weights[flat], len(rows)) * scale + bias
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        weights -= rate * (np.bincount(flat, (g * scale)[row_of], buckets) + decay * weights)
        bias -= rate * g.sum()
    return UrlModel(weights, bias)


def host_of(url: str = "url") -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits, the longest, stands
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) for every row of ``pages`` (page_id, url)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.probability(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "block_probability"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"page_id {kind}, host string, path string, block_probability double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "block_probability")
