"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

1. Evidence. A logistic regression over hashed word presence and a few character shares is trained on the
   driver from at most `sample` labelled documents (features only, chosen by a hash of the id). A document
   is good where quality = 1 and it isn't toxic.
2. Sites. Every document's evidence is summed by host and by path (grouped aggregation, partial sums before
   the shuffle). Host means shrink to the global mean, path means to their host's, with weights estimated
   from the spread between sites (method of moments): sparse sites move to the prior, large ones keep theirs.
3. Verdict. The document's log odds move by the log odds of its path against the global mean, times
   `site_weight`; documents under `threshold` are rejected.

Defined cases: a null text counts as empty; a null host or path is a site of its own. Repeated rows and ids
each count and each get a result. An empty table gives an empty result. Without labels of both classes
the evidence is 0.5 for all and nothing is rejected. Extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import free_name, salted_lookup, small_batches, tidy, written

#: Hashed word features; the last positions hold the character shares.
WIDTH = 1 << 17
SAMPLE = 6_000
#: Sites up to which their table is broadcast (about 100 bytes each); above, the join is shuffled and salted.
BROADCAST_SITES = 20_000
_WORD = re.compile(r"\w+")
_SHARES = (
    (re.compile(r"[#*$%&|<>]+"), (0.005, 0.02, 0.05, 0.1)),
    (re.compile(r"[A-Z]+"), (0.1, 0.3, 0.6)),
    (re.compile(r"!+"), (0.005, 0.02, 0.05)),
    (re.compile(r"[0-9]+"), (0.05, 0.2)),
)
_STEPS = sum(len(s) for _, s in _SHARES)


def slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % (WIDTH - _STEPS - 8)


def steps(text: str) -> list[int]:
    """Slots of the character shares and of the length that a text reaches."""
    out, at, size = [], WIDTH - _STEPS - 8, max(1, len(text))
    for pattern, cuts in _SHARES:
        share = sum(map(len, pattern.findall(text))) / size
        out += [at + k for k, cut in enumerate(cuts) if share >= cut]
        at += len(cuts)
    out += [at + k for k, cut in enumerate((200, 400, 800, 3200)) if size >= cut]
    return out


def slots(text: str | None) -> list[int]:
    """The distinct features of a text."""
    text = text or ""
    return sorted({slot(w) for w in set(_WORD.findall(text.lower()))} | set(steps(text)))


@dataclass(frozen=True)
class Evidence:
    """Weights of a logistic regression over slots()."""

    weights: np.ndarray
    bias: float
    accuracy: float | None = None

    def column(self, text: Column) -> Column:
        weights, bias = self.weights.astype(np.float32), self.bias

        def scored(batches):
            known: dict[str, int] = {}
            for batch in batches:
                out = []
                for text in batch:
                    text = text or ""
                    if len(known) > 150_000:
                        known.clear()
                    got: set[int] = set()
                    for w in set(_WORD.findall(text.lower())):
                        x = known.get(w)
                        if x is None:
                            k = slot(w)
                            x = known[w] = k if weights[k] else -1
                        if x >= 0:
                            got.add(x)
                    z = bias + float(weights[list(got)].sum()) + float(sum(weights[k] for k in steps(text)))
                    out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
                yield pd.Series(out, dtype="float64")

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from tidy("quality_classifier", scored)(batches)

        return score(text)


def train(rows: list[list[int]], good: np.ndarray, rounds: int = 250, l2: float = 5.0) -> Evidence:
    """Logistic regression by Adam on sparse presence features, the classes weighted alike."""
    if not len(good) or good.all() or not good.any():
        return Evidence(np.zeros(WIDTH), 0.0)
    ids = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(ids, minlength=WIDTH) >= 3  # features of one or two documents only fit noise
    ids, of = ids[seen[ids]], of[seen[ids]]
    y = good.astype(float)
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    w, b, m, v, mb, vb = np.zeros(WIDTH), 0.0, np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(of, weights=w[ids], minlength=len(y))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(ids, weights=err[of], minlength=WIDTH) + l2 * w / len(y)
        gb = err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * (1 - 0.99 * t / rounds)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    w[np.abs(w) < 1e-3] = 0
    return Evidence(w, float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Train on four fifths of the sample; the accuracy on the rest is kept with the model."""
    small_batches(docs.sparkSession)
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("q"), (F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("t"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .select("doc_id", (F.col("q") & ~F.col("t")).alias("good"))
    )

    @F.pandas_udf("array<int>")
    def featured(texts: pd.Series) -> pd.Series:
        return pd.Series([slots(t) for t in texts])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `known` has at most `sample` rows
    rows = rows.select("doc_id", "good", "text", F.xxhash64("doc_id", "text").alias("_o"))
    # repeated ids could exceed the bound: the smallest hashes of (id, text) decide which stay. They are counted first, so
    # that copies are featured once and no task sends the driver more than the lists that it keeps
    firsts = rows.groupBy("_o").agg(F.count("*").alias("n")).orderBy("_o").limit(2 * sample).collect()
    times, left = {}, 2 * sample
    for r in firsts:
        if left > 0:
            times[r["_o"]] = min(left, r["n"])
            left -= r["n"]
    chosen = rows.where(F.col("_o") <= max(times, default=0)).dropDuplicates(["_o"]).select("doc_id", "good", featured("text").alias("f"), "_o").collect()
    found = [r for r in chosen for _ in range(times[r["_o"]])]
    found.sort(key=lambda r: (r["doc_id"], r["f"]))
    x, good = [r["f"] for r in found], np.array([r["good"] for r in found], bool)
    if not found:
        return train(x, good)
    out = np.arange(len(x)) % 5 == 4
    model = train([r for r, o in zip(x, out, strict=True) if not o], good[~out])
    z = np.array([model.bias + model.weights[r].sum() for r, o in zip(x, out, strict=True) if o])
    return Evidence(model.weights, model.bias, float(((z > 0) == good[out]).mean()) if out.any() else None)


def shrunk(sites: DataFrame, prior: Column, by: str) -> tuple[DataFrame, float]:
    """sites (n, s: sum of evidence, s2: sum of squares) with `by`: means shrunk to the column `prior`.

    The weight of the prior, in documents, is variance within sites over variance between them, both from
    one grouped aggregation (method of moments); it lies between 1 and 10,000.
    """
    mean = F.col("s") / F.col("n")
    within = F.sum(F.col("s2") - F.col("n") * mean * mean)
    row = sites.agg(within.alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (mean - prior) * (mean - prior)).alias("b")).first()
    n, k = row["n"] or 0, row["k"]
    inside = (row["w"] or 0.0) / max(1, n - k)
    between = max(1e-9, ((row["b"] or 0.0) - k * inside) / max(1, n))
    kappa = float(min(10_000.0, max(1.0, inside / between)))
    return sites.withColumn(by, (F.col("s") + kappa * prior) / (F.col("n") + kappa)), kappa


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """Of evidence (host, path, p): host, path, host_posterior, path_posterior, n_docs; and the global mean."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")]
    paths = written(evidence.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])
    row = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    top = (row["s"] / row["n"]) if row["n"] else 0.5
    hosts, _ = shrunk(hosts, F.lit(top), "host_posterior")
    # a host has one row here, so the join is by a key that no group of documents makes hot
    paths = paths.join(hosts.select(F.col("host").alias("h"), "host_posterior"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    paths, _ = shrunk(written(paths, "paths"), F.col("host_posterior"), "path_posterior")
    return paths.select("host", "path", "host_posterior", "path_posterior", F.col("n").alias("n_docs")), top


def _log_odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def judged(evidence: DataFrame, sites: DataFrame, top: float, site_weight: float = 0.25, threshold: float = 0.4) -> DataFrame:
    """evidence with host_posterior, path_posterior, posterior and kept.

    The table of sites is broadcast while it has at most BROADCAST_SITES rows; beyond, the join is
    shuffled with every site on 32 partitions.
    """
    sites = written(sites.select(F.to_json(F.struct("host", "path")).alias("_site"), "host_posterior", "path_posterior"), "sites")
    rows = evidence.withColumn("_site", F.to_json(F.struct("host", "path")))
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        rows = rows.join(F.broadcast(sites), "_site", "left")
    else:
        # a salt that a retried task finds again: the row's own hash, of JSON where a type has none
        values = [F.to_json(F.struct(f"`{c}`")) if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in evidence.dtypes]
        rows = salted_lookup(rows, sites, ["_site"], F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]))
    moved = _log_odds(F.col("p")) + site_weight * (_log_odds(F.col("path_posterior")) - _log_odds(F.lit(top)))
    rows = rows.drop("_site").withColumn("posterior", 1 / (1 + F.exp(-moved)))
    return rows.withColumn("kept", F.col("posterior") >= threshold)


def classify(docs: DataFrame, model: Evidence, host: Column, path: Column, name: str = "quality") -> DataFrame:
    """docs with a struct column: p, host_posterior, path_posterior, posterior, kept.

    Texts are scored twice, once for the sites' sums and once for the verdict: texts are then neither
    shuffled nor written.
    """
    name = free_name(docs, name)
    light = docs.select(host.alias("host"), path.alias("path"), model.column(F.col("text")).alias("p"))
    sites, top = site_posteriors(light)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    full = docs.select(F.struct(*keep).alias("_row"), host.alias("host"), path.alias("path"), model.column(F.col("text")).alias("p"))
    full = judged(full, sites, top)
    verdict = F.struct("p", "host_posterior", "path_posterior", "posterior", "kept").alias(name)
    return full.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], verdict)
