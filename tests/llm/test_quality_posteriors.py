"""The query of the quality classifier against plain arithmetic: evidence, site posteriors, verdicts; sites that turn verdicts."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from uttera.llm import quality_classifier as qc
from uttera.llm import queries
from uttera.session import ship

SF = "/root/testdata/sf0.01"


def logit(p):
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def shrink(sites, priors):
    """Method of moments over sites {key: list of p}; priors {key: prior}."""
    n, k = sum(map(len, sites.values())), len(sites)
    mean = {s: sum(x) / len(x) for s, x in sites.items()}
    inside = sum((p - mean[s]) ** 2 for s, x in sites.items() for p in x) / max(1, n - k)
    between = max(1e-9, (sum(len(x) * (mean[s] - priors[s]) ** 2 for s, x in sites.items()) - k * inside) / max(1, n))
    kappa = min(10_000, max(1, inside / between))
    return {s: (sum(x) + kappa * priors[s]) / (len(x) + kappa) for s, x in sites.items()}


def by_force(rows, weight=0.25, threshold=0.4):
    """rows (key, host, path, p) to {key: (host posterior, path posterior, posterior, kept)}."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    top = sum(r[3] for r in rows) / len(rows)
    h = shrink(hosts, dict.fromkeys(hosts, top))
    w = shrink(paths, {s: h[s[0]] for s in paths})
    out = {}
    for key, host, path, p in rows:
        z = 1 / (1 + math.exp(-(logit(p) + weight * (logit(w[host, path]) - logit(top)))))
        out[key] = (h[host], w[host, path], z, z >= threshold)
    return out


def equal(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.host_posterior, r.path_posterior, r.posterior) == pytest.approx(w[:3], abs=1e-6)
        assert r.kept == w[3] or abs(w[2] - 0.4) < 1e-6


def test_query_by_force(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.queries()["op7_quality_classifier"](spark, SF).collect()
    model = qc.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        z = model.bias + sum(model.weights[k] for k in qc.slots(texts[r.doc_id]))
        assert r.p == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, z)))), abs=1e-5)
    equal(got, by_force([(r.doc_id, r.host, r.path, r.p) for r in got]))


@pytest.mark.parametrize("most", [20_000, 1])
def test_sites_turn_verdicts(spark, monkeypatch, most):
    """Sites that differ move borderline documents over the threshold in both directions; broadcast and salted join agree."""
    monkeypatch.setattr(qc, "BROADCAST_SITES", most)
    rows = [(i, "bad", "a", 0.05 + 0.1 * (i % 3) / 2) for i in range(300)] + [(1000 + i, "good", "b", 0.85 + 0.1 * (i % 3) / 2) for i in range(300)]
    rows += [(5000, "bad", "a", 0.45), (5001, "good", "b", 0.35), (5002, "new", "c", 0.45), (5003, "new", None, 0.35), (5004, None, None, 0.45)]
    ev = spark.createDataFrame(rows, "doc_id long, host string, path string, p double").withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    sites, top = qc.site_posteriors(ev)
    got = qc.judged(ev, sites, top).collect()
    want = by_force(rows)
    equal(got, want)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[5000] and kept[5001] and kept[5002] and not kept[5003] and kept[5004]
