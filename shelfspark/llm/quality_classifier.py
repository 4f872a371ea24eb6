"""Quality by hierarchical empirical Bayes: a document classifier's evidence over host and path posteriors.

A logistic classifier over a few shape measurements of the whole text (fitted on a bounded sample of labelled rows) gives
each document a probability. Per host and per path within a host, the sums of these probabilities are pooled: a host's
rate is shrunk towards the global rate, a path's rate towards its host's posterior, with prior strengths estimated from
how much rates differ between sites beyond what their sizes explain (method of moments). The posterior of its path then
takes the place of the global rate as the document's prior. A site with few documents keeps close to the global prior.

Null texts are empty; null hosts or paths are a site of their own; repeated rows count as rows; extra columns are
dropped; without labelled rows of both kinds the classifier keeps its prior weights; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, join_small, least_by_hash, stage, table, text_or_empty, words

#: Bound of the labelled sample: rows of each label.
MOST_ROWS = 10_000
THRESHOLD = 0.5
FEATURES = ("bias", "symbols", "capitals", "digits", "repeats", "length", "shouts")
#: Weights before any label is seen, and how strongly they hold.
PRIOR = np.array([2.0, -8.0, -4.0, -4.0, -4.0, 0.0, -4.0])
RIDGE = 0.5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÁÍÓÚÑ"


def measurements(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the features of the whole text; shares are per word or per character. DataFrame functions only."""
    base = docs.select(*keep, text_or_empty().alias("__t")).withColumn("__w", words(F.col("__t")))
    n = F.greatest(F.size("__w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length(F.translate("__t", SPACES, "")), F.lit(1)).cast("double")
    share = lambda signs, of: (F.length("__t") - F.length(F.translate("__t", signs, ""))) / of
    return base.select(
        *keep,
        F.lit(1.0).alias("bias"),
        F.least(share("#*$%&|<>", n), F.lit(2.0)).alias("symbols"),
        share(CAPITALS, chars).alias("capitals"),
        share("0123456789", chars).alias("digits"),
        F.greatest(1 - F.size(F.array_distinct("__w")) / F.greatest(F.lit(10.0), F.least(n, F.sqrt(n) * 9)), F.lit(0.0)).alias("repeats"),
        (F.log1p(F.size("__w").cast("double")) / 10).alias("length"),
        F.least(share("!", n), F.lit(2.0)).alias("shouts"),
    )


def fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = RIDGE) -> np.ndarray:
    """Logistic weights by Newton's steps, drawn to the prior by a ridge."""
    beta = prior.astype(float).copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (p - y) + ridge * (beta - prior))
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from at most MOST_ROWS labelled rows of each label, least hashes of doc_id, and of the row's measurements,
    first. Rows of one doc_id and equal measurements count once."""
    mark = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    some = [least_by_hash(mark.where(F.col("quality") == y), "doc_id", MOST_ROWS) for y in (0, 1)]
    found = measurements(docs.select("doc_id", "text").join(F.broadcast(some[0].unionAll(some[1])), "doc_id"), ["doc_id", "quality"])
    rows = stage(found.withColumn("row", F.xxhash64("doc_id", *FEATURES)).dropDuplicates(["row"]).drop("doc_id"), "quality-sample")
    kept = [r for y in (0, 1) for r in least_by_hash(rows.where(F.col("quality") == y), "row", MOST_ROWS).collect()]
    data = np.array([[r[f] for f in FEATURES] + [r["quality"]] for r in kept], float).reshape(-1, len(FEATURES) + 1)
    return fit_weights(data[:, :-1], data[:, -1])


def _strength(rates: DataFrame, centre: Column) -> Column:
    """Prior strength (pseudo-documents) of Beta rates of sites (n, s) around centre, by moments: small if sites differ."""
    p = F.col("s") / F.col("n")
    spread = F.sum(F.col("n") * (p - centre) ** 2) / F.sum("n")
    noise = F.sum(centre * (1 - centre)) / F.sum("n")
    between = F.greatest(spread - noise, F.lit(1e-4))
    whole = F.sum(F.col("n") * centre * (1 - centre)) / F.sum("n")
    return F.greatest(F.least(whole / between - 1, F.lit(10_000.0)), F.lit(1.0))


def site_posteriors(rows: DataFrame, host: str = "host", path: str = "path", p: str = "p") -> tuple[float, DataFrame]:
    """rows (host, path, p) -> the global rate, and (host, path, n, host_rate, rate): shrunk rates of each path."""
    paths = stage(rows.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    centre = min(max(total["s"] / total["n"], 1e-3), 1 - 1e-3) if total["n"] else 0.5
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    of_hosts = hosts.agg(_strength(hosts, F.lit(centre)).alias("k")).first()["k"] or 1.0
    host_rate = ((F.col("s") + of_hosts * centre) / (F.col("n") + of_hosts)).alias("host_rate")
    host_rates = hosts.select(F.col(host).alias("__h"), host_rate)
    joined = paths.join(host_rates, paths[host].eqNullSafe(F.col("__h"))).drop("__h")
    of_paths = joined.agg(_strength(joined, F.col("host_rate")).alias("k")).first()["k"] or 1.0
    return centre, joined.withColumn("rate", (F.col("s") + of_paths * F.col("host_rate")) / (F.col("n") + of_paths)).drop("s")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence, site_rate, score, keep): score is the posterior probability of good quality."""
    weights = fit(docs, labels)
    site = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    spec = docs.select("doc_id", site(host).alias("host"), site(path).alias("path"), "text")
    raw = sum((F.col(f) * F.lit(float(w)) for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0))
    near = F.greatest(F.least(raw, F.lit(12.0)), F.lit(-12.0))
    rows = stage(measurements(spec, ["doc_id", "host", "path"]).select("doc_id", "host", "path", near.alias("raw")).withColumn("evidence", 1 / (1 + F.exp(-F.col("raw")))), "evidence")
    centre, sites = site_posteriors(rows, p="evidence")
    rate = F.greatest(F.least(F.col("rate"), F.lit(1 - 1e-3)), F.lit(1e-3))
    posterior = F.col("raw") - F.lit(float(np.log(centre / (1 - centre)))) + F.log(rate / (1 - rate))
    out = join_small(rows, stage(sites.select("host", "path", "rate"), "sites"), ["host", "path"], "inner").withColumn("score", 1 / (1 + F.exp(-posterior)))
    return out.select("doc_id", "host", "path", "evidence", F.col("rate").alias("site_rate"), "score", (F.col("score") >= THRESHOLD).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """docs, all columns and rows as they are, without those whose posterior falls below the threshold. Texts stay where
    they are while the table of sites is within the broadcast bound."""
    weights = fit(docs, labels)
    raw = lambda: F.greatest(F.least(sum((F.col(f) * F.lit(float(w)) for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0)), F.lit(12.0)), F.lit(-12.0))
    site = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), site(host).alias("host"), site(path).alias("path"), text_or_empty().alias("text"))
    rows = stage(measurements(named, ["__row", "host", "path"]).select("__row", "host", "path", raw().alias("raw")), "evidence")
    centre, sites = site_posteriors(rows.withColumn("evidence", 1 / (1 + F.exp(-F.col("raw")))), p="evidence")
    rate = F.greatest(F.least(F.col("rate"), F.lit(1 - 1e-3)), F.lit(1e-3))
    posterior = F.col("raw") - F.lit(float(np.log(centre / (1 - centre)))) + F.log(rate / (1 - rate))
    kept = join_small(rows, stage(sites.select("host", "path", "rate"), "sites"), ["host", "path"], "inner").where(posterior >= float(np.log(THRESHOLD / (1 - THRESHOLD))))
    return kept.select("__row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths their languages: the levels that `documents` has."""
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES: dict[str, str] = {}
