"""Quality classifier (operator 1): hierarchical empirical Bayes.

A logistic model over counted features of a text gives each document's own evidence. Grouped sums of that
evidence give every site (host) and path a posterior that is shrunk towards its parent (path to host, host
to the corpus) by a strength that the spread between groups decides, so sparse sites stay near the global
prior. A document's verdict combines its evidence with its path's posterior, from which its own share is
taken out first.

The logistic model is fitted on at most ``max_train_rows`` labelled rows (the bound is a parameter); all
sums and verdicts cover every row. Sites are grouped with partial sums, so a host with a third of all
rows costs one row per task.

Defined results: a null text is an empty one and is judged by its features like any other; a null host or
path is a group of its own (''). Each row in gives one row out, whatever its id; repeated rows all count for their
site. A very long text is read whole, for counts only. Labels that are null or belong to no row are not used; of rows
that repeat a labelled id one is learned from. With labels of one kind or none every document has its prior. A score
equal to the threshold is kept. An empty table gives no rows. Columns other than those named are not read, so their
names may clash; ``keep_quality`` passes them through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, text_or_empty, written

N_FEATURES = 24


def features(data: bytes) -> list[float]:
    """Counted features of a text, each about 0 to 1 or a logarithm."""
    n = max(1, len(data))
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = max(1, len(words))
    lines = data.split(b"\n")
    upper, lower, digits = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    letters = max(1, upper + lower + int(h[0xC2:].sum()))
    count = lambda chars: int(sum(h[c] for c in chars))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    p = h[h > 0] / n
    return [
        upper / letters, digits / n, count(b"#*$%&<>~^=@") / n * 10, count(b"|") / w, count(b"!") / w, count(b"?") / w, count(b".,;:") / w, count(b"()[]{}\"'") / w,
        count(b"#*$%&<>~^=@") / w, count(b"_-/\\+") / w, letters / n, (h[32] + h[10] + h[9]) / n, distinct / w, pairs / w, 1 - len({x for x in lines if x}) / max(1, sum(1 for x in lines if x)),
        math.log1p(len(words)) / 10, math.log1p(len(data) / w) / 3, math.log1p(len(lines)) / 5, math.log1p(n / len(lines)) / 8, float(-(p * np.log(p)).sum() / 5) if len(p) else 0.0,
        float(upper > 0.5 * letters), float(len(words) < 5), float(not words), int(h[0xC2:].sum()) / letters,
    ]


def _feature_batches(batches):
    for batch in batches:
        rows = [features(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        flat = pa.array(np.array(rows, np.float64).reshape(-1), pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.FixedSizeListArray.from_arrays(flat, N_FEATURES).cast(pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], l2), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def labelled_sample(docs: DataFrame, labels: DataFrame, max_train_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Features and label of at most ``max_train_rows`` labelled documents, chosen by a hash of the id."""
    some = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_ax_id"), F.col(label_col).cast("double").alias("y"))
    some = some.orderBy(F.xxhash64("_ax_id"), "_ax_id", "y").limit(max_train_rows)
    # at most max_train_rows rows of two numbers
    picked = docs.select(F.col(id_col).alias("_ax_id"), text_or_empty(text_col).cast("binary").alias("text")).join(F.broadcast(some), "_ax_id")
    seen = picked.select("_ax_id", "y", "text").mapInArrow(_feature_batches, f"_ax_id {docs.schema[id_col].dataType.simpleString()}, y double, x array<double>")
    # ids that repeat: the least features of each, so the rows stay bounded and any run picks the same
    return seen.groupBy("_ax_id", "y").agg(F.min("x").alias("x")).orderBy("_ax_id", "y").select("y", "x")


def evidence(docs: DataFrame, model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _ax_text, host, path, p): each row's own probability of being good."""
    mean, scale, w = model

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(4).to_pylist()]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p)], names=[id_col, "_ax_text", "_ax_host", "_ax_path", "p"])

    kind = docs.schema[id_col].dataType.simpleString()
    sel = docs.select(id_col, text_key(text_col).alias("_ax_text"), F.coalesce(host.cast("string"), F.lit("")).alias("_ax_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_ax_path"), text_or_empty(text_col).cast("binary").alias("text"))
    return sel.mapInArrow(run, f"`{id_col}` {kind}, _ax_text long, _ax_host string, _ax_path string, p double")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Beta prior strength (pseudo rows) from the spread of group means about ``mean``: moments, weighted by rows. One number."""
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)) / F.sum("n")
    noise = F.sum(F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / F.col("n")) / F.sum("n")
    r = groups.agg(spread.alias("spread"), noise.alias("noise"), F.avg(mean).alias("mean")).first()
    if r.spread is None:
        return 1.0
    return min(max(r.mean * (1 - r.mean) / max(r.spread - r.noise, 1e-6) - 1, 1.0), 1e4)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(_ax_host, _ax_path, n, s, strength, parent, mu): path sums, the host posterior each path shrinks to, and the global prior."""
    sums = [F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")]
    paths = scored.groupBy("_ax_host", "_ax_path").agg(*sums)
    hosts = paths.groupBy("_ax_host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    mu = scored.agg(F.avg("p").alias("mu")).first().mu or 0.0
    k = _strength(hosts, F.lit(mu))
    hosts = hosts.select("_ax_host", ((F.col("s") + k * mu) / (F.col("n") + k)).alias("parent"))
    joined = paths.join(hosts, "_ax_host")
    return joined.select("_ax_host", "_ax_path", "n", "s", "parent", F.lit(_strength(joined, F.col("parent"))).alias("strength"), F.lit(mu).alias("mu"))


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_train_rows: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", small_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: id, _ax_text, ``p_document``, ``p_path``, ``score`` and ``kept`` (score >= threshold)."""
    sample = labelled_sample(docs, labels, max_train_rows, id_col, text_col, label_col).collect()
    y = np.array([r.y for r in sample])
    if len(y) and 0 < y.sum() < len(y):
        model = fit_logistic(np.array([r.x for r in sample]), y)
    else:
        model = (np.zeros(N_FEATURES), np.ones(N_FEATURES), np.r_[np.zeros(N_FEATURES), 3.0 if not len(y) or y.sum() else -3.0])
    scored = written(evidence(docs, model, host, path, id_col, text_col))
    sites = written(site_posteriors(scored))
    if sites.count() <= small_rows:  # rows of some hundred bytes; beyond, both sides are shuffled
        sites = F.broadcast(sites)
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(c / (1 - c))
    j = scored.join(sites, ["_ax_host", "_ax_path"])
    # the site's opinion without this row's own share
    others = (F.col("s") - F.col("p") + F.col("strength") * F.col("parent")) / (F.col("n") - 1 + F.col("strength"))
    site = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    mu = F.least(F.greatest("mu", F.lit(1e-4)), F.lit(1 - 1e-4))
    score = 1 / (1 + F.exp(-(logit(p) + logit(site) - logit(mu))))
    return j.select(id_col, "_ax_text", F.col("p").alias("p_document"), site.alias("p_path"), score.alias("score"), (score >= threshold).alias("kept"))


def quality_result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_document, p_path, score, kept. A document's host is its source, its path the source's language section."""
    s = score_quality(docs, labels, F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    return s.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p_document", "p_path", "score")), "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = score_quality(docs, labels, host, path, **options).filter(~F.col("kept")).select(F.col(id_col).alias("_ax_id"), F.col("_ax_text").alias("_ax_bad")).distinct()
    d = docs.withColumn("_ax_text", text_key(text_col))
    return d.join(bad, d[id_col].eqNullSafe(bad["_ax_id"]) & (d["_ax_text"] == bad["_ax_bad"]), "left_anti").drop("_ax_text")
