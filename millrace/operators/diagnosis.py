"""Fault signatures, matching and multivariate detection (AGG-10..13, WIN-2, WIN-4, JN-11, MTH-2..4, TOP-2)."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the signature, the matcher and the detector.
SIGMA, LEAST_STD, BREACH_FRACTION = 4.0, 1e-6, 0.2
RANK_FLOOR, LEAST_MATCH, TOP_MATCHES = 0.5, 0.05, 5
VARIANCE, ALPHA = 0.85, 0.01
PERSISTENCE, COOLDOWN_S = 3, 300


def signatures(samples: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """One row for each deviating tag of an episode in samples(episode_id, onset, ts, tag_id, value).

    The baseline is the tag's mean and population deviation before the onset (two samples at least);
    a tag deviates if max(1, 20 %) of its later samples are ``sigma`` off. Ranks say who moved first.
    """
    rows = samples.where("value is not null")
    before, after = F.col("ts") < F.col("onset"), F.col("ts") >= F.col("onset")
    key = ["episode_id", "tag_id", "onset"]
    base = rows.groupBy(*key).agg(F.count_if(before).alias("n_pre"), F.count_if(after).alias("n_post"), F.avg(F.when(before, F.col("value"))).alias("mean"), F.greatest(F.stddev_pop(F.when(before, F.col("value"))), F.lit(LEAST_STD)).alias("std")).where("n_pre >= 2 and n_post >= 1")
    post = rows.where(after).join(base, key).withColumn("off", F.abs(F.col("value") - F.col("mean")))
    breach = F.col("off") >= sigma * F.col("std")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    by = post.groupBy(*key, "mean", "std", "n_post").agg(F.count_if(breach).alias("n_breach"), F.min(F.when(breach, F.col("ts"))).alias("first"), F.max_by("value", F.struct(F.col("off"), -us)).alias("peak"))
    kept = by.where(F.col("n_breach") >= F.greatest(F.lit(1), F.floor(F.col("n_post") * BREACH_FRACTION)))
    offset = (F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.col("onset").cast("timestamp"))) / 1e6
    out = kept.select("episode_id", "tag_id", F.when(F.col("peak") >= F.col("mean"), "high").otherwise("low").alias("direction"), F.round(F.abs(F.col("peak") - F.col("mean")) / F.col("std"), 3).alias("magnitude"), F.round(offset, 3).alias("onset_offset_s"))
    order = Window.partitionBy("episode_id").orderBy("onset_offset_s", F.desc("magnitude"), "tag_id")
    return out.withColumn("first_mover_rank", (F.row_number().over(order) - 1).cast("bigint"))


def match(live: DataFrame, library: DataFrame, top: int = TOP_MATCHES) -> DataFrame:
    """The best fault modes of each episode: live and library(mode_id) hold rows (tag_id, direction, first_mover_rank).

    Only pairs that share a tag can score, so candidates come from an equi-join on the tag, not from
    a cross join. Score: (agreeing - conflicting tags) / union, times 0.5 + 0.5 * the fraction of
    agreeing tag pairs in the same order (1 without comparable pairs); at most 0 is no match.
    """
    q = live.select("episode_id", "tag_id", F.col("direction").alias("qd"), F.col("first_mover_rank").alias("qr"))
    c = library.select("mode_id", "tag_id", F.col("direction").alias("cd"), F.col("first_mover_rank").alias("cr"))
    sizes_q, sizes_c = q.groupBy("episode_id").agg(F.count("*").alias("nq")), c.groupBy("mode_id").agg(F.count("*").alias("nc"))
    shared = q.join(c, "tag_id")
    agree = F.collect_list(F.when(F.col("qd") == F.col("cd"), F.struct("tag_id", "qr", "cr"))).alias("agreeing")
    pairs = shared.groupBy("episode_id", "mode_id").agg(F.count("*").alias("n"), F.count_if(F.col("qd") == F.col("cd")).alias("n_agree"), agree)
    order = lambda a, b: F.signum(a["qr"] - b["qr"]) * F.signum(a["cr"] - b["cr"])
    signs = F.flatten(F.transform("agreeing", lambda a: F.transform(F.filter("agreeing", lambda b: b["tag_id"] > a["tag_id"]), lambda b: order(a, b))))
    told, same = F.size(F.filter(signs, lambda s: s != 0)), F.size(F.filter(signs, lambda s: s > 0))
    rank = F.when(told == 0, 1.0).otherwise(same / told)
    overlap = (2 * F.col("n_agree") - F.col("n")) / (F.col("nq") + F.col("nc") - F.col("n"))
    scored = pairs.join(sizes_q, "episode_id").join(sizes_c, "mode_id").withColumn("raw", F.when(overlap > 0, overlap * (RANK_FLOOR + (1 - RANK_FLOOR) * rank)).otherwise(0.0)).where(F.col("raw") >= LEAST_MATCH)
    best = Window.partitionBy("episode_id").orderBy(F.desc(F.round("raw", 4)), "mode_id")
    return scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top).select("episode_id", "mode_id", F.round("raw", 4).alias("confidence"), F.col("nth").cast("bigint").alias("nth"))


def severity(signature: DataFrame) -> DataFrame:
    from millrace.functions.rules import severity_of_peak

    return signature.groupBy("episode_id").agg(severity_of_peak(F.max("magnitude")).alias("severity"))


def unit_areas(signature: DataFrame) -> DataFrame:
    """Units of the deviating tags, once each, by first mover."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_mover_rank", "tag_id"))), lambda s: F.substring_index(s["tag_id"], ".", 1))
    return signature.groupBy("episode_id").agg(F.array_distinct(ordered).alias("unit_areas"))


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution by bisection on the regularised incomplete beta function."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if _beta(x, d1 / 2, d2 / 2) < p else (lo, x)
    return d2 * lo / (d1 * (1 - lo))


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    total = term = 1.0
    n = 0
    while abs(term) > 1e-16 * total and n < 10_000:  # a power series: all terms are positive
        term *= x * (a + b + n) / (a + 1 + n)
        total += term
        n += 1
    return front * total


@dataclass
class DetectorModel:
    """Means, deviations, components and limits of a PCA control chart over named tags (MTH-2, SRC-20)."""

    tags: list[str]
    mean: np.ndarray
    std: np.ndarray
    components: np.ndarray  # tags x kept components
    eigenvalues: np.ndarray
    t2_limit: float
    spe_limit: float
    n: int
    variance_explained: float = 1.0

    def statistics(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(T2, SPE, squared residual of each tag) of rows of readings; missing and non-finite ones count as the mean."""
        z = np.where(np.isfinite(x), (x - self.mean) / self.std, 0.0)
        t = z @ self.components
        residual = (z - t @ self.components.T) ** 2
        return (t**2 / np.maximum(self.eigenvalues, 1e-12)).sum(axis=1), residual.sum(axis=1), residual

    def ratios(self, t2: np.ndarray, spe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both statistics over their limits: more than 1 is an anomaly. Without a limit 0."""
        return t2 / self.t2_limit if self.t2_limit > 0 else np.zeros_like(t2), spe / self.spe_limit if self.spe_limit > 0 else np.zeros_like(spe)

    def to_json(self) -> str:
        return json.dumps({"tags": self.tags, "mean": self.mean.tolist(), "std": self.std.tolist(), "components": self.components.tolist(), "eigenvalues": self.eigenvalues.tolist(), "t2_limit": self.t2_limit, "spe_limit": self.spe_limit, "variance_explained": self.variance_explained, "k_components": len(self.eigenvalues), "n_samples": self.n})

    @classmethod
    def from_json(cls, text: str) -> DetectorModel:
        d = json.loads(text)
        arrays = (np.array(d[c], float) for c in ("mean", "std", "components", "eigenvalues"))
        return cls(list(d["tags"]), *arrays, float(d["t2_limit"]), float(d["spe_limit"]), int(d["n_samples"]), float(d["variance_explained"]))


def shares(residual: np.ndarray) -> np.ndarray:
    """Each tag's share of a row's squared residuals, four decimals; all 0 where there is next to none."""
    total = residual.sum(axis=1, keepdims=True)
    return np.round(np.divide(residual, total, out=np.zeros_like(residual), where=total > 1e-9), 4)


def _gram(tags: list[str], mean: np.ndarray, std: np.ndarray):
    """The cross products of a partition's standardised rows, as (i, j, total) with i >= j."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(tags), len(tags)))
        for frame in frames:
            z = (frame[tags].to_numpy(float) - mean) / std
            total += z.T @ z
        i, j = np.tril_indices(len(tags))
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "total": total[i, j]})

    return run


def fit_detector(wide: DataFrame, tags: list[str], variance: float = VARIANCE, alpha: float = ALPHA) -> DetectorModel:
    """AGG-13: fit on wide(ts, one column a tag): rows are aligned by time, incomplete ones left out.

    Each partition adds up its own cross-product matrix, and Spark sums those by place, so the rows never
    leave the cluster; the driver gets tags^2 / 2 sums and computes their eigenvectors.
    """
    rows = wide.dropna(subset=tags)
    centre = rows.agg(F.count("*").alias("n"), *(F.avg(F.col(t)).alias(f"m{i}") for i, t in enumerate(tags)), *(F.stddev_samp(F.col(t)).alias(f"s{i}") for i, t in enumerate(tags))).first()
    if centre["n"] < 2:
        raise ValueError("a detector needs two rows or more with all tags")
    n, mean = centre["n"], np.array([centre[f"m{i}"] for i in range(len(tags))], float)
    std = np.array([centre[f"s{i}"] or 0.0 for i in range(len(tags))], float)
    std[std < 1e-6] = 1.0
    parts = rows.select(*tags).mapInPandas(_gram(tags, mean, std), "i int, j int, total double")
    cov = np.zeros((len(tags), len(tags)))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        cov[r.i, r.j] = cov[r.j, r.i] = r.total / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    explained = np.cumsum(values) / values.sum()
    k = int(min(max(np.searchsorted(explained, variance) + 1, 1), max(1, len(tags) - 1)))
    t2 = k * (n - 1) * (n + 1) / (n * (n - k)) * f_quantile(1 - alpha, k, n - k)
    rest = values[k:]
    th1, th2, th3 = (float((rest**p).sum()) for p in (1, 2, 3))
    spe = 0.0
    if th1 > 0:
        h0 = 1 - 2 * th1 * th3 / (3 * th2**2)
        c = NormalDist().inv_cdf(1 - alpha)
        spe = th1 * (c * math.sqrt(2 * th2 * h0**2) / th1 + 1 + th2 * h0 * (h0 - 1) / th1**2) ** (1 / h0)
    return DetectorModel(list(tags), mean, std, vectors[:, :k], values[:k], t2, spe, n, float(explained[k - 1]))


def aligned_input(samples: DataFrame, tags: list[str], start: str, end: str, step_s: int, carry_s: int, window: int = 1) -> DataFrame:
    """ETL-20: samples(ts, tag_id, value) on a grid of ``step_s`` seconds from start to end: (ts, one column a tag).

    A tag's value at a time of the grid is its last one up to then, if no more than ``carry_s`` seconds old; of
    several at one time the largest; nulls are no samples. Times without all tags are left out, and with them their
    whole window of ``window`` times (counted from the start). A sample is dealt to the few grid times that it may
    serve, and the newest is taken by a grouped maximum: no window spans a tag, and no grid is crossed with the tags.
    """
    at = lambda c: F.unix_micros(F.lit(c).cast("timestamp_ntz").cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))
    step = step_s * 1_000_000
    rows = samples.where(F.col("tag_id").isin(tags) & F.col("value").isNotNull()).select("tag_id", "value", (at(F.col("ts")) - at(start)).alias("us"), (at(end) - at(start)).alias("most"))
    first = F.greatest(F.ceil(F.col("us") / step), F.lit(0))
    last = F.floor(F.least(F.col("us") + carry_s * 1_000_000, F.col("most")) / step)
    dealt = rows.where(first <= last).select("tag_id", "value", "us", F.explode(F.sequence(first, last)).alias("slot"))
    newest = dealt.groupBy("slot", "tag_id").agg(F.max(F.struct("us", "value")).alias("newest"))
    wide = newest.groupBy("slot").agg(*(F.max(F.when(F.col("tag_id") == t, F.col("newest.value"))).alias(t) for t in tags)).dropna(subset=tags)
    whole = wide.groupBy(F.expr(f"slot div {window}").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") == window)
    kept = wide.withColumn("of", F.expr(f"slot div {window}")).join(whole, "of")
    return kept.select((F.timestamp_micros(at(start) + F.col("slot") * step)).cast("timestamp_ntz").alias("ts"), *tags)


def score_detector(wide: DataFrame, model: DetectorModel) -> DataFrame:
    """ts, t2, spe, their ratios to the limits, anomalous, the tag with the largest residual and all tags' shares; missing values count as the mean."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            t2, spe, residual = model.statistics(frame[model.tags].to_numpy(float))
            t2_ratio, spe_ratio = model.ratios(t2, spe)
            lead = [model.tags[i] for i in residual.argmax(axis=1)] if len(frame) else []
            parts = [dict(zip(model.tags, own, strict=True)) for own in shares(residual).tolist()]
            yield pd.DataFrame({"ts": frame["ts"], "t2": t2, "spe": spe, "t2_ratio": t2_ratio, "spe_ratio": spe_ratio, "anomalous": (t2_ratio > 1) | (spe_ratio > 1), "lead_tag": lead, "contributions": parts})

    return wide.select("ts", *model.tags).mapInPandas(run, "ts timestamp_ntz, t2 double, spe double, t2_ratio double, spe_ratio double, anomalous boolean, lead_tag string, contributions map<string,double>")


def persistent_anomalies(scored: DataFrame, key: list[str], run: int = PERSISTENCE) -> DataFrame:
    """Rows at which the last ``run`` rows of a key are anomalous, with the first of them as onset."""
    order = Window.partitionBy(*key).orderBy("ts")
    last = order.rowsBetween(-(run - 1), 0)
    return scored.withColumns({"all_bad": F.min(F.col("anomalous").cast("int")).over(last), "n_last": F.count("*").over(last), "onset": F.min("ts").over(last)}).where((F.col("all_bad") == 1) & (F.col("n_last") == run)).drop("all_bad", "n_last")
