"""Genome size from a k-mer growth curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.operators import kmers


def unique_growth(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Different k-mers after x observations: a share ``a`` of errors, all new, and ``b`` genomic k-mers drawn at random."""
    return a * x + b - b * ((b + a - 1) / b) ** x


def fit(x, u, iterations: int = 200) -> dict[str, float]:
    """Least squares of :func:`unique_growth` with weights log(x), by damped Gauss-Newton on (logit a, log b)."""
    x, u = np.asarray(x, float), np.asarray(u, float)
    weight = np.log(np.maximum(x, 2))

    def params(t):
        return 1 / (1 + np.exp(-t[0])), np.exp(t[1])

    def residual(t):
        a, b = params(t)
        return (unique_growth(x, a, b) - u) * weight

    best = None
    for a0 in (0.01, 0.05, 0.2):
        t = np.array([np.log(a0 / (1 - a0)), np.log(max(2.0, float(u.max())))])
        damp, r = 1e-3, residual(t)
        for _ in range(iterations):
            step = np.maximum(1e-6, 1e-6 * np.abs(t))
            j = np.stack([(residual(t + step * e) - r) / s for e, s in zip(np.eye(2), step)], 1)
            h = j.T @ j
            move = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), -j.T @ r, rcond=None)[0]
            new = residual(t + move)
            if np.isfinite(new).all() and new @ new < r @ r:
                done = abs(new @ new - r @ r) <= 1e-12 * (r @ r)
                t, r, damp = t + move, new, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        if best is None or r @ r < best[1]:
            best = (t, r @ r)
    a, b = params(best[0])
    return {"error_rate": float(a), "genome_kmers": float(b), "residual": float(best[1])}


def saturating_fit(x, u) -> dict[str, float]:
    """Three-parameter fit u = c * x / (d + x) + e * x, linear in (c, e) for each d on a log grid."""
    x, u = np.asarray(x, float), np.asarray(u, float)
    found = []
    for d in np.geomspace(max(1.0, x.min() / 10), x.max() * 100, 200):
        basis = np.stack([x / (d + x), x], 1)
        coef, *_ = np.linalg.lstsq(basis, u, rcond=None)
        found.append((float(((basis @ coef - u) ** 2).sum()), d, *coef))
    err, d, c, e = min(found)
    return {"genome_kmers": float(c), "half": float(d), "error_rate": float(e), "residual": err}


def estimate(reads: DataFrame, k: int, fraction: float = 0.5, partitions: int = 100, first: int = 128, growth: float = 1.05) -> dict[str, float]:
    """Error rate and genome size from as many of ``partitions`` hash parts of the reads as reach ``fraction``.

    The curve has a snapshot whenever the k-mers seen have grown by 5 %, in order of
    read_id; the driver gets these, some hundred rows at any size. Raw and distinct
    k-mers of all reads are carried on from the fraction read. Empty if there are fewer
    than three snapshots.
    """
    rounds = min(partitions, -(-int(round(fraction * partitions * 1e9)) // 10**9))
    part = F.conv(F.substring(F.md5(F.col("read_id").cast("string")), 1, 8), 16, 10).cast("bigint") % partitions
    snapshots = sorted(kmers.size_history_growth_of(reads.where(part < rounds), k, first, growth).collect(), key=lambda r: r.part)
    if len(snapshots) < 3:
        return {}
    x, u = [float(r.raw) for r in snapshots], [float(r.distinct_kmers) for r in snapshots]
    found, other, read = fit(x, u), saturating_fit(x, u), rounds / partitions
    raw = x[-1] / read
    return {
        "fraction": read, "snapshots": float(len(x)), "error_rate": found["error_rate"], "genome_kmers": found["genome_kmers"], "raw_kmers": raw,
        "distinct_kmers": raw * found["error_rate"] + found["genome_kmers"], "saturating_genome_kmers": other["genome_kmers"], "saturating_error_rate": other["error_rate"],
    }
