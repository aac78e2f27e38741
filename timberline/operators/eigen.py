"""27 metrics of the neighbourhood of each point within a sphere.

Neighbours are never gathered: one aggregation of the radius join gives the moments, a batched eigensolver
works on six covariance columns, and everything else is column expressions. The curvatures come from a
second aggregation of the same join in each point's own frame.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import check_radius, radius_pairs

EIGEN = ["l1", "l2", "l3", *[f"e{i}{c}" for i in (1, 2, 3) for c in "xyz"]]
# The public names of the metrics, in order.
METRICS = [
    "eLargest", "eMedium", "eSmallest", "eSum", "Curvature", "Omnivariance", "Anisotropy", "Eigentropy", "Linearity", "Verticality",
    "Planarity", "Sphericity", "Nx", "Ny", "Nz", "SurfaceVariation", "ChangeCurvature", "SurfaceDensity", "VolumeDensity", "MomentOrder1",
    "NormalChangeRate", "Roughness", "MeanCurvature", "GaussianCurvature", "PCA1", "PCA2", "NumNeighbors",
]
_PRODUCTS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
_POWERS = [(i, j) for n in range(5) for i in range(n, -1, -1) for j in [n - i]]
_QUADRIC = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def covariances(pairs: DataFrame) -> DataFrame:
    """(id, n, mx, my, mz, cxx, cxy, ...): count, mean offset from the point and population covariance."""
    g = pairs.groupBy(F.col("l_id").alias("id"))
    m = g.agg(F.count("*").alias("n"), *[F.avg("d" + a).alias("m" + a) for a in "xyz"], *[F.avg(F.col("d" + a) * F.col("d" + b)).alias("s" + a + b) for a, b in _PRODUCTS])
    return m.select("id", "n", "mx", "my", "mz", *[(F.col("s" + a + b) - F.col("m" + a) * F.col("m" + b)).alias("c" + a + b) for a, b in _PRODUCTS])


def _solver():
    def axes(a: np.ndarray, sweeps: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues, falling, and eigenvectors, in columns, of symmetric 3 x 3 matrices by plane rotations.

        They blur the small eigenvalues of thin neighbourhoods less than LAPACK's solver does, so that sums stay on
        their side of a half and normals of upright planes level. Four sweeps reach the precision of doubles; their
        number is fixed, so that a row doesn't depend on the others of its batch. ``a`` is overwritten.
        """
        v = np.broadcast_to(np.eye(3), a.shape).copy()
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for p, q in ((0, 1), (0, 2), (1, 2)) * sweeps:
                r = 3 - p - q
                pp, qq, pq, pr, qr = (a[:, i, j].copy() for i, j in ((p, p), (q, q), (p, q), (p, r), (q, r)))
                ratio = (qq - pp) / (2 * pq)
                t = np.where(pq == 0, 0.0, np.where(qq >= pp, 1.0, -1.0) / (np.abs(ratio) + np.sqrt(ratio * ratio + 1)) * np.sign(pq))
                sin, cos = t / np.sqrt(t * t + 1), 1 / np.sqrt(t * t + 1)
                a[:, p, p], a[:, q, q] = pp - t * pq, qq + t * pq
                a[:, p, q] = a[:, q, p] = 0.0
                a[:, p, r] = a[:, r, p] = cos * pr - sin * qr
                a[:, q, r] = a[:, r, q] = sin * pr + cos * qr
                vp, vq, cos, sin = v[:, :, p].copy(), v[:, :, q].copy(), cos[:, None], sin[:, None]
                v[:, :, p], v[:, :, q] = cos * vp - sin * vq, sin * vp + cos * vq
        w = np.diagonal(a, axis1=1, axis2=2)
        order = np.argsort(-w, 1, kind="stable")
        return np.take_along_axis(w, order, 1), np.take_along_axis(v, order[:, None, :], 2)

    @F.pandas_udf(", ".join(f"{n} double" for n in EIGEN))
    def solve(cxx: pd.Series, cxy: pd.Series, cxz: pd.Series, cyy: pd.Series, cyz: pd.Series, czz: pd.Series) -> pd.DataFrame:
        c = np.empty((len(cxx), 3, 3))
        for (i, j), s in zip([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], (cxx, cxy, cxz, cyy, cyz, czz)):
            c[:, i, j] = c[:, j, i] = s.to_numpy()
        w, v = axes(c)
        normal = v[:, :, 2]
        # one sign for each normal: upwards, else along the first axis that isn't zero
        lead = np.where(np.abs(normal[:, 2]) > 1e-12, normal[:, 2], np.where(np.abs(normal[:, 1]) > 1e-12, normal[:, 1], normal[:, 0]))
        v[:, :, 2] = normal * np.where(lead < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame(np.concatenate([np.maximum(w, 0.0), v[:, :, 0], v[:, :, 1], v[:, :, 2]], 1), columns=EIGEN)

    return solve


def _curvatures():
    names = [f"u{i}{j}" for i, j in _POWERS] + [f"w{i}{j}" for i, j in _QUADRIC] + ["u", "v", "size", "n"]

    @F.pandas_udf("mean double, gaussian double")
    def solve(columns: pd.DataFrame) -> pd.DataFrame:
        m = columns[names]
        at = {p: m[f"u{p[0]}{p[1]}"].to_numpy() for p in _POWERS}
        scale = np.sqrt(np.maximum(m["size"].to_numpy(), 1e-300))
        a = np.empty((len(m), 6, 6))
        b = np.empty((len(m), 6))
        for r, (i, j) in enumerate(_QUADRIC):
            b[:, r] = m[f"w{i}{j}"].to_numpy() / scale ** (i + j)
            for c, (k, l) in enumerate(_QUADRIC):
                a[:, r, c] = at[(i + k, j + l)] / scale ** (i + j + k + l)
        h = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
        _, p, q, d, e, f = (h[:, c] / scale ** (i + j) for c, (i, j) in enumerate(_QUADRIC))
        u, v = m["u"].to_numpy(), m["v"].to_numpy()
        fu, fv, fuu, fvv, fuv = p + 2 * d * u + e * v, q + e * u + 2 * f * v, 2 * d, 2 * f, e
        g = 1 + fu * fu + fv * fv
        mean = np.abs((1 + fv * fv) * fuu - 2 * fu * fv * fuv + (1 + fu * fu) * fvv) / (2 * g**1.5)
        gauss = np.abs((fuu * fvv - fuv * fuv) / (g * g))
        ok = (m["n"].to_numpy() >= 5) & (m["size"].to_numpy() > 1e-10)
        return pd.DataFrame({"mean": np.where(ok, mean, 0.0), "gaussian": np.where(ok, gauss, 0.0)})

    return solve, names


def eigen_metrics(points: DataFrame, radius: float = 0.1, curvature: bool = True) -> DataFrame:
    """(id, the 27 metrics) of each point of (id, x, y, z), with neighbours up to ``radius``, itself included.

    With fewer than 3 neighbours all metrics are 0 except NumNeighbors. Ratios to a zero eigenvalue are NaN.
    Normals point upwards. ``curvature=False`` leaves both curvatures 0 and saves the second aggregation.
    """
    r = check_radius(radius)
    pairs = radius_pairs(points, points, r, 3)
    cov = covariances(pairs)
    enough = F.col("n") >= 3
    eig = cov.where(enough).withColumn("eig", _solver()(*["c" + a + b for a, b in _PRODUCTS])).select("id", "n", "mx", "my", "mz", "eig.*")
    if curvature:
        frame = eig.where("n >= 5")
        d = [F.col("d" + a) - F.col("m" + a) for a in "xyz"]
        along = lambda i: d[0] * F.col(f"e{i}x") + d[1] * F.col(f"e{i}y") + d[2] * F.col(f"e{i}z")
        own = lambda i: -(F.col("mx") * F.col(f"e{i}x") + F.col("my") * F.col(f"e{i}y") + F.col("mz") * F.col(f"e{i}z"))
        local = pairs.withColumnRenamed("l_id", "id").join(frame, "id").select("id", along(1).alias("a"), along(2).alias("b"), along(3).alias("c"), own(1).alias("u"), own(2).alias("v"))
        power = lambda i, j: F.pow("a", F.lit(i)) * F.pow("b", F.lit(j))
        largest = F.greatest(F.max(F.col("a") * F.col("a")), F.max(F.col("b") * F.col("b")), F.max(F.col("c") * F.col("c")))
        sums = local.groupBy("id").agg(*[F.sum(power(i, j)).alias(f"u{i}{j}") for i, j in _POWERS], *[F.sum(power(i, j) * F.col("c")).alias(f"w{i}{j}") for i, j in _QUADRIC], F.first("u").alias("u"), F.first("v").alias("v"), largest.alias("size"), F.count("*").alias("n"))
        solve, names = _curvatures()
        curved = sums.select("id", solve(F.struct(*names)).alias("k")).select("id", F.col("k.mean").alias("MeanCurvature"), F.col("k.gaussian").alias("GaussianCurvature"))
    full = cov.select("id", "n").join(eig.drop("n"), "id", "left")
    full = full.join(curved, "id", "left") if curvature else full.withColumn("MeanCurvature", F.lit(0.0)).withColumn("GaussianCurvature", F.lit(0.0))
    l1, l2, l3, total = F.col("l1"), F.col("l2"), F.col("l3"), F.col("l1") + F.col("l2") + F.col("l3")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan")))
    flat = (l1 <= 0) | (l2 <= 0) | (l3 <= 0)
    k = F.col("n").cast("double")
    # the mean offset seen from the centroid is minus the point's own place
    s = F.col("mx") * F.col("e2x") + F.col("my") * F.col("e2y") + F.col("mz") * F.col("e2z")
    depth = F.abs(F.col("mx") * F.col("e3x") + F.col("my") * F.col("e3y") + F.col("mz") * F.col("e3z"))
    bend = ratio(l3, total)
    value = {
        "eLargest": l1, "eMedium": l2, "eSmallest": l3, "eSum": total, "Curvature": bend,
        "Omnivariance": F.when(flat, 0.0).otherwise(F.cbrt(l1 * l2 * l3)), "Anisotropy": ratio(l1 - l3, l1),
        "Eigentropy": F.when(flat, 0.0).otherwise(-(l1 * F.log(l1) + l2 * F.log(l2) + l3 * F.log(l3))),
        "Linearity": ratio(l1 - l2, l1), "Verticality": 1 - F.abs("e3z"), "Planarity": ratio(l2 - l3, l1), "Sphericity": ratio(l3, l1),
        "Nx": F.col("e3x"), "Ny": F.col("e3y"), "Nz": F.col("e3z"), "SurfaceVariation": bend, "ChangeCurvature": bend,
        "SurfaceDensity": k / (math.pi * r * r), "VolumeDensity": k / (4 / 3 * math.pi * r**3),
        "MomentOrder1": F.when(k * (l2 + s * s) < 1e-10, 0.0).otherwise(ratio(k * s * s, l2 + s * s)), "NormalChangeRate": bend, "Roughness": depth,
        "MeanCurvature": F.col("MeanCurvature"), "GaussianCurvature": F.col("GaussianCurvature"),
        "PCA1": F.when(total <= 2.3e-16, 0.0).otherwise(ratio(l1, total)), "PCA2": F.when(total <= 2.3e-16, 0.0).otherwise(ratio(l2, total)),
    }
    return full.select("id", *[F.when(enough, F.coalesce(value[m], F.lit(0.0))).otherwise(0.0).alias(m) for m in METRICS[:-1]], k.alias("NumNeighbors"))
