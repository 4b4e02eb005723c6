"""Background models of a group of observations, in NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from obsward.types import BackgroundType, member

LAPSE = -0.0065


def nelder_mead(f: Callable[[np.ndarray], float], start: list[float], step: float = 1.0, tolerance: float = 1e-2, most: int = 100) -> np.ndarray:
    """Downhill simplex: at most `most` steps, until the corners lie within the tolerance (root mean square) of their centre."""
    x = np.array([start, *(np.array(start) + step * e for e in np.eye(len(start)))], dtype=float)
    y = np.array([f(p) for p in x])
    for _ in range(most):
        worst = int(y.argmax())
        rest = np.delete(np.arange(len(x)), worst)
        centre = x[rest].mean(axis=0)
        trial = 2 * centre - x[worst]
        value = f(trial)
        if value < y.min():
            further = 3 * centre - 2 * x[worst]
            beyond = f(further)
            x[worst], y[worst] = (further, beyond) if beyond < y.min() else (trial, value)
        elif value < y[rest].max():
            x[worst], y[worst] = trial, value
        else:
            if value < y[worst]:
                x[worst], y[worst] = trial, value
            inside = (centre + x[worst]) / 2
            closer = f(inside)
            if closer < y[worst]:
                x[worst], y[worst] = inside, closer
            else:
                best = int(y.argmin())
                x = (x + x[best]) / 2
                y = np.array([f(p) if k != best else y[best] for k, p in enumerate(x)])
        if np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()) < tolerance:
            break
    return x[int(y.argmin())]


def _profile(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Linear, or with an inversion of depth a between h0 and h0 + |h1|."""
    line = p[0] + p[1] * z
    if len(p) == 2:
        return line
    a, h0, depth = p[2], p[3], abs(p[4])
    part = np.clip((z - h0) / depth, 0, 1) if depth > 0 else (z > h0).astype(float)
    return line - a / 2 * (1 + np.cos(np.pi * part))


def vertical_profile(elevs: np.ndarray, values: np.ndarray, out_elevs: np.ndarray, num_min_prof: int, min_elev_diff: float) -> np.ndarray:
    """Values that a temperature profile fitted to the observations has at out_elevs; their mean over flat ground."""
    if not len(elevs):
        raise ValueError("a profile needs observations")
    mean = float(np.mean(values))
    low, high = np.quantile(elevs, [0.05, 0.95])
    if elevs.min() == elevs.max() or high - low < min_elev_diff:
        return np.full(len(out_elevs), mean)
    start = [mean, LAPSE] if len(elevs) < num_min_prof else [mean, LAPSE, 5.0, *np.quantile(elevs, [0.1, 0.9])]
    fit = nelder_mead(lambda p: float(np.log(max(np.sqrt(np.mean((_profile(p, elevs) - values) ** 2)), 1e-6))), start)
    return _profile(fit, out_elevs)


def vertical_profile_theil_sen(elevs: np.ndarray, values: np.ndarray, out_elevs: np.ndarray, num_min_prof: int, min_elev_diff: float) -> np.ndarray:
    """Line through the medians: slope of all pairs (0 where elevations are within a metre), then intercept.

    A few observations, or flat ground, take the standard lapse rate.
    """
    if not len(elevs):
        raise ValueError("a profile needs observations")
    low, high = np.quantile(elevs, [0.05, 0.95])
    slope = LAPSE
    if len(elevs) >= num_min_prof and elevs.min() != elevs.max() and high - low >= min_elev_diff:
        i, j = np.triu_indices(len(elevs), 1)
        dz, dv = elevs[i] - elevs[j], values[i] - values[j]
        far = np.abs(dz) >= 1
        slope = float(np.median(np.where(far, dv / np.where(far, dz, 1), 0)))
    return float(np.median(values - slope * elevs)) + slope * out_elevs


def background(elevs: np.ndarray, values: np.ndarray, kind: BackgroundType | int | str, num_min_prof: int, min_elev_diff: float, lowest: float = np.nan, highest: float = np.nan, external: np.ndarray | None = None) -> np.ndarray:
    """Background at the observations themselves, held within [lowest, highest] where these are valid."""
    kind = member(BackgroundType, kind)
    if kind == BackgroundType.VerticalProfile:
        out = vertical_profile(elevs, values, elevs, num_min_prof, min_elev_diff)
    elif kind == BackgroundType.VerticalProfileTheilSen:
        out = vertical_profile_theil_sen(elevs, values, elevs, num_min_prof, min_elev_diff)
    elif kind == BackgroundType.MeanOuterCircle:
        out = np.full(len(values), np.mean(values))
    elif kind == BackgroundType.MedianOuterCircle:
        out = np.full(len(values), np.median(values))
    elif external is None:
        raise ValueError("an external background needs its values")
    else:
        out = external.astype(float)
    if np.isfinite(lowest):
        out = np.maximum(out, lowest)
    if np.isfinite(highest):
        out = np.minimum(out, highest)
    return out


def quantile(q: float, values: np.ndarray) -> float:
    """Linear between neighbours, as np.quantile, which takes thirty times as long for few values."""
    kept = np.sort(values[np.isfinite(values)])
    if not len(kept):
        raise RuntimeError("no valid values")
    at = q * (len(kept) - 1)
    k = int(at)
    a, b, t = float(kept[k]), float(kept[min(k + 1, len(kept) - 1)]), at - k
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def invert(matrix: np.ndarray) -> np.ndarray | None:
    """Inverse, None for a singular matrix."""
    try:
        inverse = np.linalg.inv(matrix)
    except np.linalg.LinAlgError:
        return None
    return inverse if np.isfinite(inverse).all() else None
