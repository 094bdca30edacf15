"""Box motion filters on stacks of states: one call moves all live tracks of a step.

State per track: [cx, cy, w, h, vx, vy, vw, vh]. ``x`` has shape (n, 8), ``p`` (n, 8, 8). Process
noise has two 4x4 blocks with one diagonal and one off-diagonal value each, kept as ``q`` (n, 4):
position diagonal, position off-diagonal, velocity diagonal, velocity off-diagonal.
"""

from __future__ import annotations

import numpy as np

UKF, MCUKF, MANIFOLD = 0, 1, 2
KINDS = {"ukf": UKF, "mcukf": MCUKF, "manifold_ukf": MANIFOLD}
KIND_NAMES = np.array(["ukf", "mcukf", "manifold_ukf"])

# Filter constants: fixed values.
N = 8
ALPHA, BETA = 1e-3, 2.0
LAMBDA = ALPHA ** 2 * N - N
GAMMA = (N + LAMBDA) ** 0.5
P_MAX = np.array([0.05, 0.05, 0.02, 0.02, 0.01, 0.01, 0.01, 0.01])
P_START, Q_START = 0.02, 0.0010
POS_NOISE, SIZE_NOISE = 0.010, 0.015

WM = np.full(2 * N + 1, 1.0 / (2.0 * (N + LAMBDA)))
WM[0] = LAMBDA / (N + LAMBDA)
WC = WM.copy()
WC[0] += 1.0 - ALPHA ** 2 + BETA


def measurement(boxes: np.ndarray) -> np.ndarray:
    """Corners (n, 4) to centre, width and height with sides of at least 1e-5."""
    out = np.empty((len(boxes), 4))
    out[:, 2:] = np.maximum(1e-5, boxes[:, 2:] - boxes[:, :2])
    out[:, :2] = boxes[:, :2] + out[:, 2:] * 0.5
    return out


def corners(x: np.ndarray) -> np.ndarray:
    half = np.maximum(1e-5, x[:, 2:4]) * 0.5
    out = np.empty((len(x), 4))
    out[:, :2] = x[:, :2] - half
    out[:, 2:] = x[:, :2] + half
    return np.minimum(np.maximum(out, 0.0, out=out), 1.0, out=out)


def _diag(p: np.ndarray) -> np.ndarray:
    """Writable view of the diagonals."""
    return np.einsum("nii->ni", p)


def start(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(boxes)
    x = np.zeros((n, N))
    x[:, :4] = measurement(boxes)
    p = np.tile(np.eye(N) * P_START, (n, 1, 1))
    q = np.tile(np.array([Q_START, 0.0, Q_START, 0.0]), (n, 1))
    return x, p, q


def _add_noise(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p[:, :4, :4] += q[:, 1, None, None]
    p[:, 4:, 4:] += q[:, 3, None, None]
    d = _diag(p)
    d[:, :4] += (q[:, 0] - q[:, 1])[:, None]
    d[:, 4:] += (q[:, 2] - q[:, 3])[:, None]
    return p


def _limit_state(x: np.ndarray, clip: float) -> None:
    v, size = x[:, 4:], x[:, 2:4]
    np.minimum(np.maximum(v, -clip, out=v), clip, out=v)
    np.minimum(np.maximum(size, 1e-5, out=size), 1.0, out=size)


def _limit_variance(p: np.ndarray) -> np.ndarray:
    """Cut variances above their limits, rows and columns alike; changes ``p``."""
    d = _diag(p)
    s = np.sqrt(P_MAX / np.maximum(d, P_MAX))
    p *= s[:, :, None]
    p *= s[:, None, :]
    np.maximum(d, 1e-8, out=d)
    return p


def _root(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cholesky factors; matrices that fail get a diagonal load, then the start value."""
    failed = np.zeros(len(p), dtype=bool)
    try:
        return p, np.linalg.cholesky(p), failed
    except np.linalg.LinAlgError:
        pass
    p, low, i = p.copy(), np.empty_like(p), np.arange(N)
    for k in range(len(p)):
        try:
            low[k] = np.linalg.cholesky(p[k])
            continue
        except np.linalg.LinAlgError:
            failed[k] = True
        m = (p[k] + p[k].T) * 0.5
        m[i, i] += max(1e-6, abs(m[i, i].min()) * 1.1)
        try:
            low[k] = np.linalg.cholesky(m)
        except np.linalg.LinAlgError:
            m = np.eye(N) * P_START
            low[k] = np.linalg.cholesky(m)
        p[k] = m
    return p, low, failed


def _spread(x: np.ndarray, root: np.ndarray) -> np.ndarray:
    """17 points around each state, (n, 8, 17)."""
    pts = np.empty((len(x), N, 2 * N + 1))
    step = GAMMA * root
    pts[:, :, 0] = x
    pts[:, :, 1:N + 1] = x[:, :, None] + step
    pts[:, :, N + 1:] = x[:, :, None] - step
    return pts


def _points(x, p, manifold: bool):
    """Covariance in use, points and failures; may change ``p``, which callers replace anyway."""
    if manifold:
        lam, vec = np.linalg.eigh((p + p.transpose(0, 2, 1)) * 0.5)
        root = (vec * np.sqrt(np.maximum(lam, 1e-8))[:, None, :]) @ vec.transpose(0, 2, 1)
        return p, _spread(x, root), np.zeros(len(x), dtype=bool)
    p, low, failed = _root(_limit_variance(p))
    return p, _spread(x, low), failed


def _settle(p: np.ndarray, manifold: bool) -> np.ndarray:
    p = (p + p.transpose(0, 2, 1)) * 0.5
    if manifold:
        lam, vec = np.linalg.eigh(p)
        p = (vec * np.clip(lam, 1e-8, 0.05)[:, None, :]) @ vec.transpose(0, 2, 1)
    return _limit_variance(p)


def predict(x, p, q, clip: float, manifold: bool):
    """One step at constant velocity; returns x, p and the Cholesky failures."""
    p, pts, failed = _points(x, p, manifold)
    pts[:, :4] += pts[:, 4:]
    x = (WM * pts).sum(axis=2)
    _limit_state(x, clip)
    d = pts - x[:, :, None]
    p = _add_noise((d * WC) @ d.transpose(0, 2, 1), q)
    return x, _settle(p, manifold), failed


def _observation_noise(z: np.ndarray) -> np.ndarray:
    scale = np.maximum(1.0, 0.05 / np.maximum(np.maximum(z[:, 2], z[:, 3]), 1e-5))
    r = np.zeros((len(z), 4, 4))
    r[:, 0, 0] = r[:, 1, 1] = POS_NOISE * scale
    r[:, 2, 2] = r[:, 3, 3] = SIZE_NOISE
    return r


def _adapt(q: np.ndarray, nis: np.ndarray) -> np.ndarray:
    up, down = (nis > 2.0)[:, None], (nis < 0.3)[:, None]
    grown = np.minimum(q * np.array([1.05, 1.05, 1.10, 1.10]), np.array([0.05, 0.05, 0.02, 0.02]))
    cut = np.maximum(q * np.array([0.98, 0.98, 0.95, 0.95]), np.array([1e-5, 1e-5, 1e-6, 1e-6]))
    return np.where(up, grown, np.where(down, cut, q))


def correct(x, p, q, boxes: np.ndarray, clip: float, kind: int, kernel_sigma: float):
    """Take in one box per track; returns x, p, q, nis and the Cholesky failures."""
    z = measurement(boxes)
    r = _observation_noise(z)
    if kind == MCUKF:
        return _correct_mc(x, p, q, z, r, clip, kernel_sigma)
    manifold = kind == MANIFOLD
    p, pts, failed = _points(x, p, manifold)
    seen = pts[:, :4]
    z_mean = (WM * seen).sum(axis=2)
    dz = seen - z_mean[:, :, None]
    s = (dz * WC) @ dz.transpose(0, 2, 1) + r
    miss = z - z_mean
    nis = _nis(miss, s)
    dx = pts - x[:, :, None]
    gain = ((dx * WC) @ dz.transpose(0, 2, 1)) @ np.linalg.inv(s)
    x = x + (gain @ miss[:, :, None])[:, :, 0]
    _limit_state(x, clip)
    p = _settle(p - gain @ s @ gain.transpose(0, 2, 1), manifold)
    return x, p, _adapt(q, nis), nis, failed


def _nis(miss: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (miss ** 2).sum(axis=1) / np.maximum(np.trace(s, axis1=1, axis2=2), 1e-10)


def _correct_mc(x, p, q, z, r, clip, kernel_sigma):
    """Correntropy update: points far from the observation weigh less; at most three rounds."""
    sigma = np.maximum(0.05, np.minimum(max(0.01, kernel_sigma), np.minimum(z[:, 2], z[:, 3]) * 0.5))
    p, pts, failed = _points(x, p, False)
    seen = pts[:, :4]
    n = len(x)
    w = np.exp(-((z[:, :, None] - seen) ** 2).sum(axis=1) / (2.0 * sigma ** 2)[:, None])
    w[:, 0] = np.maximum(w[:, 0], 1e-10)
    w /= w.sum(axis=1, keepdims=True)
    w = w[:, None, :]
    z_mean = (w * seen).sum(axis=2)
    dz = seen - z_mean[:, :, None]
    s = (dz * w) @ dz.transpose(0, 2, 1) + r
    s_inv = np.linalg.inv(s)
    miss = z - z_mean
    # Weights depend on the observation and the points only; a round changes the cross term alone.
    now, gain = x.copy(), np.zeros((n, N, 4))
    live = np.arange(n)
    for rounds in range(3):
        dx = pts[live] - now[live][:, :, None]
        gain[live] = ((dx * w[live]) @ dz[live].transpose(0, 2, 1)) @ s_inv[live]
        before = now[live]
        now[live] = x[live] + (gain[live] @ miss[live][:, :, None])[:, :, 0]
        if rounds > 0:
            live = live[np.linalg.norm(now[live] - before, axis=1) >= 1e-6]
            if not len(live):
                break
    nis = _nis(miss, s)
    keep = np.tile(np.eye(N), (n, 1, 1))
    keep[:, :, :4] -= gain
    p = keep @ p @ keep.transpose(0, 2, 1) + gain @ r @ gain.transpose(0, 2, 1)
    p = (p + p.transpose(0, 2, 1)) * 0.5
    _limit_state(now, clip)
    return now, _limit_variance(p), _adapt(q, nis), nis, failed


# --- linear filter of rectangle tracks --------------------------------------------------

RECT_Q, RECT_R = 0.0015, 0.012


def linear_predict(x: np.ndarray, p: np.ndarray):
    x = x.copy()
    x[:, :4] += x[:, 4:]
    p = p.copy()
    p[:, :4] += p[:, 4:]
    p[:, :, :4] += p[:, :, 4:]
    d = _diag(p)
    d += RECT_Q
    return x, p


def linear_correct(x: np.ndarray, p: np.ndarray, boxes: np.ndarray):
    z = measurement(boxes)
    gain = p[:, :, :4] @ np.linalg.inv(p[:, :4, :4] + np.eye(4) * RECT_R)
    x = x + (gain @ (z - x[:, :4])[:, :, None])[:, :, 0]
    return x, p - gain @ p[:, :4]
