"""Gated recurrent layers and Adam in numpy, shared by the two recurrent models."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru_step(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step for a batch: x holds the inputs' share of the update, reset and candidate gates."""
    k = len(u)
    g = h @ u
    zr = x[:, : 2 * k] + g[:, : 2 * k]  # their sigmoid, in place
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    n = x[:, 2 * k :] + zr[:, k:] * g[:, 2 * k :]
    np.tanh(n, out=n)
    out = h - n
    out *= zr[:, :k]
    out += n
    return out, (h, zr, n, g[:, 2 * k :])


def gru_step_back(dh: np.ndarray, u: np.ndarray, saved: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient of x, gradient of u, gradient of the state before) of a step."""
    k = len(u)
    h, zr, n, gn = saved
    z, r = zr[:, :k], zr[:, k:]
    dn = dh * (1 - z) * (1 - n * n)
    dz = dh * (h - n) * z * (1 - z)
    dr = dn * gn * r * (1 - r)
    dx = np.concatenate([dz, dr, dn], axis=1)
    dg = np.concatenate([dz, dr, dn * r], axis=1)
    return dx, h.T @ dg, dh * z + dg @ u.T


def by_gate(x: np.ndarray, k: int) -> np.ndarray:
    """(..., 3 k) as (3, ..., k): each gate of k in one piece, over which a step goes in a fraction of the time."""
    return np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], 3, k), -2, 0))


def gate_step(x: np.ndarray, u: np.ndarray, h: np.ndarray, g: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """gru_step with x and u by gate. g: room for the gates' recurrent part, used again by each step."""
    g = np.matmul(h, u, out=g)
    zr = x[:2] + g[:2]  # their sigmoid, in place
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    n = zr[1] * g[2]
    n += x[2]
    np.tanh(n, out=n)
    out = h - n
    out *= zr[0]
    out += n
    return out, (h, zr, n, g[2].copy())


def gate_step_back(dh: np.ndarray, back: np.ndarray, saved: tuple, dx: np.ndarray, dg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of u by gate, gradient of the state before): gru_step_back by gate. back: u by gate, each gate
    transposed. The gradient of x is written to dx, that of the gates' recurrent part to dg, used again by each step."""
    h, zr, n, gn = saved
    np.multiply(n, n, out=dx[2])
    np.subtract(1, dx[2], out=dx[2])
    slope = 1 - zr
    dx[2] *= slope[0]
    dx[2] *= dh
    slope *= zr
    np.subtract(h, n, out=dx[0])
    dx[0] *= dh
    np.multiply(dx[2], gn, out=dx[1])
    dx[:2] *= slope
    dg[:2] = dx[:2]
    np.multiply(dx[2], zr[1], out=dg[2])
    out = dh * zr[0]
    for part in np.matmul(dg, back):
        out += part
    return np.matmul(h.T, dg), out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0, slow: dict[str, float] | None = None, rows: dict[str, np.ndarray] | None = None) -> None:
        """rows: of these weights only the given rows have gradients; the others and their moments stay as they are."""
        self.t += 1
        at = {k: (rows or {}).get(k, slice(None)) for k in grads}
        grads = {k: g[at[k]] for k, g in grads.items()}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-12))
        c1, c2 = 1 - 0.9**self.t, 1 - 0.999**self.t
        for k, g in grads.items():
            g, i = g * scale, at[k]
            # rows that are picked out are copies: each is read and written once, and sums go in place
            m, v = self.m[k][i], self.v[k][i]
            d = g - m
            d *= 0.1
            m += d
            g *= g
            g -= v
            g *= 0.001
            v += g
            self.m[k][i], self.v[k][i] = m, v
            d = v / c2
            np.sqrt(d, out=d)
            d += 1e-8
            self.params[k][i] -= ((slow or {}).get(k, 1.0) * self.rate / c1) * m / d
