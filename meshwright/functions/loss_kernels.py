"""Values of topology-aware losses on dense probability and mask arrays."""

from __future__ import annotations

import numpy as np


def pooled(a: np.ndarray, height: int, width: int, low: bool = False) -> np.ndarray:
    """Greatest (or least) value of the window around each place; places outside do not count."""
    pick, fill = (np.minimum, np.inf) if low else (np.maximum, -np.inf)
    r, c = height // 2, width // 2
    wide = np.pad(a, ((r, r), (c, c)), constant_values=fill)
    rows = pick.reduce([wide[k : k + a.shape[0]] for k in range(height)])
    return pick.reduce([rows[:, k : k + a.shape[1]] for k in range(width)])


def _thinner(a: np.ndarray) -> np.ndarray:
    return np.minimum(pooled(a, 3, 1, low=True), pooled(a, 1, 3, low=True))


def soft_skeleton(a: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Centre lines of a soft mask: what an opening takes away, over ``rounds`` more erosions."""
    lines = np.zeros_like(a)
    for _ in range(rounds + 1):
        lost = np.maximum(a - pooled(_thinner(a), 3, 3), 0)
        lines = lines + np.maximum(lost - lines * lost, 0)
        a = _thinner(a)
    return lines


def dice_loss(p: np.ndarray, g: np.ndarray, smooth: float = 1.0) -> float:
    return float(1 - (2 * (p * g).sum() + smooth) / (p.sum() + g.sum() + smooth))


def cross_entropy(p: np.ndarray, g: np.ndarray, least: float = 1e-6) -> float:
    return float(-np.where(g > 0, np.log(np.maximum(p, least)), np.log(np.maximum(1 - p, least))).mean())


def centre_line_loss(p: np.ndarray, g: np.ndarray, rounds: int = 10, smooth: float = 1.0) -> float:
    """One less the harmonic mean of how far each side's centre lines lie on the other side."""
    shares = []
    for line, area in ((soft_skeleton(p, rounds), g), (soft_skeleton(g, rounds), p)):
        shares.append(((line * area).sum() + smooth) / (line.sum() + smooth))
    return float(1 - 2 * shares[0] * shares[1] / (shares[0] + shares[1]))


def lovasz_loss(logits: np.ndarray, g: np.ndarray) -> float:
    """The hinge errors in falling order, each weighed by what it takes from the intersection over union."""
    sign = 2.0 * g.ravel() - 1
    errors = 1 - logits.ravel() * sign
    order = np.argsort(-errors, kind="stable")
    truth = g.ravel()[order]
    total = truth.sum()
    lost = 1 - (total - np.cumsum(truth)) / (total + np.cumsum(1 - truth))
    return float(np.maximum(errors[order], 0) @ np.diff(lost, prepend=0.0))


#: Weights of the three combined losses.
COMBINED = {"dice": 0.5, "bce": 0.3, "connectivity": 0.2}
CENTRE_LINE = {"centre_line": 0.4, "dice": 0.4, "bce": 0.2}
LOVASZ = {"lovasz": 0.5, "plain_dice": 0.4, "connectivity": 0.1}


def all_losses(p: np.ndarray, g: np.ndarray) -> dict[str, float]:
    """Every loss of one tile; ``p`` are probabilities, their logits are cut at 1e-6 from 0 and 1."""
    safe = np.clip(p, 1e-6, 1 - 1e-6)
    out = {
        "dice": dice_loss(p, g), "bce": cross_entropy(p, g), "connectivity": dice_loss(pooled(p, 5, 5), pooled(g, 5, 5)),
        "centre_line": centre_line_loss(p, g), "lovasz": lovasz_loss(np.log(safe / (1 - safe)), g),
        "plain_dice": dice_loss(p, g, 0.0) if g.any() else 0.0,
    }
    for name, weights in (("combined", COMBINED), ("centre_line_combined", CENTRE_LINE), ("lovasz_combined", LOVASZ)):
        out[name] = sum(w * out[k] for k, w in weights.items())
    return out
