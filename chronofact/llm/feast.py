"""Eigenpairs of a symmetric matrix inside an interval, by contour integration.

A circle is laid round an interval of the real axis. Solves with the matrix
shifted by the quadrature nodes of the circle add up to a projection onto the
eigenvectors inside; Rayleigh-Ritz extracts them, and the projection is
repeated until they are exact. How many lie in an interval is known beforehand
from the signs of the pivots of shifted factorisations, so none is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Gauss points on the upper half of the circle; the lower half is its mirror.
NODES = 8
ROUNDS = 40
#: Eigenvalues that an interval should hold at most.
MOST = 12
#: The ends of an interval differ by this factor at most, so that small eigenvalues are far enough from the circle.
WIDE = 1_000.0
SEED = 7


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` lie above ``shift``.

    By Sylvester's law, the positive pivots of a factorisation with complete
    pivoting in blocks of one or two.
    """
    a = matrix - shift * np.eye(len(matrix))
    found = 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        size = np.abs(a)
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        p, q = divmod(int(size.argmax()), len(a))
        if size[p, q] == 0:
            break
        if diagonal[k] >= alpha * size[p, q]:
            order = [k, *[i for i in range(len(a)) if i != k]]
            a = a[np.ix_(order, order)]
            found += a[0, 0] > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / a[0, 0])
        else:  # two pivots of opposite sign
            order = [p, q, *[i for i in range(len(a)) if i not in (p, q)]]
            a = a[np.ix_(order, order)]
            found += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return int(found)


@dataclass(frozen=True)
class Interval:
    """``low < eigenvalue <= high`` holds ``count`` eigenvalues; ``above`` lie higher."""

    low: float
    high: float
    count: int
    above: int


def plan(matrix: np.ndarray, wanted: int, least: float = 1e-12, most: int = MOST) -> list[Interval]:
    """Intervals that hold the ``wanted`` largest eigenvalues, halved until each holds at most ``most``.

    Eigenvalues not above the share ``least`` of the largest row sum are left out: rounding may have made them.

    An interval of equal eigenvalues can't be halved and stays as it is, once
    it is narrower than rounding allows to tell them apart.
    """
    bound = float(np.abs(matrix).sum(1).max()) if len(matrix) else 0.0
    if not bound:
        return []
    done, todo = [], [Interval(least * bound, 1.01 * bound, eigenvalues_above(matrix, least * bound), 0)]
    while todo:
        now = todo.pop()
        wide = now.high > WIDE * now.low
        middle = (now.low * now.high) ** 0.5 if wide else (now.low + now.high) / 2
        if now.count == 0 or now.above >= wanted:
            continue
        if (now.count <= most and not wide and now.above + now.count <= wanted + most) or now.high - now.low < 1e-11 * bound:
            done.append(now)
            continue
        above = eigenvalues_above(matrix, middle)
        todo += [Interval(middle, now.high, above - now.above, now.above), Interval(now.low, middle, now.above + now.count - above, above)]
    return sorted(done, key=lambda i: i.above)


def solve(matrix: np.ndarray, interval: Interval, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of ``interval``, falling, and their unit vectors as columns.

    Raises ``ArithmeticError`` if the rounds find another number than the interval holds.
    """
    n, scale = len(matrix), float(np.abs(matrix).sum(1).max())
    centre, radius = (interval.low + interval.high) / 2, max((interval.high - interval.low) / 2, 1e-13 * scale)
    points, weights = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi / 2 * (points + 1)
    shifts = centre + radius * np.exp(1j * angles)
    inverses = [np.linalg.inv(z * np.eye(n) - matrix) for z in shifts]
    basis = np.random.default_rng(SEED).normal(size=(n, min(n, interval.count * 2 + 8)))
    before = None
    for _ in range(rounds):
        projected = np.zeros_like(basis)
        for angle, weight, inverse in zip(angles, weights, inverses, strict=True):
            projected += (weight / 2) * (radius * np.exp(1j * angle) * (inverse @ basis)).real
        basis, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ inner
        # nodes as close as rounding count as inside, so ask for the closest to the centre
        inside = np.sort(np.argsort(np.abs(values - centre), kind="stable")[:interval.count])[::-1]
        left = np.abs(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside]).max(initial=0.0)
        if left <= 1e-13 * scale or (before is not None and left >= before / 2 and left <= 1e-11 * scale):
            kept = values[inside]
            slack = 1e-10 * scale
            if len(kept) == interval.count and (kept >= interval.low - slack).all() and (kept <= interval.high + slack).all():
                return kept, vectors[:, inside]
        before, basis = left, vectors
    raise ArithmeticError(f"{interval.count} eigenvalues between {interval.low} and {interval.high} were not found")


def solved(matrix: np.ndarray, interval: Interval) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`solve`; an interval that resists is halved, and both halves are counted and solved anew."""
    try:
        return solve(matrix, interval)
    except ArithmeticError:
        middle = (interval.low + interval.high) / 2
        if not interval.low < middle < interval.high or interval.high - interval.low < 1e-13 * np.abs(matrix).max():
            raise
        above = eigenvalues_above(matrix, middle) - interval.above
        halves = [Interval(middle, interval.high, above, interval.above),
                  Interval(interval.low, middle, interval.count - above, interval.above + above)]
        found = [solved(matrix, h) for h in halves if h.count]
        return np.concatenate([v for v, _ in found]), np.concatenate([w for _, w in found], 1)


def largest(parts: list[tuple[np.ndarray, np.ndarray]], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of all intervals, falling; each vector's largest entry is positive."""
    values = np.concatenate([v for v, _ in parts])
    vectors = np.concatenate([w for _, w in parts], 1)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[:, order]
    # neighbouring intervals are orthogonal but for rounding
    vectors, upper = np.linalg.qr(vectors)
    vectors = vectors * np.sign(np.diag(upper))
    heads = vectors[np.abs(vectors).argmax(0), np.arange(len(order))]
    return values[order], vectors * np.where(heads < 0, -1.0, 1.0)
