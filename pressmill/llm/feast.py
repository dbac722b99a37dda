"""The largest eigenpairs of a symmetric matrix by contour integration (FEAST).

The spectrum is cut into intervals by inertia: the number of negative pivots of a
shifted matrix is the number of its eigenvalues below the shift. For each interval a
quadrature of complex shifted solves around it projects a random subspace onto the
eigenvectors inside, Rayleigh-Ritz extracts the pairs, and both steps repeat until
the residuals are those of double precision. An interval is done when it has as
many pairs as its inertia counts say, so none is missed.
"""

from __future__ import annotations

import numpy as np

NODES = 8
TOGETHER = 8
ROUNDS = 60
PIVOT = (1 + 17**0.5) / 8


def negatives(matrix: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix, from a pivoted LDL' factorisation."""
    a = np.array(matrix, dtype=float)
    size, at, found = len(a), 0, 0

    def swap(one: int, other: int) -> None:
        a[[one, other], :] = a[[other, one], :]
        a[:, [one, other]] = a[:, [other, one]]

    while at < size:
        below = np.abs(a[at + 1 :, at])
        largest = below.max(initial=0.0)
        two = False
        if largest > 0 and abs(a[at, at]) < PIVOT * largest:
            row = at + 1 + int(below.argmax())
            others = np.abs(a[row, at:]).copy()
            others[row - at] = 0
            if abs(a[at, at]) * others.max() < PIVOT * largest**2:
                two = abs(a[row, row]) < PIVOT * others.max()
                swap(at + two, row)
        width = 2 if two else 1
        block, rest = a[at : at + width, at : at + width], slice(at + width, None)
        found += int((np.linalg.eigvalsh(block) < 0).sum())
        if block.any():
            side = a[rest, at : at + width]
            a[rest, rest] -= side @ np.linalg.solve(block, side.T)
        at += width
    return found


class Spectrum:
    """Counts of eigenvalues of one matrix below shifts."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.size = matrix, len(matrix)
        self.scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        self.seen: dict[float, int] = {}

    def below(self, shift: float) -> int:
        if shift not in self.seen:
            self.seen[shift] = negatives(self.matrix - shift * np.eye(self.size))
        return self.seen[shift]

    def lowest_edge(self, count: int, floor: float) -> float:
        """A shift with at least ``count`` eigenvalues above it and as few as bisection finds."""
        low, high = floor, 1.01 * self.scale
        while self.size - self.below(low) > count and high - low > 1e-9 * self.scale:
            middle = (low + high) / 2
            low, high = (middle, high) if self.size - self.below(middle) >= count else (low, middle)
        return self.between(low, floor, 1.01 * self.scale)

    def between(self, shift: float, low: float, high: float) -> float:
        """A shift about half way between the eigenvalues around ``shift``, from ``low`` to ``high``."""
        count, ends = self.below(shift), []
        for far in (low, high):
            near = shift
            for _ in range(12):
                middle = (near + far) / 2
                near, far = (middle, far) if self.below(middle) == count else (near, middle)
            ends.append(near)
        return sum(ends) / 2

    def intervals(self, low: float, high: float) -> list[tuple[float, float, int]]:
        """Adjoining intervals from ``low`` to ``high`` with their counts, at most ``TOGETHER`` each where they can be told apart."""
        count = self.below(high) - self.below(low)
        if count <= TOGETHER:
            return [(low, high, count)] if count else []
        first, last = low, high
        while last - first > 1e-9 * self.scale:
            middle = (first + last) / 2
            under = self.below(middle) - self.below(low)
            if 0 < under < count:
                middle = self.between(middle, low, high)
                return self.intervals(low, middle) + self.intervals(middle, high)
            first, last = (middle, last) if under == 0 else (first, middle)
        return [(low, high, count)]

    def inside(self, low: float, high: float, count: int) -> np.ndarray:
        """Orthonormal eigenvectors of the eigenvalues from ``low`` to ``high``."""
        points, weights = np.polynomial.legendre.leggauss(NODES)
        angles = np.exp(1j * np.pi / 2 * (1 - points))
        centre, radius = (low + high) / 2, (high - low) / 2
        wide = count + max(4, count // 2)
        for _ in range(4):
            wide = min(wide, self.size)
            vectors = np.random.default_rng(self.size).standard_normal((self.size, wide))
            solves = [np.linalg.inv((centre + radius * angle) * np.eye(self.size) - self.matrix) for angle in angles]
            best = np.inf
            for _ in range(ROUNDS):
                projected = sum(
                    (weight / 2 * radius * angle * (solve @ vectors)).real for weight, angle, solve in zip(weights, angles, solves, strict=True)
                )
                basis, _ = np.linalg.qr(projected)
                values, turned = np.linalg.eigh(basis.T @ self.matrix @ basis)
                vectors = basis @ turned
                held = (values > low) & (values <= high)
                residual = np.abs(self.matrix @ vectors[:, held] - vectors[:, held] * values[held]).max(initial=0.0)
                if held.sum() == count and (residual <= 1e-15 * self.scale or (residual < 1e-13 * self.scale and residual > 0.7 * best)):
                    return vectors[:, held]
                best = residual if held.sum() == count else np.inf
            wide *= 2
        raise ArithmeticError(f"{count} eigenvalues between {low} and {high} didn't all converge")


def largest_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues that are zero to double precision are left out. The largest entry of
    each vector is positive.
    """
    spectrum = Spectrum(np.asarray(matrix, dtype=float))
    floor = spectrum.size * 2e-15 * spectrum.scale
    count = min(count, spectrum.size - spectrum.below(floor)) if spectrum.scale else 0
    if count <= 0:
        return np.zeros(0), np.zeros((spectrum.size, 0))
    low, high = spectrum.lowest_edge(count, floor), 1.01 * spectrum.scale
    found = [spectrum.inside(*one) for one in spectrum.intervals(low, high)]
    basis, _ = np.linalg.qr(np.concatenate(found, axis=1))
    if basis.shape[1] != spectrum.size - spectrum.below(low):
        raise ArithmeticError("eigenvalues were missed")
    values, turned = np.linalg.eigh(basis.T @ spectrum.matrix @ basis)
    order = np.argsort(-values)[:count]
    vectors = basis @ turned[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)])
    return values[order], vectors * signs
