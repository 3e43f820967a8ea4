"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The number of eigenvalues below a shift is the number of negative pivots in the LDL^T factors of the shifted matrix
(Sylvester's law of inertia). Bisection on these counts isolates each leading eigenvalue, Rayleigh quotient iteration
finds it and its vector, and two more counts certify that the value found has the number asked for.
"""

from __future__ import annotations

import numpy as np

PIVOT = (1 + 17**0.5) / 8  # limit of growth for pivots of one and two rows (Bunch and Kaufman)
EPS = np.finfo(float).eps


def negative_pivots(matrix: np.ndarray) -> int:
    """Negative eigenvalues, from the diagonal blocks of LDL^T with symmetric pivoting."""
    a = np.array(matrix, float)
    n, at, negative = len(a), 0, 0
    dust = np.abs(a).max(initial=0.0) * EPS**4

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while at < n:
        below = np.abs(a[at + 1 :, at])
        largest = below.max(initial=0.0)
        if max(abs(a[at, at]), largest) <= dust:  # an eigenvalue of zero
            at += 1
            continue
        size = 1
        if abs(a[at, at]) < PIVOT * largest:
            row = at + 1 + int(below.argmax())
            others = np.abs(a[row, at:])
            others[row - at] = 0
            if abs(a[at, at]) * others.max() < PIVOT * largest * largest:
                if abs(a[row, row]) >= PIVOT * others.max():
                    swap(at, row)
                else:
                    swap(at + 1, row)
                    size = 2
        if size == 1:
            pivot = a[at, at]
            negative += int(pivot < 0)
            column = a[at + 1 :, at]
            change = np.outer(column, column) / pivot
        else:
            block, rest = a[at : at + 2, at : at + 2], a[at + 2 :, at : at + 2]
            negative += 1  # such a block has one eigenvalue of each sign
            change = rest @ np.linalg.solve(block, rest.T)
        at += size
        a[at:, at:] -= (change + change.T) / 2
    return negative


class Slicer:
    def __init__(self, matrix: np.ndarray, floor: float = 0.0):
        self.matrix = (matrix + matrix.T) / 2
        self.size = len(matrix)
        self.eye = np.eye(self.size)
        self.reach = float(np.abs(self.matrix).sum(axis=1).max(initial=0.0))  # all eigenvalues lie within it
        self.nested = floor > 0
        self.floor = max(floor, 8 * self.size * EPS * self.reach)  # rounding of the matrix itself

    def above(self, shift: float) -> int:
        """Number of eigenvalues at or above the shift."""
        return self.size - negative_pivots(self.matrix - shift * self.eye)

    def solve(self, shift: float, rows: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(self.matrix - shift * self.eye, rows)
        except np.linalg.LinAlgError:
            return np.linalg.solve(self.matrix - (shift + (self.floor or 1.0)) * self.eye, rows)

    def isolate(self, number: int, width: float) -> tuple[float, float, int, int]:
        """Bounds around the eigenvalue of this number (from 1), with the counts above both.

        Ends when no other eigenvalue lies between them, or when they are no farther apart than ``width``.
        """
        low, high = -self.reach - self.floor, self.reach + self.floor
        n_low, n_high = self.size, 0
        while n_low - n_high > 1 and high - low > width:
            middle = (low + high) / 2
            n = self.above(middle)
            if n >= number:
                low, n_low = middle, n
            else:
                high, n_high = middle, n
        return low, high, n_low, n_high

    def narrow(self, number: int, low: float, high: float, times: int) -> tuple[float, float]:
        for _ in range(times):
            middle = (low + high) / 2
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    def pair(self, number: int, low: float, high: float, found: np.ndarray) -> tuple[float, np.ndarray]:
        """The single eigenvalue between the bounds and its unit vector, orthogonal to the rows found before."""
        start = np.random.default_rng(number).standard_normal(self.size)
        while True:
            vector, shift = start, (low + high) / 2
            for step in range(12):
                vector = self.solve(shift, vector)
                vector -= found.T @ (found @ vector)
                vector /= np.linalg.norm(vector)
                image = self.matrix @ vector
                quotient = float(vector @ image)
                error = float(np.linalg.norm(image - quotient * vector))
                if not low - self.floor <= quotient <= high + self.floor and step > 1:
                    break  # on its way to another eigenvalue
                if error <= self.floor / 16 or (error <= self.floor and step > 5):
                    margin = 2 * self.floor
                    if self.above(quotient - margin) >= number > self.above(quotient + margin):
                        return quotient, vector
                    break
                if step > 0:
                    shift = quotient
            if high - low <= self.floor:
                return quotient, vector
            low, high = self.narrow(number, low, high, 4)

    def cluster(self, low: float, high: float, count: int, found: np.ndarray) -> tuple[list[float], np.ndarray]:
        """Orthonormal vectors of eigenvalues that lie too close together to be told apart by their quotients."""
        middle = (low + high) / 2
        rows = np.random.default_rng(count).standard_normal((self.size, count))
        for _ in range(4):
            rows = self.solve(middle, rows)
            for _ in range(2):
                rows -= found.T @ (found @ rows)
                rows = np.linalg.qr(rows)[0]
        inner = rows.T @ (self.matrix - middle * self.eye) @ rows
        if self.nested or self.floor == 0:  # equal to within rounding: any basis will do
            values, turn = np.diag(inner), np.eye(count)
        else:
            values, turn = Slicer(inner, self.floor).leading(count)
        order = np.argsort(-np.asarray(values), kind="stable")
        return [middle + float(values[k]) for k in order], (rows @ turn.T[:, order]).T

    def leading(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest eigenvalues, falling, and their unit vectors as rows."""
        count = min(count, self.size)
        values: list[float] = []
        vectors = np.zeros((0, self.size))
        width = max(self.floor, 1e-9 * self.reach)
        while len(values) < count:
            number = len(values) + 1
            low, high, n_low, n_high = self.isolate(number, width)
            if n_low - n_high == 1:
                value, vector = self.pair(number, low, high, vectors)
                more, rows = [value], vector[None]
            else:
                low, high = low - width, high + width  # a bound can stand on an eigenvalue
                n_low, n_high = max(n_low, self.above(low)), min(n_high, self.above(high), len(values))
                more, rows = self.cluster(low, high, n_low - len(values), vectors)
            values += more
            vectors = np.concatenate([vectors, rows])
        return np.array(values[:count]), vectors[:count]


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit vectors as rows; the largest entry of each vector is positive."""
    values, vectors = Slicer(matrix).leading(count)
    if len(vectors):
        at = np.abs(vectors).argmax(axis=1)
        vectors = vectors * np.where(vectors[np.arange(len(vectors)), at] < 0, -1.0, 1.0)[:, None]
    return values, vectors
