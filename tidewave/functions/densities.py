"""Sums of Gaussians of any number of points on a line, to about rounding.

The line is cut into cells as wide as the Gaussians. Inside a cell exp(-(x - y)^2 / 2) is
a polynomial of either side (Greengard and Strain 1991; here by Chebyshev's, of degree
``TERMS`` - 1), so the points of a cell count by ``TERMS`` moments, which add up over
tasks, and a sum at y is a polynomial of y's cell. What is further than ``REACH`` cells
away adds less than 1e-21 for each point.
"""

from __future__ import annotations

import numpy as np

TERMS, REACH = 16, 10
_NODES = np.cos(np.pi * (np.arange(TERMS) + 0.5) / TERMS)
#: Terms by nodes: from moments to weights of the nodes, and transposed from values at the nodes to terms.
_TURN = np.polynomial.chebyshev.chebvander(_NODES, TERMS - 1).T * np.where(np.arange(TERMS) > 0, 2, 1)[:, None] / TERMS


def bandwidth(deviation: np.ndarray | float, points: np.ndarray | int) -> np.ndarray | float:
    """Of Parzen windows (Silverman's rule for the normal distribution)."""
    return np.maximum(1e-9, deviation * (4 / (3 * np.maximum(2, points))) ** 0.2)


def placed(x: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell, terms) of each point."""
    at = x / width
    cell = np.floor(at)
    return cell.astype(np.int64), np.polynomial.chebyshev.chebvander(2 * (at - cell) - 1, TERMS - 1)


def summed(cell: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, in order, with the sum of its terms."""
    if not len(cell):
        return cell, terms
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[start], np.add.reduceat(terms[order], start)


def spread(cell: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, polynomial) of the sum of the Gaussians whose ``moments`` are given by cell; it is 0 in all other cells."""
    weights, near = moments @ _TURN, np.arange(-REACH, REACH + 1)
    own = np.unique(cell[:, None] + near)
    values = np.zeros((len(own), TERMS))
    for o in near:
        kernel = np.exp(-((o + (_NODES[None] - _NODES[:, None]) / 2) ** 2) / 2)
        values[np.searchsorted(own, cell + o)] += weights @ kernel
    return own, values @ _TURN.T


def at(x: np.ndarray, width: float, cell: np.ndarray, polynomial: np.ndarray) -> np.ndarray:
    """The sum of Gaussians at each point, by what ``spread`` gave."""
    if not len(cell):
        return np.zeros(len(x))
    own, terms = placed(x, width)
    k = np.minimum(np.searchsorted(cell, own), len(cell) - 1)
    return np.where(cell[k] == own, np.maximum(0, np.einsum("ij,ij->i", terms, polynomial[k])), 0.0)
