"""Width of vectors over a vocabulary: a padded capacity that grows by half, from 1."""

from __future__ import annotations

import math


def capacity(n: int) -> int:
    """The first of 1, 2, 3, 5, 8, 12, 18, ... that holds n positions: each is the last times 1.5, halves rounded up."""
    width = 1
    while width < n:
        width = (3 * width + 1) // 2
    return width


def resized(live: int, width: int) -> int:
    """The capacity after values came or went: it grows by half while too small, and shrinks to 0.66 while less than that is used."""
    while width < live:
        width = (3 * width + 1) // 2
    while live < math.floor(0.66 * width):
        width = math.ceil(0.66 * width)
    return width
