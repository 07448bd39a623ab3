"""Interval arithmetic on the driver: how a branch's coordinates are split at a fork or checkpoint.

A child's width comes from the first policy of POLICIES that speaks for the case; whatever it asks
for, the branch keeps room of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

# Size of the coordinate domains, share of its bits reserved at the first three
# depths, least widths, and how many unknown children a deep branch plans for.
LONG_DOMAIN = 9_000_000_000_000_000_000
DECIMAL_DOMAIN = 10**31
RESERVE_RATIOS = ((5, 16), (5, 32), (3, 32))
HARMONIC_RESERVE = 8
LEAST_SPLIT = 2
LEAST_FORK = 5
#: Of an only child's parent: least room it keeps, and the part of its room.
KEPT_LEAST, KEPT_PART = 8, 256


class IntervalExhausted(RuntimeError):
    """A branch has no room for another child."""


def reserve_bits(bits: int = 0, decimal: bool = False) -> tuple[int, int, int]:
    """Bits that the first three depths keep back of a domain, each rounded up."""
    if bits < 0:
        raise ValueError("a coordinate width can't be negative")
    if bits == 0:
        bits = ((DECIMAL_DOMAIN if decimal else LONG_DOMAIN) - 1).bit_length()
    return tuple(max(1, (bits * part + whole - 1) // whole) for part, whole in RESERVE_RATIOS)


@dataclass(frozen=True)
class Request:
    """One fork: room free now and at first in the branch, its depth, what it has and expects."""

    free: int
    first: int
    depth: int
    children: int
    expected: int
    terminal: bool
    fixed: int | None


def _only_child(a: Allocator, r: Request) -> int:
    """Nearly all, where that leaves a child anything; else half."""
    most = r.free - max(KEPT_LEAST, r.free // KEPT_PART)
    return most if most >= LEAST_SPLIT else r.free // 2


#: (the case, width asked for), in order of precedence.
POLICIES: tuple[tuple[Callable[[Request], bool], Callable[[Allocator, Request], int]], ...] = (
    (lambda r: r.terminal, lambda a, r: LEAST_SPLIT),
    (lambda r: bool(r.fixed), lambda a, r: r.fixed),
    (lambda r: r.expected == 1, _only_child),
    (lambda r: r.depth < len(RESERVE_RATIOS), lambda a, r: r.first >> a.reserve[r.depth]),
    (lambda r: r.expected > 1, lambda a, r: r.first // (r.expected + 1)),
    (lambda r: True, lambda a, r: a.share(r.free, r.children)),
)


@dataclass(frozen=True)
class Allocator:
    """Widths of children and checkpoints."""

    reserve: tuple[int, int, int] = reserve_bits()
    harmonic: int = HARMONIC_RESERVE

    def __post_init__(self):
        shrinking = all(x >= y for x, y in zip(self.reserve, self.reserve[1:]))
        if len(self.reserve) != len(RESERVE_RATIOS) or not shrinking or any(x < 1 for x in self.reserve):
            raise ValueError("reserve must be three positive, non-increasing bit counts")

    def share(self, free: int, taken: int) -> int:
        """An equal part of the room for each sibling so far, this one and those still planned for."""
        return free // (self.harmonic + taken + 1)

    def child_width(self, width: int, first_width: int, depth: int, children: int, fanout: int = 0, terminal: bool = False, fixed: int | None = None) -> int:
        if fanout < 0 or fixed is not None and fixed < LEAST_SPLIT:
            raise ValueError(f"a fanout can't be negative, and a child needs a width of {LEAST_SPLIT} at least")
        r = Request(width - 1, first_width - 1, depth, children, fanout, terminal, fixed)
        if width < LEAST_FORK:
            raise IntervalExhausted("no room for another branch")
        asked = next(policy(self, r) for speaks, policy in POLICIES if speaks(r))
        granted = asked if asked + LEAST_SPLIT <= r.free else r.free // 2
        if granted < LEAST_SPLIT:
            raise IntervalExhausted("no room for another branch")
        return granted

    def checkpoint_width(self, width: int, checkpoints: int) -> int:
        free = width - 1
        granted = min(self.share(free, checkpoints), free - LEAST_SPLIT)
        if granted < LEAST_SPLIT:
            raise IntervalExhausted("no room for another checkpoint")
        return granted
