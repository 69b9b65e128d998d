"""Seatings of Chinese restaurants, many dishes at once.

A dish's customers sit at tables.  One who enters opens a table with weight `opens` and joins one
of n customers with weight n - discount.  In a round of a sweep a share of a dish's
customers, drawn at random, leaves and is seated again; there are as many rounds as moves that a
dish's customers have beside one that stays, ROUNDS at most.  The share is one customer for dishes
of up to ROUNDS, which is the Gibbs sampler proper; of more customers ROUNDS shares leave one after
the other, and those of one share are seated side by side, given the ones that stay.  A share's
customers are drawn systematically: a random start and equal steps through the tables' weights,
which for one customer is a plain draw.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ROUNDS = 16
#: opens(dishes, more): the weights of a new table, with `more` tables than the pass began with.
Opens = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _drawn(weights: np.ndarray, tables: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each dish's tables, how often it is drawn when `n` draws go through the dish's weights in equal steps."""
    ends = np.cumsum(tables)
    total = np.cumsum(weights)
    last = total[ends - 1]
    before = np.concatenate([[0.0], last[:-1]])
    step = n / np.maximum(last - before, 1e-300)
    up_to = np.ceil((total - np.repeat(before, tables)) * np.repeat(step, tables) - np.repeat(start, tables))
    most = np.repeat(n, tables)
    up_to = np.clip(up_to, 0, most)
    up_to[ends - 1] = n
    drawn = np.diff(up_to, prepend=0)
    begins = ends - tables
    drawn[begins] = up_to[begins]
    return np.maximum(drawn, 0).astype(np.int64)


class Seating:
    """tables: how many each dish has, one at least; sizes: of all tables, dish after dish."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray):
        self.tables, self.sizes = np.asarray(tables, dtype=np.int64), np.asarray(sizes, dtype=np.int64)

    @classmethod
    def started(cls, customers: np.ndarray) -> Seating:
        """All customers of a dish at one table; a dish without customers has an empty one."""
        return cls(np.ones(len(customers), dtype=np.int64), customers)

    @property
    def customers(self) -> np.ndarray:
        return np.add.reduceat(self.sizes, np.cumsum(self.tables) - self.tables) if len(self.tables) else np.empty(0, dtype=np.int64)

    def ordered(self, order: np.ndarray) -> Seating:
        """The dishes in another order."""
        begins, tables = (np.cumsum(self.tables) - self.tables)[order], self.tables[order]
        at = np.arange(len(self.sizes)) + np.repeat(begins - (np.cumsum(tables) - tables), tables)
        return Seating(tables, self.sizes[at])

    def left(self, n: np.ndarray, random: np.random.Generator) -> Seating:
        """After n customers of each dish, fewer than it has, have left."""
        sizes = self.sizes - _drawn(self.sizes.astype(np.float64), self.tables, n, random.random(len(n)))
        stays = (sizes > 0) | (self.sizes == 0)
        begins = np.cumsum(self.tables) - self.tables
        return Seating(np.add.reduceat(stays.astype(np.int64), begins), sizes[stays])

    def joined(self, n: np.ndarray, opens: np.ndarray, discount: float, random: np.random.Generator) -> Seating:
        """After n customers have come to each dish."""
        room = self.customers - discount * self.tables
        new = np.minimum(np.floor(n * opens / (opens + room) + random.random(len(n))), n).astype(np.int64)
        sizes = self.sizes + _drawn(self.sizes - discount, self.tables, n - new, random.random(len(n)))
        if new.any():
            sizes = np.insert(sizes, np.repeat(np.cumsum(self.tables), new), 1)
        return Seating(self.tables + new, sizes)

    def _rounds(self, customers: np.ndarray, shares: Callable[[np.ndarray, int], np.ndarray], opens: Opens, begun: np.ndarray, discount: float, random: np.random.Generator, leave: bool) -> Seating:
        """Rounds over dishes by falling number of customers, until `shares` (of those numbers and the round's) names no dish any more."""
        order = np.argsort(-customers, kind="stable")
        count, begun, now, rest, number = customers[order], begun[order], self.ordered(order), [], 0
        while len(n := shares(count, number)):
            live = len(n)
            if live < len(now.tables):  # the others are done with
                cut = int(now.tables[:live].sum())
                rest.append((now.tables[live:], now.sizes[cut:]))
                now = Seating(now.tables[:live], now.sizes[:cut])
            if leave:
                now = now.left(n, random)
            now = now.joined(n, opens(order[:live], now.tables - begun[:live]), discount, random)
            number += 1
        rest.append((now.tables, now.sizes))
        tables, sizes = (np.concatenate([x[i] for x in reversed(rest)]) for i in (0, 1))
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return Seating(tables, sizes).ordered(back)

    def seated(self, opens: Opens, discount: float, random: np.random.Generator) -> Seating:
        """The same customers from the door, one after the other, in shares of an eighth of those inside once there are that many."""
        inside = [1]  # before each round

        def shares(count: np.ndarray, number: int) -> np.ndarray:
            if number:
                inside.append(inside[-1] + max(1, inside[-1] // 8))
            live = int(np.searchsorted(-count, -inside[-1], side="left"))
            return np.minimum(count[:live] - inside[-1], max(1, inside[-1] // 8))

        ones = np.ones(len(self.tables), dtype=np.int64)
        return Seating(ones, np.minimum(self.customers, 1))._rounds(self.customers, shares, opens, ones, discount, random, False)

    def swept(self, opens: Opens, discount: float, random: np.random.Generator, begun: np.ndarray | None = None) -> Seating:
        """After a sweep. begun: the tables that each dish had when the sums behind `opens` were made, now if not given."""

        def shares(count: np.ndarray, number: int) -> np.ndarray:
            live = int(np.searchsorted(-count, -number - 1, side="left")) if number < ROUNDS else 0  # those of more than number + 1
            return (count[:live] - number + ROUNDS - 1) // ROUNDS

        return self._rounds(self.customers, shares, opens, self.tables if begun is None else begun, discount, random, True)

    def with_customers(self, customers: np.ndarray, opens: Opens, discount: float, random: np.random.Generator) -> Seating:
        """After some have left or come, so that each dish has as many as given."""
        now = self.customers
        out = self.left(np.maximum(now - customers, 0), random) if (now > customers).any() else self
        come = np.maximum(customers - now, 0)
        return out.joined(come, opens(np.arange(len(come)), out.tables - self.tables), discount, random) if come.any() else out
