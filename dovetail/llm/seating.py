"""Chinese-restaurant seating of many dishes at once, sampled by Gibbs one customer at a time.

Each customer of a dish sits at a table; a table's size less the discount draws others.  A customer is taken out and
seated again given all others: at a table of the dish, or at a new one with the weight (strength + discount * tables of
the restaurant) * the parent's probability.  Customers of different restaurants are handled side by side.  A restaurant
of at most EXACT customers is one lane, so its number of tables is exact at each customer.  In larger ones each dish is a lane and the
number of tables follows after each step of all lanes (or, where the restaurant lies in several tasks, stays that of the last
round).  A sweep seats every customer again.

A dish of more than SCAN customers in a larger restaurant has all of them seated again at once: only its number of tables t
matters elsewhere, and that is drawn from its distribution given all other dishes (one dish of a restaurant after another),
the product of the weights of t openings times the generalised Stirling number of c and t.  That number is, but for c! / (t! d^t),
the probability that t independent sizes with generating function 1 - (1 - x)^d sum to c: by recursion up to NEAR
customers, beyond by an integral around the function's cut, whose error is near that of doubles.

Random numbers are hashes of the dish, the customer, the round and the draw, so a result doesn't depend on which
task holds a restaurant.
"""

from __future__ import annotations

import functools

import numpy as np

from dovetail.llm.text import U64, mix

EXACT, SCAN, NEAR = 256, 64, 512


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return (mix(key ^ U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))) >> U64(11)).astype(float) * 2.0**-53


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def thinned(t: np.ndarray, sizes: np.ndarray, to: np.ndarray, key: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables after random customers have left the dishes that have more than `to`."""
    dish = np.repeat(np.arange(len(t)), t)
    n = np.bincount(dish, sizes, minlength=len(t)).astype(np.int64)
    table = np.repeat(np.arange(len(sizes)), sizes)
    of = np.repeat(np.arange(len(t)), n)
    shrinks = (n > to)[of]
    if not shrinks.any():
        return t, sizes
    some, some_of = table[shrinks], of[shrinks]
    order = np.lexsort((uniform(key[some_of] + within(n[n > to]).astype(U64), salt), some_of))
    stays = within(n[n > to]) < np.repeat(to[n > to], n[n > to])
    left = np.concatenate([table[~shrinks], some[order][stays]])
    sizes = np.bincount(left, minlength=len(sizes))
    kept = sizes > 0
    return np.bincount(dish[kept], minlength=len(t)), sizes[kept]


def sums(last: int, n: int, d: float):
    """log P(t sizes sum to c) for t from 0 to n: a row for each c from 1 to `last`."""
    t, row = np.arange(1, n + 1), np.full(n + 1, -np.inf)
    row[1] = np.log(d)
    yield row
    for c in range(1, last):
        with np.errstate(divide="ignore"):
            row = np.append(-np.inf, np.logaddexp(np.log(t * d) + row[:-1], np.log(np.maximum(c - t * d, 0)) + row[1:]) - np.log(c + 1))
        yield row


@functools.lru_cache(4)
def near_sums(d: float) -> np.ndarray:
    return np.stack(list(sums(NEAR, NEAR, d)))


def far_sums(c: int, n: int, d: float) -> np.ndarray:
    """The last row of sums(c, n, d): an inverse Laplace transform along a cotangent contour (Trefethen, Weideman and
    Schmelzer 2006), wider for larger t, whose saddle point it has to pass; by recursion where it would come near the next cuts."""
    out, done, nodes = np.full(n + 1, -np.inf), 0, 24
    while done < n:
        if 0.17 * nodes > 0.05 * c:
            for row in sums(c, n, d):
                pass
            return row
        part = -np.expm1(-0.17 * nodes / c)  # where the contour crosses
        reach = int(min(n, (1 - part**d) * c / (d * part ** (d - 1) * (1 - part))))
        angle = (np.arange(nodes // 2) + 0.5) * 2 * np.pi / nodes
        bent = 0.6407 * angle
        z = nodes * (0.5017 * angle / np.tan(bent) - 0.6122 + 0.2645j * angle)
        along = nodes * (0.5017 / np.tan(bent) - 0.5017 * bent / np.sin(bent) ** 2 + 0.2645j)
        factor = np.log1p(-((-np.expm1(-z / c)) ** d))
        while done < reach:
            t = np.arange(done + 1, min(reach, done + 4096) + 1)
            power = z[:, None] + factor[:, None] * t
            top = power.real.max(0)
            total = (np.exp(power - top) * along[:, None]).imag.sum(0)
            out[t] = top + np.log(np.maximum(total, 1e-300)) + np.log(2 / nodes / c)
            done = int(t[-1])
        nodes *= 2
    return out


def drawn(c: np.ndarray, weight: np.ndarray, step: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of whole dishes of c customers, u being uniform: the table beside k others opens with the weight `weight` + step * k.

    Without the customers' part t is negative binomial, or Poisson; beyond `most` all that is left is below a double's precision."""
    mean = weight / (d - step)
    most = np.minimum(c, np.ceil(mean + 9 * np.sqrt(mean * d / (d - step)) + 40 / (1 - step / d)).astype(np.int64))
    t, wide, far = np.empty(len(c), np.int64), np.ceil(np.log2(most)).astype(np.int64), {}
    for level in np.unique(wide).tolist():
        of_level, n = np.flatnonzero(wide == level), 1 << level
        for lo in range(0, len(of_level), max(1, (1 << 19) // n)):
            rows = of_level[lo : lo + max(1, (1 << 19) // n)]
            k = np.arange(n)
            log_p = np.full((len(rows), n), -np.inf)
            near = c[rows] <= NEAR
            log_p[near, :NEAR] = near_sums(d)[c[rows][near] - 1, 1 : n + 1]
            for i in np.flatnonzero(~near).tolist():
                at = int(c[rows[i]]), min(n, int(c[rows[i]]))
                if at not in far:
                    far[at] = far_sums(*at, d)[1:]
                log_p[i, : at[1]] = far[at]
            log_p += np.cumsum(np.log((weight[rows, None] + step[rows, None] * k) / (d * (k + 1))), 1)
            p = np.cumsum(np.exp(log_p - log_p.max(1, keepdims=True)), 1)
            t[rows] = 1 + (p <= u[rows, None] * p[:, -1:]).sum(1)
    return t


def at_once(c: np.ndarray, rest: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Dishes that are drawn: those of more than SCAN customers, but in restaurants that are one lane."""
    return (c > SCAN) & ~(whole & (np.bincount(rest, c, minlength=len(whole)) <= EXACT))[rest]


class Seating:
    """Tables of dishes with c customers, c being at least 1; key: a hash of each dish; drawn: dishes that keep no table's size."""

    def __init__(self, c: np.ndarray, key: np.ndarray, t: np.ndarray | None = None, sizes: np.ndarray | None = None, drawn: np.ndarray | None = None) -> None:
        self.c, self.key = c.astype(np.int64), key
        self.drawn = np.zeros(len(c), bool) if drawn is None else drawn
        seats = np.where(self.drawn, 0, self.c)
        self.off = np.cumsum(seats) - seats
        total = int(seats.sum())
        self.t = np.zeros(len(c), np.int64) if t is None else t.astype(np.int64)
        self.n = np.zeros(len(c), np.int64)
        self.size, self.z = np.zeros(total, np.int32), np.zeros(total, np.int64)
        self.free = np.arange(total) + np.repeat(self.t, seats)
        if sizes is not None:
            seated = np.where(self.drawn, 0, self.t)
            dish = np.repeat(np.arange(len(c)), seated)
            label = self.off[dish] + within(seated)
            self.size[label] = sizes
            self.n = np.bincount(dish, sizes, minlength=len(c)).astype(np.int64)
            self.z[np.repeat(self.off, self.n) + within(self.n)] = np.repeat(label, sizes)

    def sizes(self) -> np.ndarray:
        return self.size[self.size > 0]

    def _joined(self, dish: np.ndarray, others: np.ndarray, skip: np.ndarray, key: np.ndarray, d: float, salt: int) -> np.ndarray:
        """A table for each by its size less the discount: that of a random other customer, taken or tried again."""
        out = np.empty(len(dish), np.int64)
        left, draw = np.arange(len(dish)), salt
        while len(left):
            i = dish[left]
            y = self.off[i] + (uniform(key[left], draw + 1) * others[left]).astype(np.int64)
            y += y >= skip[left]
            table = self.z[y]
            ok = uniform(key[left], draw + 2) * self.size[table] >= d
            out[left[ok]] = table[ok]
            left, draw = left[~ok], draw + 2
        return out

    def grow(self, weight: np.ndarray, d: float, salt: int) -> None:
        """Seats who is not seated yet, one after the other in each dish: where a chain starts."""
        at = np.flatnonzero(self.drawn)
        self.t[at] = drawn(self.c[at], weight[at], np.zeros(len(at)), d, uniform(self.key[at], salt))
        dish = np.flatnonzero(~self.drawn & (self.n < self.c))
        while len(dish):
            n, w = self.n[dish], weight[dish]
            place = self.off[dish] + n
            key = mix(self.key[dish] + n.astype(U64))
            new = (n == 0) | (uniform(key, salt) * (w + n - d * self.t[dish]) < w)
            table, old, fresh = np.empty(len(dish), np.int64), ~new, dish[new]
            table[old] = self._joined(dish[old], n[old], np.full(int(old.sum()), 1 << 62), key[old], d, salt)
            table[new] = self.free[self.off[fresh] + self.c[fresh] - self.t[fresh] - 1]
            self.t[fresh] += 1
            self.z[place] = table
            self.size[table] += 1
            self.n[dish] += 1
            dish = dish[self.n[dish] < self.c[dish]]

    def sweep(self, rest: np.ndarray, tables: np.ndarray, whole: np.ndarray, parent: np.ndarray, less: np.ndarray, d: float, strength: float, salt: int) -> None:
        """Seats all customers again, one by one in each lane, then those of drawn dishes.  rest: each dish's restaurant (ascending); tables: of each
        restaurant, updated where it is whole here; parent, less: each dish's probability there, and without one of its
        customers, which holds when the customer's own table has gone."""
        self._lanes(rest, tables, whole, parent, less, d, strength, salt)
        at = np.flatnonzero(self.drawn)
        turn = np.where(whole[rest[at]], within(np.bincount(rest[at])), 0)
        for k in range(int(turn.max(initial=-1)) + 1):
            i = at[turn == k]
            r, t = rest[i], self.t[i]
            own = np.where(whole[r], t, 0)
            step = np.where(whole[r], d * parent[i], 0.0)
            self.t[i] = drawn(self.c[i], (strength + d * (tables[r] - own)) * parent[i], step, d, uniform(self.key[i], salt))
            tables[r] += np.where(whole[r], self.t[i] - t, 0)

    def _lanes(self, rest: np.ndarray, tables: np.ndarray, whole: np.ndarray, parent: np.ndarray, less: np.ndarray, d: float, strength: float, salt: int) -> None:
        several = np.flatnonzero((self.c > 1) & ~self.drawn)
        if not len(several):
            return
        customers = np.bincount(rest[several], self.c[several], minlength=len(tables)).astype(np.int64)
        small = whole & (customers <= EXACT)
        alone = several[~small[rest[several]]]
        rows = several[small[rest[several]]]  # dishes of small restaurants: their customers in one lane
        at = np.repeat(self.off[rows], self.c[rows]) + within(self.c[rows])
        lane_sizes = customers[small & (customers > 0)]
        starts = np.concatenate([np.cumsum(lane_sizes) - lane_sizes, len(at) + np.arange(len(alone))])
        long = np.concatenate([lane_sizes, self.c[alone]])
        own = np.concatenate([np.zeros(len(lane_sizes), np.int64), self.c[alone]])  # 0: in order
        dish_at = np.concatenate([np.repeat(rows, self.c[rows]), alone])
        at = np.concatenate([at, self.off[alone]])
        order = np.argsort(-long, kind="stable")
        starts, long, own = starts[order], long[order], own[order]
        active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), "left")
        for k, m in enumerate(active.tolist()):
            first, dish_lane = starts[:m], own[:m]
            step = np.where(dish_lane > 0, 0, k)
            dish, x = dish_at[first + step], at[first + step]
            key = mix(self.key[dish] + (x - self.off[dish]).astype(U64) + U64((k + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
            x = np.where(dish_lane > 0, self.off[dish] + k, x)
            table = self.z[x]
            self.size[table] -= 1
            empty = self.size[table] == 0
            gone = dish[empty]
            self.free[self.off[gone] + self.c[gone] - self.t[gone]] = table[empty]
            self.t[gone] -= 1
            r = rest[dish]
            others, t = self.c[dish] - 1, self.t[dish]
            w = (strength + d * (tables[r] - empty)) * np.where(empty, less[dish], parent[dish])
            new = uniform(key, salt) * (w + others - d * t) < w
            old = ~new
            table = np.empty(m, np.int64)
            table[old] = self._joined(dish[old], others[old], x[old], key[old], d, salt)
            fresh = dish[new]
            table[new] = self.free[self.off[fresh] + self.c[fresh] - self.t[fresh] - 1]
            self.t[fresh] += 1
            self.z[x] = table
            self.size[table] += 1
            change = new.astype(np.int64) - empty
            moved = (change != 0) & whole[r]
            np.add.at(tables, r[moved], change[moved])
