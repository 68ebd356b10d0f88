"""The nearest rows of a block of queries in a block of rows, for tasks: scores by matrix product in single precision, then exactly for those that may be among the best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows and queries of one matrix product, and pairs scored exactly at once.
ROWS, QUERIES, PAIRS = 2048, 1024, 65_536
#: Norms within which products neither overflow nor lose digits; beyond, a row is scored exactly against every query.
SMALL, LARGE = 1e-140, 1e140
#: The level of pairs without a similarity, below all others.
NONE = -2.0
#: Four times the rounding of single precision: of unit vectors of length n, products and what is asked of them are off by less than n + 16 of these, both together.
ROUNDING = 2.0**-22


class Vectors:
    """Vectors of an Arrow table: which are usable (those with a finite norm), which of these are scored by products alone, their lengths, and some of them as a matrix."""

    def __init__(self, table: pa.Table, vector: str, norm: str):
        self.lists = table.column(vector).combine_chunks()
        self.norm = table.column(norm).to_numpy(zero_copy_only=False).astype(np.float64)
        self.length = np.nan_to_num(self.lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
        self.fine = np.isfinite(self.norm)
        self.plain = self.fine & (self.length > 0) & ((self.norm == 0) | ((self.norm >= SMALL) & (self.norm <= LARGE)))

    def matrix(self, at: np.ndarray) -> np.ndarray:
        """Rows of one length, as they are given."""
        return self.lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _units(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, made of some rows at a time."""
    out = np.zeros(m.shape, np.float32)
    for a in range(0, len(m), ROWS):
        size = norm[a : a + ROWS, None]
        np.divide(m[a : a + ROWS].astype(np.float64), size, out=out[a : a + ROWS], where=size > 0, casting="same_kind")
    return out


def _scores(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Similarities row by row, summed in the order of ``vector.dot``; NaN where there is none."""
    with np.errstate(all="ignore"):
        product = np.add.accumulate(a.astype(np.float64) * b, axis=1)[:, -1] + 0.0 if a.shape[1] else np.zeros(len(a))
        return np.where(size < np.inf, np.where(size == 0, 0.0, product / size), np.nan)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The values of columns by their place in order, null as -1."""
    given = [c.combine_chunks() for c in columns]
    values = [np.asarray(c.drop_null().to_pylist() if not pa.types.is_integer(c.type) else c.drop_null().to_numpy(), dtype=None if pa.types.is_integer(c.type) else object) for c in given]
    place, out, at = np.unique(np.concatenate(values), return_inverse=True)[1], [], 0
    for c, v in zip(given, values):
        code = np.full(len(c), -1, np.int64)
        code[c.is_valid().to_numpy(zero_copy_only=False)] = place[at : at + len(v)]
        out, at = [*out, code], at + len(v)
    return out


def nearest_in_block(queries: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) by position: every query's k best. Queries (_q, _qn, _qkey, _qmatch), rows (_v, _n, _key, _id, _match)."""
    q, r = Vectors(queries, "_q", "_qn"), Vectors(rows, "_v", "_n")
    (q_key, r_key), (q_match, r_match), (place,) = _codes(queries["_qkey"], rows["_key"]), _codes(queries["_qmatch"], rows["_match"]), _codes(rows["_id"])
    by_match = bool((q_match >= 0).any())
    found = []

    def bar(some: np.ndarray, part: np.ndarray, pairs: np.ndarray, value: float | bool) -> None:
        """Pairs that may not meet get this value."""
        pairs[_same(q_key[some], r_key[part])] = value
        if by_match:
            pairs[(q_match[some] >= 0)[:, None] & (q_match[some][:, None] != r_match[part][None, :])] = value

    def first(alike: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Of rows that no query tells apart those of the k + 1 smallest ids: a query meets all but its own, and the others come after these."""
        return part[_leading(alike, r_match[part] if by_match else np.zeros(len(part), np.int64), place[part], k + 1)]

    # Queries of one length meet together, zero ones apart; those that cannot be used give no similarity.
    kind = np.where(q.fine, q.length, -1) * 3 + q.plain * np.where(q.norm == 0, 2, 1)
    for length, state in (divmod(int(code), 3) for code in np.unique(kind)):
        group = np.flatnonzero(kind == length * 3 + state)
        plain = state > 0
        same = r.fine & (r.length == length)
        by_product = same & r.plain if plain else np.zeros(len(same), bool)
        near = np.flatnonzero(by_product)
        near = first(_copies(r.matrix(near)) if state == 1 and len(near) else np.zeros(len(near), np.int64), near)
        apart = np.flatnonzero(~same)
        rest = np.sort(np.concatenate([np.flatnonzero(same & ~by_product), first(np.zeros(len(apart), np.int64), apart)]))
        given = r.matrix(near) if len(near) else None
        unit = _units(given, r.norm[near]) if len(near) else None
        for qa in range(0, len(group), QUERIES):
            some = group[qa : qa + QUERIES]
            asked = q.matrix(some) if length > 0 else None
            best = _Best(len(some), k, place)
            mine = _units(asked, q.norm[some]) if plain else None
            for ra in range(0, len(near), ROWS):
                part = near[ra : ra + ROWS]
                score = mine @ unit[ra : ra + ROWS].T
                bar(some, part, score, -np.inf)
                i, j = _above(score, best.reach, k, ROUNDING * (length + 16))
                best.add(i, part[j], _pairs(asked, q.norm[some], given[ra : ra + ROWS], r.norm[part], i, j))
            for ra in range(0, len(rest), ROWS):
                part = rest[ra : ra + ROWS]
                scored = same[part]
                # Pairs without a similarity count only where too few have one.
                pairs = scored[None, :] | (best.reach <= NONE)[:, None]
                bar(some, part, pairs, False)
                i, j = np.nonzero(pairs)
                value, at = np.full(len(i), np.nan), np.flatnonzero(scored[j])
                if len(at):
                    place_of = np.cumsum(scored) - 1
                    value[at] = _pairs(asked, q.norm[some], r.matrix(part[scored]), r.norm[part[scored]], i[at], place_of[j[at]]) if length > 0 else 0.0
                best.add(i, part[j], value)
            found.append((some[best.i], best.j, best.value))
    return tuple(np.concatenate([f[n] for f in found]) for n in range(3))


def _copies(m: np.ndarray) -> np.ndarray:
    """A number for each row, the same for the same bytes."""
    m = np.ascontiguousarray(m)
    return np.unique(m.view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_inverse=True)[1]


def _leading(group: np.ndarray, match: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The positions, in order, of the rows of each group and match that have its k smallest places."""
    order = np.lexsort((place, match, group))
    new = np.append(True, (np.diff(group[order]) != 0) | (np.diff(match[order]) != 0))[: len(order)]
    step = np.cumsum(new | np.append(True, np.diff(place[order]) != 0)[: len(order)])
    return np.sort(order[step - np.maximum.accumulate(np.where(new, step, 0)) < k])


def _above(score: np.ndarray, reach: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may be among their query's k best: of the level reached so far or, where there is none, of the k-th here, or above; ``score`` is -inf where a pair may not be."""
    level = reach.copy()
    new = np.flatnonzero(reach == -np.inf)
    if len(new) and k <= score.shape[1]:
        level[new] = np.partition(score[new], score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    # A bound below all products lets all pass but those that may not be.
    bound = np.maximum(level - slack, NONE).astype(np.float32)
    return np.divmod(np.flatnonzero((score >= bound[:, None]).ravel()), score.shape[1])


def _pairs(a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact similarities of rows i of a matrix and j of another, some pairs at a time."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        with np.errstate(over="ignore"):
            out[at : at + PAIRS] = _scores(b[y], a[x], b_norm[y] * a_norm[x])
    return out


def _same(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of equal keys."""
    order = np.argsort(r, kind="stable")
    low, high = np.searchsorted(r[order], q, "left"), np.searchsorted(r[order], q, "right")
    times = high - low
    i = np.repeat(np.arange(len(q)), times)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]


class _Best:
    """The k best rows of each query so far, in order: by similarity, those without one last, then by id; ``reach`` is the k-th similarity, -inf with fewer rows."""

    def __init__(self, queries: int, k: int, place: np.ndarray):
        self.k, self.place, self.reach = k, place, np.full(queries, -np.inf)
        self.i, self.j, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        if not len(i):
            return
        i, j, value = np.concatenate([self.i, i]), np.concatenate([self.j, j]), np.concatenate([self.value, value])
        order = np.lexsort((self.place[j], -value, i))
        i = i[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < self.k
        self.i, self.j, self.value = i[kept], j[order[kept]], value[order[kept]]
        count = np.bincount(self.i, minlength=len(self.reach))
        full = count >= self.k
        self.reach[full] = np.nan_to_num(self.value[np.cumsum(count)[full] - 1], nan=NONE)
