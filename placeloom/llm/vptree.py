"""Vantage-point trees over 128-bit fingerprints under the Hamming distance, in numpy.

Fingerprints are rows of two unsigned 64-bit words.
"""

from __future__ import annotations

import numpy as np

LEAF = 32  #: fingerprints compared one by one at the end of a branch
ASKED, TOLD = 128, 256  #: queries and fingerprints compared at a time
SPARED = 0.9  #: a boundary must leave no more than this share of the comparisons


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, of two words a fingerprint."""
    count = np.bitwise_count(a ^ b)
    return count[..., 0] + count[..., 1]


def _split(prints: np.ndarray, at: np.ndarray, leaf: int, reach: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(vantage point, boundary, inside, outside), or None where no boundary spares a tenth of the comparisons.

    The boundary is where the fewest balls of radius `reach` lie across it, for the sizes of the two sides:
    between a vantage point's near copies and the rest, or between kinds of texts."""
    if len(at) <= leaf:
        return None
    vantage = int(at[len(at) // 2])
    d = hamming(prints[at], prints[vantage]).astype(np.int64)
    upto = np.concatenate([np.cumsum(np.bincount(d, minlength=129)), np.full(reach + 1, len(at))])
    edges = np.arange(129)
    before = np.where(edges >= reach, upto[np.maximum(edges - reach, 0)], 0)
    inside = upto[edges]
    cost = inside * upto[edges + reach] + (len(at) - inside) * (len(at) - before)
    cost[(inside == 0) | (inside == len(at))] = len(at) ** 2
    edge = int(cost.argmin())
    if cost[edge] > SPARED * len(at) ** 2:
        return None
    return vantage, edge, at[d <= edge], at[d > edge]


def pairs_within(prints: np.ndarray, queries: np.ndarray, radius: np.ndarray, leaf: int = LEAF, since: np.ndarray | None = None, until: np.ndarray | None = None):
    """Yields arrays (query number, fingerprint number) of pairs that may be within the query's radius.

    Branches are pruned by the triangle inequality: a query meets the inside when its distance to
    the vantage point less its radius is within the boundary, the outside when the sum is beyond.
    With `since` and `until`, neither of which ever falls, pairs whose fingerprint number isn't from the query's
    since to before its until are left out: both are in order on every branch, so that a block of queries
    is compared with a stretch of a leaf.
    """
    low, asked = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(queries[:, 0])
    near = np.minimum(radius, 255).astype(np.uint8)
    reach = int(near.max(initial=0))
    # The same memory for every block, small enough for a core's own cache.
    differ, count, ok = np.empty(ASKED * TOLD, np.uint64), np.empty(ASKED * TOLD, np.uint8), np.empty(ASKED * TOLD, bool)
    stack = [(np.arange(len(prints)), np.arange(len(queries)))]
    while stack:
        at, q = stack.pop()
        if not len(at) or not len(q):
            continue
        parted = _split(prints, at, leaf, reach)
        if parted is None:
            # The first word alone rules out most; the rest is compared as a whole.
            for qlo in range(0, len(q), ASKED):
                qs = q[qlo : qlo + ASKED]
                own = at if since is None else at[np.searchsorted(at, since[qs[0]]) : np.searchsorted(at, until[qs[-1]])]
                bits, most = asked[qs][:, None], near[qs][:, None]
                for lo in range(0, len(own), TOLD):
                    some = own[lo : lo + TOLD]
                    n, shape = len(qs) * len(some), (len(qs), len(some))
                    np.bitwise_xor(bits, low[some], out=differ[:n].reshape(shape))
                    np.bitwise_count(differ[:n], out=count[:n])
                    np.less_equal(count[:n].reshape(shape), most, out=ok[:n].reshape(shape))
                    # Positions in one row of flags are found much faster than in a table of them.
                    found = np.flatnonzero(ok[:n])
                    if not len(found):
                        continue
                    i, j = np.divmod(found, len(some))
                    i, j = qs[i], some[j]
                    kept = hamming(queries.take(i, axis=0), prints.take(j, axis=0)) <= near[i]
                    if since is not None:
                        kept &= (since[i] <= j) & (j < until[i])
                    yield i[kept], j[kept]
            continue
        vantage, edge, inside, outside = parted
        d = hamming(queries[q], prints[vantage]).astype(np.int64)
        stack += [(inside, q[d - radius[q] <= edge]), (outside, q[d + radius[q] > edge])]
