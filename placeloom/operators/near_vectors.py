"""Near copies of texts by TF-IDF vectors in NumPy: what one task works out for groups that it holds whole."""

from __future__ import annotations

import numpy as np

#: Pairs looked at in one go, cells of dense rows, and terms told apart in one pass: they bound memory, not results.
PAIRS, CELLS, TERMS = 1 << 19, 1 << 20, 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values mixed so that every bit depends on all."""
    out = x.astype(np.uint64)
    for at in range(0, len(out), PAIRS):
        part = out[at : at + PAIRS]
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            part ^= part >> np.uint64(33)
            part *= np.uint64(factor)
        part ^= part >> np.uint64(33)
    return out


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def terms_of(ptr: np.ndarray, tokens: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for tokens and pairs of neighbours; `salt` of a text keeps the terms of different groups apart."""
    counts, at = np.diff(ptr), 0
    text = np.empty(int(counts.sum() + np.maximum(counts - 1, 0).sum()), np.int32)
    term = np.empty(len(text), np.uint64)
    for s in _slices(counts, PAIRS):
        part, of = tokens[ptr[s.start] : ptr[s.stop]], np.repeat(np.arange(s.start, s.stop), counts[s])
        own, near = salt[of], of[:-1] == of[1:]
        pair = mixed(mixed(part[:-1][near]) * np.uint64(3) + part[1:][near]) ^ np.uint64(0x9E3779B97F4A7C15)
        for x, where in ((part ^ own, of), (pair ^ own[:-1][near], of[:-1][near])):
            text[at : at + len(x)], term[at : at + len(x)] = where, mixed(x)
            at += len(x)
    return text, term


def counted(terms: list[np.ndarray], of_text: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, term number, tf) of each term of each text; df and group by term number. Terms of fewer than least[group] texts are left out.
    terms: texts and terms, which are taken out of the list."""
    term, text = terms.pop(), terms.pop()
    parts, facts, passes, so_far = [], [], -(-len(term) // TERMS), 0
    turn = np.empty(len(term), np.uint16)
    for at in range(0, len(term), PAIRS):
        turn[at : at + PAIRS] = (term[at : at + PAIRS] >> np.uint64(40)) % np.uint64(passes)
    for k in range(passes):
        sel = np.flatnonzero(turn == k)
        where, what = text[sel], term[sel]
        order = np.argsort(what)
        new = np.empty(len(what), bool)
        new[:1] = True
        sorted_ = what[order]
        np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
        number = np.empty(len(what), np.int64)
        number[order] = np.cumsum(new) - 1
        if not len(number):
            continue
        most = int(number.max()) + 1
        key, tf = np.unique(where.astype(np.int64) * most + number, return_counts=True)
        where, number = key // most, key % most
        df = np.bincount(number, minlength=most)
        group = np.empty(most, np.int64)
        group[number] = of_text[where]
        good = df >= least[group]
        keep = good[number]
        renumbered = np.cumsum(good) - 1 + so_far
        parts.append((where[keep].astype(np.int32), renumbered[number[keep]].astype(np.int32), tf[keep].astype(np.int32)))
        facts.append((df[good], group[good]))
        so_far += int(good.sum())
    del term, text
    none = np.empty(0, np.int32)
    columns = [[*x] for x in zip(*parts or [(none,) * 3], strict=True)]
    del parts
    joined = []
    while columns:
        joined.append(np.concatenate(columns.pop(0)))
    return (*joined, *(np.concatenate(x) for x in zip(*facts or [(none,) * 2], strict=True)))


def vectors_of(ptr: np.ndarray, tokens: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ptr, rank, tf, weight) of the texts' vectors of unit length, rarest terms first, and the least rank of each text's group.

    tokens: a list of the one array, which is taken out of it. group: of each text, from 0 on. Ranks tell terms apart; they go by group, then df."""
    size = np.bincount(group, minlength=1)
    least = np.where(size > 1000, np.floor(np.log(np.maximum(size, 1))), 1)
    terms = [*terms_of(ptr, tokens.pop(), mixed(group + 1))]
    text, number, tf, df, where = counted(terms, group, least)
    order = np.lexsort((df, where))
    rank = np.empty(len(df), np.int32)
    rank[order] = np.arange(len(df))
    rarity = np.empty(len(df))
    rarity[rank] = np.log((1 + size[where]) / (1 + df)) + 1
    number = rank[number]
    key = text.astype(np.int64)
    key *= max(len(df), 1)
    key += number
    order = np.argsort(key)
    del key
    text = text[order]
    number = number[order]
    tf = tf[order]
    del order
    weight = 1 + np.log(tf)
    weight *= rarity[number]
    length = np.sqrt(np.bincount(text, weight * weight, len(ptr) - 1))
    for at in range(0, len(weight), PAIRS):
        weight[at : at + PAIRS] /= length[text[at : at + PAIRS]]
    many = np.bincount(where, minlength=len(size))
    return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(ptr) - 1))]), number, tf, weight, (np.cumsum(many) - many)[group]


def equal_vectors(ptr: np.ndarray, rank: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """For each text the number of the first text of the same vector (by 128-bit sums); itself where it has no terms."""
    sums = np.zeros((len(ptr) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(ptr))
    if not len(some):
        return np.arange(len(ptr) - 1)
    for s in _slices(np.diff(ptr)[some], PAIRS):
        texts = some[s]
        at = slice(ptr[texts[0]], ptr[texts[-1] + 1])
        term = mixed(rank[at].astype(np.int64) * (1 << 20) + tf[at])
        sums[texts, 0], sums[texts, 1] = (np.add.reduceat(x, ptr[texts] - at.start) for x in (term, mixed(term + np.uint64(1))))
    none = np.flatnonzero(np.diff(ptr) == 0)
    sums[none, 0] = none
    _, first, which = np.unique(np.column_stack([sums, np.diff(ptr).astype(np.uint64)]).view("u8,u8,u8").ravel(), return_index=True, return_inverse=True)
    return first[which]


def near(ptr: np.ndarray, rank: np.ndarray, weight: np.ndarray, base: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: texts whose vectors are nearer than `distance`. base: the least rank of each text's group.

    Two such vectors share one of the terms before the point where what follows is shorter than the least similarity; a
    pair is followed up while the terms before it and the lengths of the rests allow a near pair."""
    least, n = 1 - distance, len(ptr) - 1
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(ptr))
    total = np.zeros(len(rank) + 1)
    np.multiply(weight, weight, out=total[1:])
    np.cumsum(total, out=total)
    before, front = total[ptr[:-1]], np.empty(len(rank), bool)
    for at in range(0, len(rank), PAIRS):  # what follows, this term with it, is as long as the least similarity
        part = slice(at, min(at + PAIRS, len(rank)))
        front[part] = total[:-1][part] - before[text[part]] <= 1 - least * least + 1e-9
    ends = ptr[:-1] + np.bincount(text[front], minlength=n)
    tail = np.sqrt(np.maximum(1 - (total[ends] - total[ptr[:-1]]), 0))
    last = np.where(ends > ptr[:-1], rank[np.maximum(ends - 1, 0)], -1) if len(rank) else np.full(n, -1)
    del total
    entry = np.flatnonzero(front)
    own, begin = text[entry].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(text[entry], minlength=n))])
    term = rank[entry]
    order = np.argsort(term, kind="stable")  # of the entries: by term, then text
    place, later = np.empty(len(entry), np.int64), np.empty(len(entry), np.int64)
    place[order] = np.arange(len(entry))
    later[order] = np.searchsorted(term[order], term[order], side="right") - np.arange(len(entry)) - 1
    load = np.concatenate([[0], np.cumsum(later)])[begin]
    some = np.flatnonzero(np.diff(ptr))
    width = int((rank[ptr[some + 1] - 1] - base[some]).max()) + 1 if len(rank) else 1
    del text, front
    row = np.zeros(max(1, CELLS // width) * width)
    found, d = [(np.empty(0, np.int64),) * 2], 0
    while d < n:
        stop = min(max(d + 1, int(np.searchsorted(load, load[d] + PAIRS, side="right")) - 1), d + max(1, CELLS // width), n)
        mine = np.flatnonzero(later[begin[d] : begin[stop]]) + begin[d]
        if len(mine):
            one = np.repeat(mine, later[mine])
            other = order[np.repeat(place[mine] + 1, later[mine]) + runs(later[mine])]
            key = own[one] * n + own[other]
            by = np.argsort(key)
            key = key[by]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            a, b = np.divmod(key[begins], n)
            cells = np.repeat((np.arange(d, stop) - d) * width - base[d:stop], np.diff(ptr[d : stop + 1])) + rank[ptr[d] : ptr[stop]]
            row[cells] = weight[ptr[d] : ptr[stop]]
            shift = (a - d) * width - base[a]
            dot = np.add.reduceat((weight[entry[one]] * weight[entry[other]])[by], begins)
            # Up to the last term of the shorter front, both fronts hold all terms; beyond it the rests' lengths bound the product.
            a_first = last[a] <= last[b]
            left = _rests(np.where(a_first, b, a), np.where(a_first, last[a], last[b]), ptr, rank, weight)
            keep = dot + tail[np.where(a_first, a, b)] * np.sqrt(np.maximum(left, 0)) >= least - 1e-9
            a, b, shift = a[keep], b[keep], shift[keep]
            good = 1 - _products(row, shift, ptr[b], ptr[b + 1], rank, weight) < distance
            found.append((a[good], b[good]))
            row[cells] = 0
        d = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rests(texts: np.ndarray, lead: np.ndarray, ptr: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared length of the texts' vectors without the terms up to rank `lead`."""
    left, at, live = np.ones(len(texts)), ptr[texts], np.arange(len(texts))
    while len(live):
        live = live[at[live] < ptr[texts[live] + 1]]
        live = live[rank[at[live]] <= lead[live]]
        left[live] -= weight[at[live]] ** 2
        at[live] += 1
    return left


def _products(row: np.ndarray, shift: np.ndarray, begin: np.ndarray, end: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums over the terms from begin to end, at least one each, of their weight times that of the term in `row`."""
    length, sums = end - begin, np.empty(len(begin))
    for s in _slices(length, PAIRS):
        take = length[s]
        term = np.repeat(begin[s], take) + runs(take)
        sums[s] = np.add.reduceat(row[np.repeat(shift[s], take) + rank[term]] * weight[term], np.cumsum(take) - take)
    return sums


def _slices(length: np.ndarray, most: int):
    """Slices of `length`, each of a sum of about `most` at most."""
    sums, at = np.concatenate([[0], np.cumsum(length)]), 0
    while at < len(length):
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] + most, side="right")) - 1)
        yield slice(at, stop)
        at = stop


def kept(first: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray, age: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """Which texts are left when of each star only that of the least age stays. first: the first text of the same vector;
    (a, b): near pairs of such firsts; key and age: ranks; bare: texts without terms. Disjoint stars, the largest first, of equal ones that of the least key."""
    n = len(first)
    members = np.argsort(first, kind="stable")
    many = np.bincount(first, minlength=n)
    begin = np.cumsum(many) - many
    least = np.full(n, n, np.int64)
    np.minimum.at(least, first, key)
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    links = np.bincount(one, minlength=n)
    at = np.cumsum(links) - links
    size = many + np.bincount(one, many[two], n).astype(np.int64)
    centres = np.flatnonzero((size > 1) & (many > 0) & ~bare)
    centres = centres[np.lexsort((least[centres], -size[centres]))]
    taken, out = np.zeros(n, bool), np.zeros(n, bool)
    for c in centres.tolist():
        if taken[c]:
            continue
        star = two[at[c] : at[c] + links[c]]
        if taken[star].any():
            continue
        taken[c] = True
        taken[star] = True
        own = np.concatenate([members[begin[x] : begin[x] + many[x]] for x in (c, *star.tolist())])
        out[own] = True
        out[own[np.argmin(age[own])]] = False
    return ~out


def kept_of_groups(ptr: np.ndarray, tokens: list[np.ndarray], group: np.ndarray, key: np.ndarray, age: np.ndarray, distance: float) -> np.ndarray:
    """Which texts are left of groups without near copies. ptr, tokens: 64-bit hashes of the texts' tokens, in a list that is emptied; key, age: ranks of keys and of (time, key)."""
    ptr, rank, tf, weight, base = vectors_of(ptr, tokens, group)
    first = equal_vectors(ptr, rank, tf)
    length, is_first = np.diff(ptr), first == np.arange(len(first))
    own, take = np.flatnonzero(is_first), np.repeat(is_first, length)
    tf = None
    rank, weight = rank[take], weight[take]
    a, b = near(np.concatenate([[0], np.cumsum(length[own])]), rank, weight, base[own], distance)
    return kept(first, own[a], own[b], key, age, length == 0)
