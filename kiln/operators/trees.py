"""Decision trees as arrays: growing to purity inside a task, routing, best binned splits.

A tree is a dict of arrays: ``feature`` (-1 at a leaf), ``threshold`` (a
row goes left where its value is at most that), ``left``, ``right`` and
``value`` (one row per node: class shares, or the mean).  Missing values
go right.
"""

from __future__ import annotations

import numpy as np

LEAF = -1


def clean(x: np.ndarray) -> np.ndarray:
    """Missing values as infinity: the largest value, so they go right."""
    return np.where(np.isnan(x), np.inf, x)


def mixed(seed: int, *parts) -> np.ndarray:
    """64 mixed bits (the SplitMix64 finaliser) of whole numbers; arrays are mixed element by element."""
    with np.errstate(over="ignore"):
        return mixed_on(np.uint64(seed) + np.uint64(0x9E3779B97F4A7C15), *parts)


def mixed_on(h, *parts) -> np.ndarray:
    """Bits ``h`` of ``mixed``, mixed with further whole numbers."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        return h


def uniform(seed: int, *parts) -> np.ndarray:
    return (mixed(seed, *parts) >> np.uint64(11)).astype(float) / float(1 << 53)


def midpoint(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A threshold between neighbouring values; the lower one where their middle is not below the higher."""
    with np.errstate(invalid="ignore", over="ignore"):
        mid = low / 2 + high / 2
    return np.where((mid < high) & (mid >= low), mid, low)


def route(tree: dict, x: np.ndarray, start: int = 0) -> np.ndarray:
    """The leaf (or open node) of every row of ``x`` (cleaned)."""
    node = np.full(len(x), start, dtype=np.int64)
    active = np.flatnonzero(tree["feature"][node] >= 0)
    while len(active):
        at = node[active]
        left = x[active, tree["feature"][at]] <= tree["threshold"][at]
        node[active] = np.where(left, tree["left"][at], tree["right"][at])
        active = active[tree["feature"][node[active]] >= 0]
    return node


def sorted_by(node: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The stable order by (node, rank): a radix sort by 16 bits at a time, which costs the same per row at any depth."""
    key = node * (int(rank.max()) + 1) + rank
    top = int(key.max())
    order = np.argsort(key.astype(np.uint16), kind="stable")  # 16 bits: numpy's stable sort is a radix sort
    for shift in range(16, top.bit_length(), 16):
        order = order[np.argsort((key >> shift).astype(np.uint16)[order], kind="stable")]
    return order


def _best_cut(node: np.ndarray, column: np.ndarray, rank: np.ndarray, flat: np.ndarray, offset: np.ndarray, weight: np.ndarray,
              sums: list[np.ndarray], nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the best cut of its feature ``column`` (one per node): (score, threshold), score -inf where it is constant.

    The score is the sum over both sides of |sums|^2 / weight, which the cut of least impurity makes largest.
    """
    order = sorted_by(node, rank)
    nd, rk, w = node[order], rank[order], np.cumsum(weight[order])
    same = nd[1:] == nd[:-1]
    last = np.flatnonzero(np.append(~same, True))
    place = np.full(nodes, -1)
    place[nd[last]] = np.arange(len(last))
    cut = np.flatnonzero(same & (rk[1:] != rk[:-1]))
    score, threshold = np.full(nodes, -np.inf), np.zeros(nodes)
    if not len(cut):
        return score, threshold
    k = place[nd[cut]]

    def sides(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What lies left and right of every cut, within its node, by the running total."""
        ends = total[last]
        whole = np.diff(ends, prepend=0.0)
        left = total[cut] - (ends - whole)[k]
        return left, whole[k] - left

    left_w, right_w = sides(w)
    left_s = right_s = 0.0
    for column_sums in sums:
        left, right = sides(np.cumsum(column_sums[order]))
        left_s, right_s = left_s + left ** 2, right_s + right ** 2
    gain = left_s / left_w + right_s / right_w
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    top = np.maximum.reduceat(gain, first)
    best = np.flatnonzero(gain >= np.repeat(top, np.diff(np.append(first, len(k)))))
    owner = k[best]  # ascending
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    pos, n = cut[best[at]], nd[last][owner[at]]
    score[n] = top
    base = offset[column[n]]
    threshold[n] = midpoint(flat[base + rk[pos]], flat[base + rk[pos + 1]])
    return score, threshold


def grow(x: np.ndarray, sums: np.ndarray, weight: np.ndarray, classes: int, max_features: int, min_split: int, max_depth: int | None,
         seed: int, rows: np.ndarray | None = None) -> dict:
    """A tree grown level by level until every leaf is pure, all levels vectorised.

    ``sums`` is weight x (class indicators) or weight x (value, value^2);
    rows count once for ``min_split`` whatever their weight.  No cut parts
    equal rows, so with classes they are one with their counts; ``rows``
    says how many each row given stands for.  Each node
    tries ``max_features`` features drawn by a hash of seed and node, and
    further ones only while all so far are constant in it.
    """
    n, d = x.shape
    x, rows = clean(x), np.ones(n) if rows is None else rows
    order = np.lexsort(np.column_stack([weight, sums, x]).T)  # the tree does not depend on the order rows came in
    x, sums, weight, rows = x[order], sums[order], weight[order], rows[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))
    if classes and len(first) < n:
        x, sums, weight, rows = x[first], np.add.reduceat(sums, first, axis=0), np.add.reduceat(weight, first), np.add.reduceat(rows, first)
        n = len(x)
    values = [np.unique(x[:, f], return_inverse=True) for f in range(d)]
    flat = np.concatenate([v for v, _ in values])
    offset = np.concatenate([[0], np.cumsum([len(v) for v, _ in values])[:-1]])
    ranks = np.stack([r.reshape(-1) for _, r in values]).astype(np.int32)
    used = sums if classes else sums[:, :1] - weight[:, None] * (sums[:, 0].sum() / weight.sum())
    sums = [np.ascontiguousarray(c) for c in sums.T]
    used = sums if classes else [np.ascontiguousarray(used[:, 0])]
    out = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    node, count, depth, made = np.zeros(n, dtype=np.int64), 1, 0, 0
    path = np.array([seed], dtype=np.uint64)
    while count:
        w = np.bincount(node, weight, minlength=count)
        tot = np.stack([np.bincount(node, c, minlength=count) for c in sums], axis=1)
        size = np.bincount(node, rows, minlength=count)
        if classes:
            open_ = (tot > 0).sum(axis=1) > 1
            value = tot / w[:, None]
        else:
            mean = tot[:, 0] / w
            open_ = tot[:, 1] / w - mean ** 2 > 1e-12 * np.maximum(1.0, tot[:, 1] / w)
            value = mean[:, None]
        open_ &= size >= max(min_split, 2)
        if max_depth is not None and depth >= max_depth:
            open_[:] = False
        feature, threshold = np.full(count, LEAF), np.zeros(count)
        best = np.full(count, -np.inf)
        if not open_.all():  # rows of finished nodes are not needed any more
            node, ranks, weight, rows, sums, used = _kept(open_[node], node, ranks, weight, rows, sums, used)
        tries = np.argsort(np.stack([uniform(seed, path, f) for f in range(d)], axis=1), axis=1, kind="stable")
        for t in range(d):
            todo = open_ if t < max_features else open_ & (feature == LEAF)
            if not todo.any():
                break
            column = tries[:, t]
            if t < max_features:
                nd, at, wt, of = node, np.arange(len(node)), weight, used
            else:
                at = np.flatnonzero(todo[node])
                nd, wt, of = node[at], weight[at], [c[at] for c in used]
            score, thr = _best_cut(nd, column, ranks[column[nd], at], flat, offset, wt, of, count)
            better = score > best
            best[better], feature[better], threshold[better] = score[better], column[better], thr[better]
        split = feature >= 0
        child = np.cumsum(split) - 1
        left = np.where(split, made + count + 2 * child, LEAF)
        for name, part in (("feature", feature), ("threshold", threshold), ("left", left), ("right", np.where(split, left + 1, LEAF)), ("value", value)):
            out[name].append(part)
        made += count
        if not split[open_].all():
            node, ranks, weight, rows, sums, used = _kept(split[node], node, ranks, weight, rows, sums, used)
        # the highest rank that goes left: thresholds lie between the values of ranks
        top = np.zeros(count, dtype=np.int64)
        for f in range(d):
            mine = np.flatnonzero(feature == f)
            top[mine] = np.searchsorted(values[f][0], threshold[mine], "right") - 1
        right = ranks[feature[node], np.arange(len(node))] > top[node]
        node = 2 * child[node] + right
        path = np.repeat(path[split], 2) * np.uint64(2) + np.tile(np.array([0, 1], dtype=np.uint64), int(split.sum()))
        path = mixed(1, path)
        count, depth = 2 * int(split.sum()), depth + 1
    return {k: np.concatenate(v) for k, v in out.items()}


def _kept(keep: np.ndarray, node: np.ndarray, ranks: np.ndarray, weight: np.ndarray, rows: np.ndarray, sums: list, used: list) -> tuple:
    at = np.flatnonzero(keep)
    held = [c[at] for c in sums]
    return node[at], ranks[:, at], weight[at], rows[at], held, held if used is sums else [c[at] for c in used]


def best_binned_cut(count: np.ndarray, sums: np.ndarray) -> tuple[float, int]:
    """(score, bin) of the best cut of one feature's histogram: ``count`` (bins) weights, ``sums`` (bins, k); bin -1: none.

    The score is |sums|^2 / weight summed over both sides, less that of the whole."""
    w, s = np.cumsum(count), np.cumsum(sums, axis=0)
    if not len(w) or w[-1] <= 0:
        return -np.inf, -1
    left_w, left_s = w[:-1], s[:-1]
    right_w, right_s = w[-1] - left_w, s[-1] - left_s
    ok = (left_w > 0) & (right_w > 0)
    if not ok.any():
        return -np.inf, -1
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_s ** 2).sum(axis=1) / left_w + (right_s ** 2).sum(axis=1) / right_w - (s[-1] ** 2).sum() / w[-1]
    gain = np.where(ok, gain, -np.inf)
    at = int(np.argmax(gain))
    return float(gain[at]), at
