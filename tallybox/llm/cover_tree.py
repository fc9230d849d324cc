"""A cover tree over the points of one block, built and searched a level at a time with numpy.

A node is a run of the points' order, a centre among them and the distance to its
farthest point. Its children's centres are more than ``radius / BASE`` apart, every point
lies that near to its child's centre, and the first child keeps the centre: a point is
dealt to the first centre that covers it. Nodes of few points, or of equal ones, are
leaves. Runs are nested, so the sum over any subtree is a difference of two cumulative
sums.

Coordinates are integers: longs while distances fit one, Python's integers beyond
(``exact``), so all comparisons are exact but those that only rule out work.
"""

from __future__ import annotations

import numpy as np

BASE, LEAF = 1.6, 24
#: Coordinates below this have squared distances that fit a long, up to 256 dimensions.
SMALL = 2**26
NODE = np.dtype([("start", "<i4"), ("stop", "<i4"), ("child", "<i4"), ("children", "<i4"), ("centre", "<i4"), ("radius", "<f8")])


def exact(x: np.ndarray) -> np.ndarray:
    """Coordinates as longs, or as Python's integers if one is too large for exact distances in longs."""
    return x.astype(np.int64) if x.dtype != object and (not x.size or -SMALL < x.min() and x.max() < SMALL) else x.astype(object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def _runs(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The concatenated ranges."""
    n = stops - starts
    return np.repeat(stops - n.cumsum(), n) + np.arange(n.sum())


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of at least one point; the root is the first node, children stand together."""
    n = len(points)
    order = np.arange(n, dtype=np.int32)
    root = np.zeros(1, NODE)
    root["stop"], root["radius"] = n, float(squared(points, points[0]).max()) ** 0.5
    levels, made = [root], 1
    while len(levels[-1]):
        level = levels[-1]
        split = np.flatnonzero((level["stop"] - level["start"] > LEAF) & (level["radius"] > 0))
        at = _runs(level["start"][split], level["stop"][split])
        group = np.repeat(np.arange(len(split)), (level["stop"] - level["start"])[split])
        rows, child, far = order[at], np.zeros(len(at), np.int64), np.zeros(len(at))
        reach = (level["radius"][split] / BASE) ** 2
        centres, number = [], np.zeros(len(split), np.int64)
        open_, pivot = np.arange(len(at)), level["centre"][split]
        groups = np.arange(len(split))
        while len(open_):
            g = group[open_]
            where = np.zeros(len(split), np.int64)
            where[groups] = pivot
            d = squared(points[rows[open_]], points[where[g]]).astype(float)
            near = (d <= reach[g]) | (rows[open_] == where[g])
            child[open_[near]], far[open_[near]] = number[g[near]], d[near]
            centres.append(np.column_stack([groups, number[groups], pivot]))
            number[groups] += 1
            open_ = open_[~near]
            groups, first = np.unique(group[open_], return_index=True)
            pivot = rows[open_[first]]
        below = np.zeros(number.sum(), NODE)
        if len(below):
            base = number.cumsum() - number
            key = base[group] + child
            turn = np.argsort(key, kind="stable")
            order[at] = rows[turn]
            sizes = np.bincount(key, minlength=len(below))
            where = np.concatenate(centres)
            below["centre"][base[where[:, 0]] + where[:, 1]] = where[:, 2]
            radius = np.zeros(len(below))
            np.maximum.at(radius, key, far)
            below["radius"] = np.sqrt(radius)
            inside = sizes.cumsum() - sizes
            owner = np.repeat(np.arange(len(split)), number)
            below["start"] = level["start"][split][owner] + inside - inside[base[owner]]
            below["stop"] = below["start"] + sizes
            level["child"][split], level["children"][split] = made + base, number
        made += len(below)
        levels.append(below)
    return order, np.concatenate(levels)


def assign(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of every point (the first of equals), sums and counts per entry, and how many points were compared one by one.

    A subtree goes to an entry whole if its centre is nearer to it than to any other by more
    than twice the radius: then so is every point, by the triangle inequality. A margin
    covers the rounding of the roots. Children of other nodes are looked at in turn.
    """
    k, ordered = len(entries), points[order]
    run = np.concatenate([np.zeros((1, points.shape[1]), ordered.dtype), ordered.cumsum(axis=0)])
    code = np.empty(len(points), np.int64)
    sums, counts = np.zeros((k, points.shape[1]), ordered.dtype), np.zeros(k, np.int64)
    compared, front = 0, np.zeros(1, np.int64)
    while len(front):
        level = nodes[front]
        d = squared(points[level["centre"]][:, None, :], entries[None, :, :])
        best = d.argmin(axis=1).astype(np.int64)
        root = np.sqrt(d.astype(float))
        nearest = np.take_along_axis(root, best[:, None], 1)[:, 0]
        np.put_along_axis(root, best[:, None], np.inf, 1)
        second = root.min(axis=1)
        whole = (level["radius"] == 0) | (second - nearest > 2 * level["radius"] + 1e-9 * (nearest + level["radius"]) + 1e-6)
        sure, unsure = level[whole], level[~whole]
        code[_runs(sure["start"], sure["stop"])] = np.repeat(best[whole], sure["stop"] - sure["start"])
        for j in np.unique(best[whole]):
            mine = sure[best[whole] == j]
            sums[j] += (run[mine["stop"]] - run[mine["start"]]).sum(axis=0)
            counts[j] += (mine["stop"] - mine["start"]).sum()
        leaves, inner = unsure[unsure["children"] == 0], unsure[unsure["children"] > 0]
        rest = _runs(leaves["start"], leaves["stop"])
        compared += len(rest)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            code[some] = squared(ordered[some][:, None, :], entries[None, :, :]).argmin(axis=1)
        for j in np.unique(code[rest]):
            mine = rest[code[rest] == j]
            sums[j] += ordered[mine].sum(axis=0)
            counts[j] += len(mine)
        front = _runs(inner["child"].astype(np.int64), (inner["child"] + inner["children"]).astype(np.int64))
    out = np.empty(len(points), np.int64)
    out[order] = code
    return out, sums, counts, compared
