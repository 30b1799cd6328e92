"""Nuclei and cells against plain numpy."""

import math

import numpy as np

from rastrel.operators import markers as MK

from .test_blocks import fill


def plain_smooth(p, sigma=1.0):
    r = int(4 * sigma + 0.5)
    w = np.array([math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)])
    for axis in (0, 1):
        wide = np.pad(p, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        p = sum(np.take(wide, range(k, k + p.shape[axis]), axis) * v for k, v in enumerate(w / w.sum()))
    return np.round(p, 9)


def plain_depth(mask):
    out = np.argwhere(~mask)
    return {(y, x): int(((out - (y, x)) ** 2).sum(1).min()) for y, x in np.argwhere(mask).tolist()}


def plain_open_close(mask):
    cross = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    at = lambda s: {(y + a, x + b) for y, x in s for a, b in cross}
    eat = lambda s: {p for p in s if all((p[0] + a, p[1] + b) in s for a, b in cross)}
    own = {tuple(p) for p in np.argwhere(mask).tolist()}
    return eat(at(at(eat(own))))


def plain_flood(seeds, low, inside):
    """Always the lowest, then the oldest place, found by looking through all of them."""
    out, queue, age = dict(seeds), [], 0
    for p in sorted(seeds):
        queue.append((low[p], age, p))
        age += 1
    while queue:
        first = min(queue)
        queue.remove(first)
        y, x = first[2]
        for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if p in inside and p not in out:
                out[p] = out[y, x]
                queue.append((low[p], age, p))
                age += 1
    return out


def plain_nuclei(p, least=30, spacing=4, region=None):
    mask = np.zeros(p.shape, bool)
    for q in plain_open_close(p >= 0.35):
        mask[q] = True
    parts = fill({tuple(q) for q in np.argwhere(mask).tolist()}, 1000, False)
    size = {k: list(parts.values()).count(k) for k in set(parts.values())}
    inside = {q for q, k in parts.items() if size[k] >= least}
    mask[:] = False
    for q in inside:
        mask[q] = True
    depth = plain_depth(mask if region is None else region(mask))
    limit = np.percentile([math.sqrt(v) for v in depth.values()], 70)
    core = {q: v for q, v in depth.items() if math.sqrt(v) >= limit}
    tops = sorted((-v, q) for q, v in core.items() if v >= max(core.get((q[0] + a, q[1] + b), 0) for a in range(-3, 4) for b in range(-3, 4)))
    seeds = {}
    for _, q in tops:
        if all(max(abs(q[0] - s[0]), abs(q[1] - s[1])) >= spacing for s in seeds):
            seeds[q] = q[0] * 1000 + q[1]
    out = plain_flood(seeds, {q: -math.sqrt(core.get(q, 0)) for q in inside}, inside)
    size = {k: list(out.values()).count(k) for k in set(out.values())}
    order = {k: i + 1 for i, k in enumerate(sorted(k for k in size if size[k] >= least))}
    return {q: order[k] for q, k in out.items() if k in order}


def plane():
    y, x = np.mgrid[:32, :48]
    disc = lambda cy, cx, r: (y - cy) ** 2 + (x - cx) ** 2 <= r * r
    return np.where(disc(9, 9, 6) | disc(10, 18, 5) | disc(22, 12, 5) | disc(15, 36, 7) | disc(26, 33, 6) | disc(3, 44, 2), 0.9, 0.1)


def table(spark, **planes):
    height, width = next(iter(planes.values())).shape
    rows = [(y, x, *(float(v[y, x]) for v in planes.values())) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "y long, x long, " + ", ".join(f"{c} double" for c in planes))


def got(df):
    return {(r["y"], r["x"]): r["label"] for r in df.collect()}


def test_touching_nuclei_are_those_of_plain_numpy(spark):
    p = plane()
    want = plain_nuclei(plain_smooth(p))
    assert len(set(want.values())) == 5
    assert got(MK.nucleus_markers(table(spark, p=p), *p.shape)) == want


def test_boundaries_keep_seeds_away_and_split_what_depth_does_not(spark):
    y, x = np.mgrid[:24, :40]
    p = np.where((abs(y - 11) <= 5) & (abs(x - 19) <= 14), 0.9, 0.1)
    rim = np.where((abs(y - 11) <= 5) & (abs(x - 15) <= 1), 0.9, 0.0)

    def region(mask):
        near = np.argwhere(plain_smooth(rim) >= 0.35)
        far = np.array([[((near - (a, b)) ** 2).sum(1).min() > 4 for b in range(40)] for a in range(24)])
        return mask & far & (plain_smooth(p) >= 0.45)

    want = plain_nuclei(plain_smooth(p), region=region)
    found = got(MK.boundary_markers(table(spark, p=p, boundary=rim), 24, 40))
    assert found == want and found[11, 8] != found[11, 24]


def test_cells_keep_out_of_the_background_and_within_reach(spark):
    y, x = np.mgrid[:20, :30]
    cyto, back = 0.4 + 0.02 * ((7 * y + 3 * x) % 13), np.where((x == 17) | (y > 16), 0.7, 0.05 * (x % 3))
    nuclei = {(a, b): k for k, (cy, cx) in enumerate([(6, 6), (8, 12), (10, 22)], 1) for a in range(cy - 1, cy + 2) for b in range(cx - 1, cx + 2)}
    for reach, limit in ((4, 0.5), (None, None)):
        inside = {(a, b) for a in range(20) for b in range(30) if (limit is None or back[a, b] < limit) and (reach is None or min((a - c) ** 2 + (b - d) ** 2 for c, d in nuclei) <= reach * reach)}
        low = {q: (0.5 * back[q] if limit else 0.0) - cyto[q] for q in inside}
        want = plain_flood(nuclei, low, inside)
        df = spark.createDataFrame([(*q, k) for q, k in nuclei.items()], "y long, x long, label long")
        assert got(MK.cells(df, table(spark, p=cyto, background=back), 20, 30, background=limit, reach=reach, least=20)) == want


def test_empty_and_seedless_planes(spark):
    empty = table(spark, p=np.full((9, 9), 0.1), boundary=np.zeros((9, 9)))
    assert got(MK.nucleus_markers(empty, 9, 9)) == got(MK.boundary_markers(empty, 9, 9)) == {}
    assert set(got(MK.nucleus_markers(table(spark, p=np.full((9, 9), 0.9)), 9, 9)).values()) <= {1}
