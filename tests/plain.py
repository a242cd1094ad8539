"""Small plain restatements of the operators' rules, for comparison on fixtures."""

import numpy as np


def window_starts(t, n, half, gap):
    """0-based starts of the windows of one trace with times ``t``."""
    size, out = len(t), set()
    breaks = [i for i in range(size - 1) if t[i + 1] - t[i] > gap]
    smooth = lambda s: not any(s <= g <= s + n - 2 for g in breaks)
    for s in list(range(0, size - n + 1, n)) + list(range(half, size - n + 1, n)):
        if smooth(s):
            out.add(s)
    for g in breaks:
        if g >= n - 1:
            out.add(g - n + 1)
        if g + n < size:
            out.add(g + 1)
    if size >= n and size % n and smooth(size - n):
        out.add(size - n)
    return sorted(out)


def traces(times, gap):
    cuts = [0] + [i for i in range(1, len(times)) if times[i] - times[i - 1] > gap] + [len(times)]
    return [(a, b) for a, b in zip(cuts, cuts[1:])]


def kendall(x, y):
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    pairs = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    n0 = len(x) * (len(x) - 1) / 2
    return s / np.sqrt((n0 - pairs(x)) * (n0 - pairs(y)))


def hdbscan(points, min_size, min_samples, epsilon):
    """Top-down: remove the heaviest tree edges one by one and watch clusters split."""
    n = len(points)
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.sort(dist, 1)[:, min(min_samples, n - 1)]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None]))
    # of equally heavy edges the one between lower numbers comes first, so that the tree is unique
    up, edges = list(range(n)), []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for w, a, b in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if find(a) != find(b):
            up[find(a)] = find(b)
            edges.append((w, a, b))

    def parts(nodes, kept):
        label = {x: x for x in nodes}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x
        for _, a, b in kept:
            label[root(a)] = root(b)
        groups = {}
        for x in nodes:
            groups.setdefault(root(x), set()).add(x)
        return list(groups.values())

    clusters = [{"up": None, "born": 0.0, "dist": np.inf, "left": {}, "kids": []}]
    todo = [(0, set(range(n)), edges)]
    while todo:
        c, nodes, kept = todo.pop()
        while kept:
            w, kept = kept[-1][0], kept[:-1]
            lam = 1 / max(w, 1e-12)
            split = parts(nodes, kept)
            big = [p for p in split if len(p) >= min_size]
            inner = lambda p: [e for e in kept if e[1] in p and e[2] in p]
            if len(big) == 2:
                for p in big:
                    clusters.append({"up": c, "born": lam, "dist": w, "left": {}, "kids": []})
                    clusters[c]["kids"].append((len(clusters) - 1, len(p), lam))
                    todo.append((len(clusters) - 1, p, inner(p)))
                break
            for p in split:
                if p not in big:
                    clusters[c]["left"].update(dict.fromkeys(p, lam))
            if not big:
                break
            nodes, kept = big[0], inner(big[0])
    stable, chosen = {}, set()
    for i in range(len(clusters) - 1, 0, -1):
        k = clusters[i]
        own = sum(x - k["born"] for x in k["left"].values()) + sum((lam - k["born"]) * m for _, m, lam in k["kids"])
        below = sum(stable[x] for x, _, _ in k["kids"])
        if own >= below:
            chosen.add(i)
        stable[i] = max(own, below)

    def above(i):
        while i is not None:
            yield i
            i = clusters[i]["up"]
    final = set()
    for i in chosen:
        if not any(a in chosen for a in list(above(i))[1:]):
            while clusters[i]["dist"] < epsilon and clusters[i]["up"] != 0:
                i = clusters[i]["up"]
            final.add(i)
    out = np.full(n, -1)
    for i, k in enumerate(clusters):
        top = [a for a in above(i) if a in final]
        if top:
            out[list(k["left"])] = top[-1]
    return out


def same_partition(a, b):
    there, back = {}, {}
    return all((x < 0) == (y < 0) and there.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in zip(a, b))
