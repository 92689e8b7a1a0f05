"""Density clustering of a few points in plain NumPy: what the distributed operators are held against."""

import numpy as np


def weights(x, min_samples, metric):
    if metric == "cosine":
        norm = np.sqrt((x * x).sum(axis=1))
        unit = np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], 0.0)
        far = ((unit[:, 0][:, None] - unit[:, 0]) ** 2 + (unit[:, 1][:, None] - unit[:, 1]) ** 2) / 2.0
    elif metric == "manhattan":
        far = np.abs(x[:, 0][:, None] - x[:, 0]) + np.abs(x[:, 1][:, None] - x[:, 1])
    else:
        far = np.sqrt((x[:, 0][:, None] - x[:, 0]) ** 2 + (x[:, 1][:, None] - x[:, 1]) ** 2)
    core = np.array([np.sort(np.delete(row, i))[min_samples - 1] for i, row in enumerate(far)])
    return np.maximum(np.maximum(core[:, None], core[None, :]), far)


def spanning_tree(w):
    """Kruskal by (weight, smaller id, larger id)."""
    n = len(w)
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, w[i, j]))
    group = list(range(n))
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        ga, gb = group[a], group[b]
        if ga != gb:
            group = [ga if g == gb else g for g in group]
            out.append((a, b, float(w[a, b])))
    return out


def condensed(n, edges, m):
    """Clusters {name: [parent, birth, size, sum of lambda]} (0: the root) and each point's last cluster."""
    top = {i: (i,) for i in range(n)}  # members of the tree that a point is in
    node = {i: i for i in range(n)}
    tree = {}
    for k, (a, b, w) in enumerate(sorted(edges, key=lambda e: (e[2], e[0], e[1]))):
        name = n + k
        tree[name] = (node[a], node[b], 1.0 / w if w > 0 else np.inf, top[a], top[b])
        both = top[a] + top[b]
        for p in both:
            top[p], node[p] = both, name
    clusters, last = {0: [None, 0.0, n, 0.0]}, {}
    stack = [(n + len(edges) - 1, 0)]
    while stack:
        name, c = stack.pop()
        left, right, lam, lm, rm = tree[name]
        for child, members, other in ((left, lm, rm), (right, rm, lm)):
            clusters[c][3] += lam * len(members) if len(members) < m or len(other) >= m else 0.0
            if len(members) < m:
                last.update(dict.fromkeys(members, c))
            elif len(other) < m:
                stack.append((child, c))
            else:
                new = len(clusters)
                clusters[new] = [c, lam, len(members), 0.0]
                stack.append((child, new))
    return clusters, last


def select(clusters, method, epsilon):
    children = {}
    for c, (parent, *_) in clusters.items():
        children.setdefault(parent, []).append(c)
    best, chosen = {}, set()
    for c in sorted(clusters, reverse=True):  # children have larger names
        _, birth, size, lam = clusters[c]
        stability = lam - size * birth
        below = sum(best[x] for x in children.get(c, []))
        if c in children and below > stability:
            best[c] = below
        else:
            best[c] = stability
            chosen.add(c)
    chosen.discard(0)
    if method == "leaf":
        chosen = {c for c in clusters if c not in children and c}
    else:
        def above(c):
            while clusters[c][0] is not None:
                c = clusters[c][0]
                yield c
        chosen = {c for c in chosen if not chosen.intersection(above(c))}
    if epsilon:
        out = set()
        for c in chosen:
            if 1.0 / clusters[c][1] < epsilon:
                while clusters[c][0] != 0:
                    c = clusters[c][0]
                    if 1.0 / clusters[c][1] > epsilon:
                        break
            out.add(c)
        chosen = out
    return chosen


def labels(x, min_cluster_size, min_samples, method, epsilon, metric):
    """Label per point, numbered by the smallest member; -1 is noise."""
    n = len(x)
    clusters, last = condensed(n, spanning_tree(weights(x, min_samples, metric)), min_cluster_size)
    chosen = select(clusters, method, epsilon)
    found = []
    for p in range(n):
        c = last[p]
        while c is not None and c not in chosen:
            c = clusters[c][0]
        found.append(-1 if c is None else c)
    order = {c: i for i, c in enumerate(dict.fromkeys(c for c in found if c >= 0))}
    return [order.get(c, -1) for c in found]
