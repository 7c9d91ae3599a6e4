"""Sessions by density: clusters of a user's stamps on the line of time, whatever their number and length."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.plans.operator import Operator as O


def core_distances(stamps: np.ndarray, neighbours: int) -> np.ndarray:
    """Each stamp's distance to its neighbours-th nearest other one: the least reach of neighbours + 1 stamps in a row that hold it."""
    n, k = len(stamps), min(neighbours, len(stamps) - 1)
    out = np.full(n, np.inf)
    for before in range(k + 1):  # stamps of the row that lie before it
        at = np.arange(before, n - k + before)
        out[at] = np.minimum(out[at], np.maximum(stamps[at] - stamps[at - before], stamps[at + k - before] - stamps[at]))
    return out


def reach_edges(stamps: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (distance, a, b), rising, that connect at every distance what all pairs connect.

    Two stamps are as far apart as their gap or as either one's core distance, whichever is most. At a distance d those with a
    core of d or less are linked along the line where their gaps are d at most. So it is enough to link stamps that are next to
    each other once all of greater core have left: two edges a stamp at most, where all pairs would be quadratic.
    """
    n = len(stamps)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    pairs = [(i, i + 1) for i in range(n - 1)]
    for i in np.argsort(-core, kind="stable").tolist():
        a, b = before[i], after[i]
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
        if a >= 0 and b < n:
            pairs.append((a, b))
    a, b = np.array(pairs).T
    far = np.maximum(stamps[b] - stamps[a], np.maximum(core[a], core[b]))
    order = np.argsort(far, kind="stable")
    return list(zip(far[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True))


def merges(n: int, edges: list[tuple[float, int, int]]) -> tuple[list[float], list[list[int]], list[int]]:
    """Distance, parts and size of each cluster of the single-linkage tree; the first n are the stamps, the last is the root. What one distance joins is one cluster, of however many parts."""
    far, parts, size = [-1.0] * n, [[] for _ in range(n)], [1] * n
    head, node = list(range(n)), list(range(n))
    for d, a, b in edges:
        while head[a] != a:
            head[a] = a = head[head[a]]
        while head[b] != b:
            head[b] = b = head[head[b]]
        if a == b:
            continue
        x, y = node[a], node[b]
        if size[x] < size[y]:
            a, b, x, y = b, a, y, x
        head[b] = a
        if far[x] == d and far[y] == d:
            if len(parts[x]) < len(parts[y]):
                x, y = y, x
            parts[x] += parts[y]
            size[x] += size[y]
            parts[y], size[y] = [], 0
        elif far[x] == d or far[y] == d:
            if far[y] == d:
                x, y = y, x
            parts[x].append(y)
            size[x] += size[y]
        else:
            far.append(d)
            parts.append([x, y])
            size.append(size[x] + size[y])
            x = len(far) - 1
        node[a] = x
    # Joined clusters of one distance keep either's number, so the root need not be the last made.
    root = node[next(i for i in range(n) if head[i] == i)]
    far.append(far[root])
    parts.append(parts[root])
    size.append(size[root])
    return far, parts, size


def density_labels(stamps: np.ndarray, least: int, neighbours: int, epsilon: float) -> np.ndarray:
    """A label for each of rising, distinct stamps; -1 for noise.

    Cutting the single-linkage tree of ``reach_edges`` at ever smaller distances gives a tree of clusters of ``least`` stamps
    or more; a cluster that falls into several parts at one distance is split once, whatever their order. The clusters of
    greatest excess of mass are chosen, the whole line never; one that appears only under epsilon gives way to the first above
    it that appears over it.
    """
    n = len(stamps)
    if n < 2:
        return np.full(n, -1)
    far, parts, size = merges(n, reach_edges(stamps, core_distances(stamps, neighbours)))
    born, parent, mass, left_in = [0.0], [-1], [0.0], [0] * n
    todo = [(len(far) - 1, 0)]
    while todo:
        at, cluster = todo.pop()
        if at < n:
            left_in[at] = cluster
            continue
        density = 1 / max(far[at], 1e-12)
        big, small = [p for p in parts[at] if size[p] >= least], [p for p in parts[at] if size[p] < least]
        split = len(big) > 1
        mass[cluster] += (size[at] if split else sum(size[p] for p in small)) * (density - born[cluster])
        for p in big:
            if split:
                born.append(density)
                parent.append(cluster)
                mass.append(0.0)
            todo.append((p, len(born) - 1 if split else cluster))
        while small:
            p = small.pop()
            if p < n:
                left_in[p] = cluster
            small += parts[p]
    below, chosen = [0.0] * len(born), [False] * len(born)
    for c in range(len(born) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[parent[c]] += max(mass[c], below[c])
    for c in range(1, len(born)):
        if chosen[c]:
            top, up = c, 1 / born[c] < epsilon
            while up and parent[top] > 0:
                top = parent[top]
                up = 1 / born[top] <= epsilon
            chosen[top] = True
    label = [-1] * len(born)
    for c in range(1, len(born)):  # parents come first
        label[c] = label[parent[c]] if label[parent[c]] >= 0 else c if chosen[c] else -1
    return np.array(label)[left_in]


def density_sessions(events: DataFrame, least: int = 2, neighbours: int = 1, epsilon_s: float = 60.0) -> DataFrame:
    """(did, session_start, session_end, duration_s, is_singleton): runs of stamps of one cluster, and each stamp of none as a session of its own. Users with one stamp have none.

    Distances are whole microseconds, so equal gaps are equal. Rows without a user or a stamp don't count. A user is one task:
    its memory grows with the stamps.
    """

    def sessions(rows: pd.DataFrame) -> pd.DataFrame:
        stamps = np.unique(rows.time_us.to_numpy())
        if len(stamps) < 2:
            return pd.DataFrame({"did": pd.Series([], dtype=object)} | {c: pd.Series([], dtype=t) for c, t in (("session_start", "int64"), ("session_end", "int64"), ("duration_s", "float64"), ("is_singleton", "int32"))})
        labels = density_labels(stamps - stamps[0], least, neighbours, epsilon_s * 1e6)
        begins = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (labels[1:] == -1))))
        ends = np.append(begins[1:], len(stamps)) - 1
        return pd.DataFrame({"did": rows.did.iloc[0], "session_start": stamps[begins], "session_end": stamps[ends], "duration_s": np.round((stamps[ends] - stamps[begins]) / 1e6, 3), "is_singleton": (labels[begins] == -1).astype("int32")})

    return events.select("did", "time_us").dropna().groupBy("did").applyInPandas(sessions, "did string, session_start long, session_end long, duration_s double, is_singleton int")


OPERATORS = (
    O("d6_density_sessions", "Sessions by density.", ("ev",), "", {}, density_sessions),
    O("d6_density_sessions_smooth", "Sessions of three stamps or more by density over three neighbours.", ("ev",), "", {}, partial(density_sessions, least=3, neighbours=3)),
)
