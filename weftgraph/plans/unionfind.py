"""Connected sets and spanning forests of edges that fit in one task, with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def min_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` vertices the least vertex of its component: hooking on the lesser root, then pointer jumping."""
    root = np.arange(n, dtype=np.int64)
    while len(src):
        a, b = root[src], root[dst]
        apart = a != b
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def forest_edges(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: every vertex to the least one."""
    names, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root = min_labels(both[: len(src)], both[len(src) :], len(names))
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[root[other]], names[other]


#: Edges that are held before they are folded to a forest.
FOLD = 1 << 20


def _folded(batches: Iterable[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of all edges, folded as they come: twice the forest or FOLD edges are held, whichever is more."""
    src, dst = np.empty(0, np.int64), np.empty(0, np.int64)
    new: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        new.append((batch["src"].to_numpy(np.int64), batch["dst"].to_numpy(np.int64)))
        size += len(batch)
        if size >= max(FOLD, len(src)):
            src, dst = forest_edges(*(np.concatenate(x) for x in zip((src, dst), *new)))
            new, size = [], 0
    return forest_edges(*(np.concatenate(x) for x in zip((src, dst), *new)))


def _forest(frames: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    return forest_edges(*(np.concatenate([np.empty(0, np.int64), *(f[end].to_numpy(np.int64) for f in frames)]) for end in ("src", "dst")))


def forest_of_partition(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as stars. Where a partition's forest does not stay small it is put out in parts of at least
    FOLD edges, so that memory does not grow with the partition."""
    kept: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += len(batch)
        if size >= FOLD:
            src, dst = _forest(kept)
            kept, size = [pd.DataFrame({"src": src, "dst": dst})], len(src)
            if size >= FOLD // 2:  # it does not shrink
                yield kept[0]
                kept, size = [], 0
    src, dst = _forest(kept)
    yield pd.DataFrame({"src": src, "dst": dst})


def label_all(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels of all vertices of all batches: ``v, label``. Loops count, so that their vertices have labels, too."""
    loops: list[np.ndarray] = []

    def noted() -> Iterator[pd.DataFrame]:
        for batch in batches:
            loops.append(np.unique(batch["src"].to_numpy(np.int64)[batch["src"].to_numpy() == batch["dst"].to_numpy()]))
            yield batch

    src, dst = _folded(noted())
    names = np.concatenate([src, dst, *loops])
    label = np.concatenate([src, src, *loops])
    names, first = np.unique(names, return_index=True)  # a star's centre is its least vertex
    if len(names):
        yield pd.DataFrame({"v": names, "label": label[first]})
