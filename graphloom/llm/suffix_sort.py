"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, then blind tries for long common prefixes."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at, in steps of STEP, before a group goes to a blind trie.
SHALLOW = 16
STEP = 4
#: Groups of so few are ordered by direct comparison.
FEW = 4


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n  # agree up to lo; differ somewhere before hi
    while hi - lo > 8:
        mid = (lo + hi) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


class _Node:
    __slots__ = ("depth", "kids", "leaves")

    def __init__(self, depth: int):
        self.depth, self.kids, self.leaves = depth, {}, []


def blind_trie(texts: list[bytes], own: list[int], depth: int) -> list[int]:
    """``own`` in the order of their texts, which agree up to ``depth``. Inner nodes know a depth and the branching bytes only;
    a text goes down blindly, is compared once with the leaf it reaches, and is put in where they part."""
    root = _Leaf(own[0])
    for i in own[1:]:
        t = texts[i]
        node, path = root, []
        while isinstance(node, _Node):
            path.append(node)
            key = t[node.depth] if len(t) > node.depth else -1
            nxt = node.kids.get(key)
            if nxt is None:
                nxt = next(iter(node.kids.values()))
                while isinstance(nxt, _Node):
                    nxt = next(iter(nxt.kids.values()))
            node = nxt
        other = texts[node.rows[0]]
        common = lcp(t, other, depth)
        if common == len(t) == len(other):
            node.rows.append(i)
            continue
        key = t[common] if len(t) > common else -1
        while path and path[-1].depth > common:
            path.pop()
        if path and path[-1].depth == common:
            path[-1].kids[key] = _Leaf(i)
            continue
        branch = _Node(common)
        parent = path[-1] if path else None
        below = root if parent is None else parent.kids[t[parent.depth] if len(t) > parent.depth else -1]
        branch.kids[other[common] if len(other) > common else -1] = below
        branch.kids[key] = _Leaf(i)
        if parent is None:
            root = branch
        else:
            parent.kids[t[parent.depth] if len(t) > parent.depth else -1] = branch
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, _Leaf):
            out += node.rows
        else:
            todo += [node.kids[k] for k in sorted(node.kids, reverse=True)]
    return out


class _Leaf:
    __slots__ = ("rows",)

    def __init__(self, row: int):
        self.rows = [row]


def order(texts: list[bytes], depth: int = 0) -> list[int]:
    """Indices of the texts in their order; all agree in the first ``depth`` bytes."""
    out: list[int] = []
    end = depth + SHALLOW
    todo = [(list(range(len(texts))), depth)]
    while todo:
        own, at = todo.pop()
        if len(own) <= FEW:
            out += sorted(own, key=lambda i: texts[i][at:])
        elif at >= end:
            out += blind_trie(texts, own, at)
        else:
            keys = [texts[i][at : at + STEP] for i in own]
            pivot = sorted((keys[0], keys[len(keys) >> 1], keys[-1]))[1]
            less = [i for i, k in zip(own, keys, strict=True) if k < pivot]
            more = [i for i, k in zip(own, keys, strict=True) if k > pivot]
            equal = [i for i, k in zip(own, keys, strict=True) if k == pivot]
            # taken from the end: the greater ones are put first
            if more:
                todo.append((more, at))
            if len(pivot) == STEP:
                todo.append((equal, at + STEP))
            else:
                todo.append((equal, end) if len(equal) <= FEW else (equal, at + STEP))
            if less:
                todo.append((less, at))
    return out


def suffix_array(texts: list[bytes], depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The order, and the common prefix of each text in it with the one before (0 for the first)."""
    sa = order(texts, depth)
    common = [0] + [lcp(texts[a], texts[b], depth) for a, b in zip(sa[:-1], sa[1:], strict=True)]
    return np.array(sa, np.int64), np.array(common, np.int64)
