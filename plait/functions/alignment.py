"""Alignment of node sequences: weighted longest common subsequence, and edits between its anchors."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

Handle = tuple[int, bool]
Edits = list[tuple[str, int]]


def path_lcs(a: Sequence, b: Sequence, weight) -> list[tuple[int, int]]:
    """Index pairs of a common subsequence of the largest total weight.

    Matching pairs in order of a, and against the order of b within one a, each extend the best chain that ends at
    a smaller b; a prefix-maximum tree over b gives it. The work is the number of matching pairs times a logarithm.
    """
    where: dict = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    n = len(b)
    tree: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # total weight of a chain, and its last pair
    pairs: list[tuple[int, int, int]] = []  # i, j, the pair before
    for i, x in enumerate(a):
        new = []
        for j in where.get(x, ()):
            best, at = (0, -1), j
            while at > 0:
                best = max(best, tree[at])
                at -= at & -at
            new.append((j, best))
        for j, (total, before) in new:
            pairs.append((i, j, before))
            entry, at = (total + weight(x), len(pairs) - 1), j + 1
            while at <= n:
                if entry[0] > tree[at][0]:
                    tree[at] = entry
                at += at & -at
    best, at = (0, -1), n
    while at > 0:
        best = max(best, tree[at])
        at -= at & -at
    out, k = [], best[1]
    while k >= 0:
        i, j, k = pairs[k]
        out.append((i, j))
    return out[::-1]


def _add(edits: Edits, op: str, n: int) -> None:
    if n and edits and edits[-1][0] == op:
        edits[-1] = (op, edits[-1][1] + n)
    elif n:
        edits.append((op, n))


def _gap(n: int) -> int:
    """Cost of opening and extending a gap."""
    return 5 + n if n else 0


def align_diverging(query: str, reference: str, edits: Edits) -> None:
    """Common ends match; of the rest, mismatches (4 a base) with a gap, or an insertion and a deletion, whichever costs less."""
    shorter = min(len(query), len(reference))
    head = next((i for i in range(shorter) if query[i] != reference[i]), shorter)
    rest = shorter - head
    tail = next((i for i in range(rest) if query[-1 - i] != reference[-1 - i]), rest)
    _add(edits, "M", head)
    q, r = len(query) - head - tail, len(reference) - head - tail
    both = min(q, r)
    if both and 4 * both + _gap(q - both) + _gap(r - both) <= _gap(q) + _gap(r):
        _add(edits, "M", both)
        q, r = q - both, r - both
    _add(edits, "I", q)
    _add(edits, "D", r)
    _add(edits, "M", tail)


def align(query: Sequence[Handle], reference: Sequence[Handle], label) -> Edits:
    """Edits that turn the reference walk into the query walk; label(handle) is a node's oriented sequence."""
    edits: Edits = []
    i = j = 0
    text = lambda walk: "".join(map(label, walk))
    for x, y in path_lcs(query, reference, lambda h: len(label(h))):
        align_diverging(text(query[i:x]), text(reference[j:y]), edits)
        _add(edits, "M", len(label(query[x])))
        i, j = x + 1, y + 1
    align_diverging(text(query[i:]), text(reference[j:]), edits)
    return edits


def to_cigar(edits: Edits) -> str:
    return "".join(f"{n}{op}" for op, n in edits)


def position_in(starts: Sequence[int], offset: int) -> int:
    """The last interval that starts at or before an offset."""
    return bisect_left(starts, offset + 1) - 1
