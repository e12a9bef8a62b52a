"""Longest stretch of a pattern that a text repeats with few edits, from an exact seed outwards."""

from __future__ import annotations

from collections.abc import Sequence


def reach(a: Sequence[int], b: Sequence[int], edits: int) -> list[int]:
    """For e = 0..edits: the longest prefix of `a` that some prefix of `b` equals up to e changed, dropped or added
    words, ending in an equal word. Diagonal by diagonal, furthest point first."""
    n, m = len(a), len(b)

    def slide(i: int, d: int) -> int:
        j = i + d
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    best = slide(0, 0)
    out = [best]
    front = {0: best}
    for e in range(1, edits + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):
            # a step beyond an end stands for the diagonal's last point, which is no further
            i = min(max(front.get(d, -2) + 1, front.get(d + 1, -2) + 1, front.get(d - 1, -2)), n, m - d)
            if i < 0 or i + d < 0:
                continue
            new[d] = end = slide(i, d)
            # every point up to the furthest of a diagonal is within e edits; the last equal word there ends the prefix
            while end > best and not (end + d > 0 and a[end - 1] == b[end + d - 1]):
                end -= 1
            best = max(best, end)
        front = new
        out.append(best)
    return out


def stretch(item: Sequence[int], text: Sequence[int], at: int, on: int, length: int, least: int, share: int) -> tuple[int, int]:
    """(words of item, edits) of the longest stretch around the seed item[at:at+length] == text[on:on+length] with at
    most one edit in `share` words; (0, 0) if it has fewer than `least` words. The two sides are independent."""
    k = len(item) // share
    span = len(item) + k
    right = reach(item[at + length :], text[on + length : on + length + span], k)
    left = reach(item[:at][::-1], text[max(0, on - span) : on][::-1], k)
    found = (0, 0)
    for el, l in enumerate(left):
        for er, r in enumerate(right):
            if el + er <= k and l + r + length >= max(least, share * (el + er)) and l + r + length > found[0]:
                found = (l + r + length, el + er)
    return found
