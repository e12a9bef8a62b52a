"""Items of varying size into containers of fixed capacity with little unused space.

Items are spread over blocks by hash; a block is packed best-fit decreasing and then improved by local search: between
underfull containers items are moved, swapped one for one or two for one, whenever that raises the sum of squared fills,
until the emptiest containers are empty. Items of containers that stay underfull go on to the next level, where they are
spread over as many blocks as they fill; so the space lost to blocks does not add up. Levels end when one block is left,
or when a level closed less than GAINED of its items: what is left then, such as items above half the capacity, does not
combine any better, and its containers stay as they are. No task ever holds more than about BLOCK_ITEMS items. Only an
item above the capacity is divided, into full pieces and a rest.

Defined results: null sizes are left out; items of size 0 take no space and join the last container of their block; equal
sizes are packed in the order of their keys; null capacities are left out, one below 1 is an error.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cisweave import storage

BLOCK_ITEMS = 8_192
#: least share of a level's items in closed containers for another level to follow
GAINED = 0.1
#: capacities at a time; they are a setting, not data
MOST_PACKS = 1_000
#: share of the capacity from which a container is final before the last level
FULL = 0.998
PACKED = "pack_id int, capacity int, item long, piece int, size int, block long, container long, level int, is_open boolean"


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: containers as lists of positions. Free space is looked up in one integer used as a bit set."""
    by_room: dict[int, list[int]] = {}
    rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room.setdefault(room - s, []).append(b)
        rooms |= 1 << (room - s)
    return bins


def _gain(gap: int, mine: dict[int, list[int]], theirs: dict[int, list[int]]) -> tuple[int, list[int], list[int]] | None:
    """The exchange that gives the other container the most, at most `gap`: what leaves mine, what comes back (sizes)."""
    best: tuple[int, list[int], list[int]] | None = None
    mine_s, their_s = sorted(mine), sorted(theirs)

    def offer(out: list[int], back: list[int]) -> bool:
        nonlocal best
        d = sum(out) - sum(back)
        if 0 < d <= gap and (best is None or d > best[0]):
            best = (d, out, back)
        return best is not None and best[0] == gap

    for x in mine_s:
        if offer([x], []):
            return best
    for x in mine_s:
        for y in their_s:
            if x > y and offer([x], [y]):
                return best
    pairs = [(x + z, x, z) for i, x in enumerate(mine_s) for z in mine_s[i:] if x != z or len(mine[x]) > 1]
    for s, x, z in pairs:
        for y in their_s:
            if offer([x, z], [y]):
                return best
    pairs = [(y + z, y, z) for i, y in enumerate(their_s) for z in their_s[i:] if y != z or len(theirs[y]) > 1]
    sums = {s: (y, z) for s, y, z in pairs}
    for x in mine_s:
        for s in sums:
            if offer([x], list(sums[s])):
                return best
    return best


def local_search(bins: list[list[int]], sizes: Sequence[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Exchanges between underfull containers, each of which raises the sum of squared fills, until none does: the
    emptier one gives to the fuller one by a move, a swap of one for one or of two for one; empty containers go. One
    filled to `full` is left alone. Containers of the same sizes are one profile. A container is tried against every
    profile at least as full, the one with most room first, and never again against one that its own profile was tried
    with in vain."""
    groups: list[dict[int, list[int]]] = [{} for _ in bins]
    for b, items in enumerate(bins):
        for i in items:
            groups[b].setdefault(sizes[i], []).append(i)
    fill = [sum(sizes[i] for i in items) for items in bins]
    number: dict[tuple, int] = {}
    members: list[dict[int, None]] = []
    born: list[int] = []  # when a profile got its first or second member
    tried: list[int] = []  # when a profile was last tried against all others in vain
    profile = [-1] * len(bins)
    order: list[tuple[int, int]] = []  # (fill, profile) of those with members
    clock = 0

    def live(b: int) -> bool:
        return 0 < fill[b] < full * capacity

    def enter(b: int) -> None:
        nonlocal clock
        if not live(b):
            return
        p = profile[b] = number.setdefault(tuple(sorted((s, len(own)) for s, own in groups[b].items())), len(number))
        if p == len(members):
            members.append({})
            born.append(0)
            tried.append(-1)
        members[p][b] = None
        if len(members[p]) == 1:
            insort(order, (fill[b], p))
        if len(members[p]) <= 2:
            clock += 1
            born[p] = clock

    def leave(b: int) -> None:
        p = profile[b]
        del members[p][b]
        if not members[p]:
            del order[bisect_left(order, (fill[b], p))]

    def partner(low: int) -> tuple[int, tuple[int, list[int], list[int]]] | None:
        p = profile[low]
        if tried[p] < clock:
            for n in range(bisect_left(order, (fill[low], -1)), len(order)):
                q = order[n][1]
                if born[q] > tried[p] and (b := next((b for b in members[q] if b != low), None)) is not None:
                    found = _gain(capacity - fill[b], groups[low], groups[b])
                    if found is not None:
                        return b, found
            tried[p] = clock
        return None

    for b in range(len(bins)):
        enter(b)
    changed = True
    while changed:
        changed = False
        for low in sorted(filter(live, range(len(bins))), key=lambda b: (fill[b], b)):
            while live(low) and (found := partner(low)) is not None:
                b, (d, out, back) = found
                leave(low)
                leave(b)
                for sent, source, target in ((out, low, b), (back, b, low)):
                    for s in sent:
                        i = groups[source][s].pop()
                        if not groups[source][s]:
                            del groups[source][s]
                        groups[target].setdefault(s, []).append(i)
                fill[low] -= d
                fill[b] += d
                enter(low)
                enter(b)
                changed = True
    return [items for g in groups if (items := [i for own in g.values() for i in own])]


def pack(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions; no size may exceed the capacity."""
    some = [i for i, s in enumerate(sizes) if s > 0]
    bins = local_search(best_fit([sizes[i] for i in some], capacity), [sizes[i] for i in some], capacity)
    bins = [[some[i] for i in b] for b in bins]
    rest = [i for i, s in enumerate(sizes) if s == 0]
    if rest:
        bins = bins or [[]]
        bins[-1] = bins[-1] + rest
    return bins


def _pack_level(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
        sizes, capacity = pdf["size"].astype(int).tolist(), int(pdf["capacity"].iloc[0])
        container = np.zeros(len(pdf), np.int64)
        is_open = np.zeros(len(pdf), bool)
        for n, b in enumerate(pack(sizes, capacity)):
            container[b] = n
            is_open[b] = not last and sum(sizes[i] for i in b) < FULL * capacity
        return pdf.assign(container=container, level=level, is_open=is_open)[[c.split()[0] for c in PACKED.split(", ")]]

    return run


def pieces(items: DataFrame, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """(pack_id, capacity, item, piece, size): items (item, size) for each (pack_id, capacity), those above it divided."""
    each = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for p, c in capacities])
    one = items.where("size IS NOT NULL").select(F.col("item").cast("long"), "size", F.explode(each).alias("c")).select("c.*", "item", "size")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int")
    part = F.least(F.col("capacity"), F.col("size") - (F.col("piece") - 1) * F.col("capacity")).cast("int")
    return one.withColumn("piece", F.explode(F.sequence(F.lit(1), n))).select("pack_id", "capacity", "item", "piece", part.alias("size"))


def pack_items(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_id, container, item, piece, size): every piece in one container. items: (item long, size int)."""
    packs = [tuple(r) for r in capacities.select("pack_id", "capacity").where("pack_id IS NOT NULL AND capacity IS NOT NULL").distinct().sort("pack_id").limit(MOST_PACKS + 1).collect()]
    if len(packs) > MOST_PACKS or any(c < 1 for _, c in packs):
        raise ValueError(f"more than {MOST_PACKS} capacities, or one below 1")
    if not packs:
        return items.sparkSession.createDataFrame([], "pack_id int, container string, item long, piece int, size int")
    todo = storage.materialise(pieces(items, packs), "pieces")
    done, level = None, 0
    while True:
        held = {r[0]: r[1] for r in todo.groupBy("pack_id").count().collect()}  # at most MOST_PACKS
        blocks = math.ceil(max(held.values(), default=1) / BLOCK_ITEMS)
        last = blocks == 1
        spread = todo.withColumn("block", F.pmod(F.xxhash64("item", "piece", F.lit(level)), F.lit(blocks)))
        packed = storage.materialise(spread.groupBy("pack_id", "block").applyInPandas(_pack_level(level, last), PACKED), f"packed{level}")
        left = 0 if last else packed.where("is_open").count()
        if left > (1 - GAINED) * sum(held.values()):
            left, packed = 0, packed.withColumn("is_open", F.lit(False))
        closed = packed.where("NOT is_open")
        done = closed if done is None else done.unionByName(closed)
        if not left:
            break
        level += 1
        todo = packed.where("is_open").drop("container", "level", "is_open", "block")
    return done.select("pack_id", F.concat_ws("-", "level", "block", "container").alias("container"), "item", "piece", "size")
