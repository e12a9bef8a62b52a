import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cisweave.llm import containers, packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120), st.integers(50, 120))
def test_every_item_once_and_no_overflow(sizes, capacity):
    bins = packing.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= max(1, len(packing.best_fit([s for s in sizes if s], capacity))) if sizes else not bins


def test_local_search_empties_a_container():
    # best fit leaves 3 containers; swaps pack the same items in 2
    sizes = [6, 6, 5, 5, 5, 3]
    start = [[0, 2], [1, 3], [4, 5]]
    out = packing.local_search(start, sizes, 15)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(6))


def test_two_for_one():
    sizes = [7, 4, 4, 8, 2]
    out = packing.local_search([[0, 1], [2, 3], [4]], sizes, 13)
    assert all(sum(sizes[i] for i in b) <= 13 for b in out) and len(out) == 2


def test_partner_behind_many_equal_containers():
    # 50 for 48 fills the last container, 48 then fits beside 52; the 40 containers of fill 60 can exchange nothing
    start = [[50], [52], *[[60]] * 40, [48, 50]]
    sizes = [s for b in start for s in b]
    at = iter(range(len(sizes)))
    out = packing.local_search([[next(at) for _ in b] for b in start], sizes, 100)
    assert sorted(i for b in out for i in b) == list(range(len(sizes)))
    assert len(out) == 42 and sorted(sum(sizes[i] for i in b) for b in out) == [60] * 40 + [100, 100]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(60, 120))
def test_no_exchange_is_left(sizes, capacity):
    bins = packing.local_search([[i] for i in range(len(sizes))], sizes, capacity)
    held = [{s: [i for i in b if sizes[i] == s] for s in {sizes[i] for i in b}} for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    for low in range(len(bins)):
        for b in range(len(bins)):
            if low != b and fill[low] <= fill[b] < packing.FULL * capacity:
                assert packing._gain(capacity - fill[b], held[low], held[b]) is None


def rows(spark, items, caps, **kw):
    return packing.pack_items(spark.createDataFrame(items, "item long, size int, container string"), spark.createDataFrame(caps, "pack_id int, capacity int, block int")).collect()


def test_blocks_and_divided_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 40)
    rng = random.Random(4)
    items = [(i, rng.choice([0, 5, 30, 77, 260, rng.randrange(1, 400)]), "x") for i in range(500)] + [(900, None, "x"), (901, 100_000, "x"), (1, 3, "x")]
    got = rows(spark, items, [(1, 256, 0), (2, 1024, 0)])
    for pack, cap in ((1, 256), (2, 1024)):
        own = [r for r in got if r.pack_id == pack]
        per_item, fill, n = {}, {}, {}
        for r in own:
            per_item[r.item] = per_item.get(r.item, 0) + r.size
            fill[r.container] = fill.get(r.container, 0) + r.size
            n[r.item] = n.get(r.item, 0) + 1
        want = {}
        for i, s, _ in items:
            if s is not None:
                want[i] = want.get(i, 0) + s
        assert per_item == want and max(fill.values()) <= cap
        assert all(n[i] == max(1, -(-s // cap)) for i, s, _ in items if s is not None and i != 1)
        assert len(fill) <= -(-sum(want.values()) // cap) * 1.02 + 1


def test_items_that_do_not_combine_stay_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 50)
    got = rows(spark, [(i, 520 + i % 480, "x") for i in range(3_000)], [(1, 1024, 0)])
    assert len(got) == len({r.container for r in got}) == 3_000
    blocks = Counter(r.container.rsplit("-", 1)[0] for r in got)
    assert len(blocks) >= 50 and max(blocks.values()) < 110


def test_empty_and_errors(spark):
    assert rows(spark, [], [(1, 10, 0)]) == [] and rows(spark, [(1, 5, "")], []) == []
    with pytest.raises(ValueError):
        rows(spark, [(1, 5, "")], [(1, 0, 0)])


def test_token_counts(spark):
    import tiktoken
    from cisweave.llm.containers import PATTERN

    docs = spark.createDataFrame([(1, "Hello world, it's 42!", 0), (2, "", 0), (3, None, 0), (4, "ab " * 20_000, 0), (5, "<|endoftext|>", 0)], "doc_id long, text string, size int")
    got = {r.item: r.size for r in containers.token_counts(docs).collect()}
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(containers.TOKENIZER, "rb"))}
    e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {1: len(e.encode_ordinary("Hello world, it's 42!")), 2: 0, 4: len(e.encode_ordinary("ab " * 20_000)), 5: len(e.encode_ordinary("<|endoftext|>"))}
