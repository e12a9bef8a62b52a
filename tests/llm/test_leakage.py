import random

from hypothesis import example, given, settings
from hypothesis import strategies as st

from cisweave.llm import alignment, leakage
from cisweave.llm.words import words

RNG = random.Random(8)
VOCAB = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
ITEM = [RNG.choice(VOCAB) for _ in range(60)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@example([1, 0, 1], [1, 0], 2)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 4))
def test_reach_against_edit_distance(a, b, k):
    got = alignment.reach(a, b, k)
    for e in range(k + 1):
        want = max((i for i in range(len(a) + 1) for j in range(len(b) + 1) if distance(a[:i], b[:j]) <= e and (i == 0 or (j > 0 and a[i - 1] == b[j - 1]))), default=0)
        assert got[e] == want


def doc(core, before=15, after=15):
    return " ".join([RNG.choice(["cache", "file", "the", "of", "run"]) for _ in range(before)] + core + ["end"] * after)


def spoil(ws, every):
    return [("changed" if i % every == every - 1 else w) for i, w in enumerate(ws)]


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, terms string, n int")
    i = spark.createDataFrame(items, "item_id long, item_text string, at string")
    return sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect())


def test_passages_whole_partly_and_changed(spark):
    one = [RNG.choice(VOCAB) for _ in range(40)]
    docs = [
        (1, doc(ITEM), "", 0), (2, doc(ITEM[10:30]), "", 0), (3, doc(spoil(ITEM, 9)), "", 0), (4, doc(ITEM[10:26]), "", 0), (5, doc(sorted(ITEM)), "", 0), (6, None, "", 0), (7, "", "", 0),
        (8, doc(ITEM[5:17] + ITEM[18:40]), "", 0), (9, doc(ITEM[5:17] + ["x"] + ITEM[17:40]), "", 0), (10, "> " + "\n> ".join(doc(one).split()), "", 0), (11, doc(spoil(ITEM, 4)), "", 0),
        (12, " ".join(ITEM[:3]), "", 0), (13, "unrelated words " * 5000 + doc(one), "", 0), (1, doc(ITEM), "", 0), (None, doc(ITEM), "", 0),
    ]
    items = [(1, "Read this carefully.\n" + " ".join(ITEM), ""), (2, " ".join(one), ""), (3, None, ""), (4, "too short", ""), (None, " ".join(one), "")]
    assert found(spark, docs, items) == [(1, 1), (1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (10, 2), (13, 2)]


def repeats(item, text, least=20, share=8):
    """Any stretch from an equal word to an equal word, by plain dynamic programming from every pair of equal words."""
    for i in range(len(item) - least + 1):
        for s in range(len(text)):
            if text[s] == item[i]:
                a, b = item[i:], text[s:]
                row = list(range(len(b) + 1))
                for x in range(1, len(a) + 1):
                    prev, row[0] = row[0], x
                    for y in range(1, len(b) + 1):
                        prev, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, prev + (a[x - 1] != b[y - 1]))
                        if x >= least and row[y] * share <= x and a[x - 1] == b[y - 1]:
                            return True
    return False


def test_against_brute_force(spark):
    docs = []
    for n in range(40):
        core = ITEM[RNG.randrange(0, 10) :][: RNG.randrange(12, 40)]
        for _ in range(RNG.randrange(0, 5)):
            at = RNG.randrange(len(core))
            core[at : at + 1] = RNG.choice([["zz"], [], ["zz", core[at]]])
        docs.append((n, doc(core, 5, 5), "", 0))
    want = [(n, 1) for n, text, *_ in docs if repeats(ITEM, text.split())]
    assert 5 < len(want) < 40
    assert found(spark, docs, [(1, " ".join(ITEM), "")]) == want


def test_spelling_of_words():
    plain = words("Le géant n'en a peint que 7.6, \"ici\" - là.")
    assert plain == ["le", "geant", "nen", "a", "peint", "que", "76", "ici", "la"]
    for text in (
        "<p>Le g&eacute;ant <b>n&#39;en</b> a peint que 7.6, &quot;ici&quot; - là.</p>", "LE GÉANT N’EN A PEINT\nQUE 7.6 ICI LÀ", "> Le géant n'en\n> a pe​int\n> que 7.6,\n> ici là",
        "Le gÃ©ant n'en a peint que 7.6 ici l\\u00e0", "\"Le\\ngéant\\tn'en a peint que 7.6 \\\"ici\\\" là\"", "// Le géant n'en a pei­nt\n# que 7.6 ici là",
    ):
        assert words(text) == plain
    assert words(None) == words("") == words(" ​") == []


def test_empty_tables(spark):
    assert found(spark, [], [(1, " ".join(ITEM), "")]) == [] and found(spark, [(1, doc(ITEM), "", 0)], []) == []
    assert found(spark, [(1, "nothing shared", "", 0)], [(1, " ".join(ITEM), "")]) == []


def test_seed_is_long_enough():
    assert leakage.seed_length(20, 8) == 6
