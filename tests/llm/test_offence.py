import numpy as np
import pandas as pd
import pytest

from cisweave.llm import offence
from cisweave.llm.spelling import sentences
from cisweave.llm.string_svm import Kernel, Sparse, landmarks, occurrences, train

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, want",
    [
        ("You are a 5tup1d 455h0l3", "you are a stupid asshole"), ("you b.a.s.t.a.r.d.", "you bastard"), ("an i d i o t here", "an idiot here"), ("fuck​ing m​oron", "fucking moron"), ("nаkеd", "naked"),
        ("> You\n> total\n> moron", "you total moron"), ("raaats", "rats"), ("you u*****s l***r", "you * *"), ("// IDIOT", "idiot"), ('<a href="http://x.y/z">idiot</a>', "idiot"),
    ],
)
def test_spelling(text, want):
    assert sentences(text) == [want]


def test_sentences_cover_the_whole_text():
    long = " ".join(f"word{'a' * (i % 5)}x" for i in range(500)) + " end"
    out = sentences(long)
    assert len(out) > 10 and out[-1].endswith("end") and max(len(s.split()) for s in out) <= 48
    assert sentences(None) == sentences("") == sentences("!!! ...") == []
    assert len(sentences("a" * 5000)) >= 1


def brute_kernel(a, b, k):
    """Direct sum over common subsequences of characters and words."""
    from itertools import combinations

    def profile(s):
        out = {}
        t = f" {s} "
        for seq, length, w in [(t, k.letters, 1.0)] + [(s.split(), n, k.word if n == 1 else k.words) for n in (1, 2, 3)]:
            gap = k.gap if length > 1 else 0
            for i in range(len(seq)):
                for rest in combinations(range(i + 1, min(len(seq), i + length + gap)), length - 1):
                    key = (length, type(seq) is str, tuple(seq[j] for j in (i, *rest)))
                    span = (rest[-1] if rest else i) - i + 1
                    out[key] = out.get(key, 0) + w * k.decay ** (span - length)
        return out

    pa, pb = profile(a), profile(b)
    dot = sum(v * pb.get(x, 0) for x, v in pa.items())
    norm = [np.sqrt(sum(v * v for v in p.values()) + k.ground**2) for p in (pa, pb)]
    return dot / norm[0] / norm[1]


def test_kernel_equals_the_definition():
    k = Kernel()
    a, b = "you total moron", "you utter m moron"
    rows = Sparse.of([a, b], k)
    assert rows.times(rows.row(0))[1] == pytest.approx(brute_kernel(a, b, k), rel=1e-3)


def test_landmarks_explain_the_kernel():
    strings = ["go away you fool", "go away you old fool", "the cache is cold", "the cache is warm", "read the file"]
    rows = Sparse.of(strings, Kernel())
    at, kernels = landmarks(rows, 5)
    full = np.array([rows.times(rows.row(i)) for i in range(5)])
    approx = kernels @ np.linalg.pinv(kernels[at]) @ kernels.T
    assert np.allclose(approx, full, atol=1e-3)


def test_folded_machine_equals_kernel_expansion():
    strings = ["you stupid fool", "you idiot", "what a moron you are", "the cache is cold", "read the file again", "a b c d"]
    y = np.array([1, 1, 1, -1, -1, -1])
    m = train(strings, y)
    assert (np.sign(m.score(strings)) == y).all()
    assert m.score(["you st-upid fo ol".replace("-", "")])[0] > m.score(["the cold file"])[0]


def labels():
    return pd.read_parquet(f"{FOLDER}/content_labels.parquet")


def test_held_out_accuracy():
    rows = labels().dropna(subset=["label"]).reset_index(drop=True)
    test = rows["example_id"].astype(int) % 4 == 0
    m = offence.fit(rows[~test])
    held = rows[test]
    got = np.array([max(m.score(s), default=-9) > offence.THRESHOLD if (s := sentences(t)) else False for t in held["example_text"]])
    truth = (held["label"] != "none").to_numpy()
    assert (got == truth).mean() > 0.9  # a few labels are wrong


def test_scores_in_spark(spark):
    docs = spark.createDataFrame(
        [(1, "Delete your account, you disgusting moron.", "a"), (2, "The cache is stale. Read it again.", "a"), (3, None, "b"), (4, "", "b"), (5, "...", None), (6, "The plan is fine. " * 3000 + "Go crawl back under your rock, you halfwit.", "b"), (2, "The cache is stale. Read it again.", "a")],
        "doc_id long, text string, source string",
    )
    m, said = offence.fit(labels()), offence.distinct_sentences(docs)
    rows = offence.scores(docs, said, m, ("doc_id", "source")).collect()
    got = {r.doc_id: r.score for r in rows}
    assert len(rows) == docs.count()
    assert got[1] > 0 and got[6] > 0 and got[2] < 0 and got[3] is None and got[4] is None and got[5] is None
    assert sorted(r.doc_id for r in offence.cases(offence.scores(docs, said, m)).collect()) == [1, 6]
    assert offence.scores(docs.limit(0), said, m).count() == 0 and offence.distinct_sentences(docs.limit(0)).count() == 0
    assert {r.score for r in offence.scores(docs, said, None).collect()} == {None}
    assert offence.fit(labels().head(0)) is None
    assert offence.exemplars(offence.distinct_sentences(docs.limit(0)), labels()) == offence.Exemplars()


def corpus(spark, copies=1):
    """An insult of which the labels know nothing, said to someone or in disguise a third of the time; a harmless sentence
    that is as frequent; one that is in disguise only in the copies of one text."""
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = []
    for i in range(120):
        first = ("@123: " if i % 6 == 0 else "") + ("Y.o.d.e.l.l.i.n.g" if i % 6 == 1 else "Yodelling") + f" turnips like {names[i % 5]} rot brains."
        docs.append((i, f"{first} Text {names[i % 6]} {'x' * (i % 40 + 1)}."))
        docs.append((1_000 + i, f"Greetings to {names[i % 5]} and all. Text {names[i % 6]} {'y' * (i % 40 + 1)}."))
    docs += [(5_000 + i, "@123: Greetings to omega and all.") for i in range(copies)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_exemplars_by_counts_over_all_texts(spark):
    got = offence.exemplars(offence.distinct_sentences(corpus(spark)), labels())
    assert any("yodelling turnips" in s for s in got.offending) and not any("greetings" in s for s in got.offending)
    assert any("greetings" in s for s in got.harmless) and not any("yodelling" in s for s in got.harmless)
    again = offence.exemplars(offence.distinct_sentences(corpus(spark, 80).repartition(7)), labels())
    assert again == got  # copies of a text are one text


def test_cases_hardly_depend_on_the_draw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    said = offence.distinct_sentences(docs).cache()
    own = offence.exemplars(said, labels())
    counts = []
    for k in range(5):
        rows = labels().sample(frac=0.9, random_state=k).sort_values("example_id")
        m = offence.fit(rows, own)
        assert (m.score(["no", "in", "moin", "hola a todos"]) < offence.THRESHOLD).all()
        counts.append(offence.cases(offence.scores(docs, said, m)).count())
    said.unpersist()
    assert max(counts) - min(counts) <= max(4, 0.25 * np.median(counts)), counts


def greeted(spark):
    """Insults of which the labels know nothing, a third of them said to someone and a third in disguise; most of the latter
    after a greeting that many texts have as a sentence of its own."""
    insults = ["Yodelling turnips like {} rot brains", "Nobody ever missed a gherkin like {} here", "Your whole street laughs at {} by day", "Take {} and sink with it in a bog"]
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    docs = []
    for k, insult in enumerate(insults):
        for i in range(90):
            first, rest = insult.format(names[i % 5]).split(" ", 1)
            said = [f"@123: {first} {rest}", f"{'Hey everyone, ' if k < 2 or i % 2 else ''}{'.'.join(first)} {rest}", f"{first} {rest}"][i % 3]
            docs.append((100 * k + i, f"{said}. Text {names[i % 5]} {'x' * (i % 60 + 1)} {'w' * (i % 50 + 1)}."))
    docs += [(1_000 + i, f"Hey everyone. Text {names[i % 5]} {'y' * (i % 60 + 1)} {'z' * (i % 50 + 1)}.") for i in range(600)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_a_greeting_before_insults_makes_no_cases_of_greetings(spark):
    got = offence.exemplars(offence.distinct_sentences(greeted(spark)), labels())
    assert len(got.offending) >= 4 and not any("hey everyone" in s for s in got.offending)
    assert "hey everyone" in got.harmless and got.trust["hey everyone"] > 1
    # where no other sentence can be drawn, evidence outweighs a few such insults
    rows = labels()
    own = [s for t, k in zip(rows["example_text"], rows["label"]) if k not in ("none", None) for s in sentences(t)[-1:]]
    few = [f"hey everyone {s}" for s in sorted(set(own))[::10]]
    score = offence.fit(rows, offence.Exemplars(few, ["hey everyone"], {"hey everyone": 100})).score(["hey everyone", *few])
    assert score[0] < -0.9 and (score[1:] > 0.5).all()


def test_hashes_of_many_subsequences_stay_apart():
    rng = np.random.default_rng(1)
    strings = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60)) for _ in range(1_500)]

    def exact():
        from itertools import combinations

        out = set()
        for t in (f" {s} " for s in strings):
            for steps in combinations(range(1, 4 + Kernel().gap), 3):
                out.update((t[i], *(t[i + j] for j in steps)) for i in range(len(t) - steps[-1]))
        return out

    assert len(np.unique(occurrences(strings, Kernel())[1])) == len(exact()) + len(strings)  # every string is a word too


def test_no_weight_for_unseen_subsequences():
    m = train(["you stupid fool", "you idiot", "the cache is cold", "read the file again"], np.array([1, 1, -1, -1]))
    assert (m.score(["zqxj vwkz qqzx jjvk " * 50]) == m.bias).all()
