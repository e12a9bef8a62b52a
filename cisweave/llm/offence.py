"""Score of abusive, hateful or sexual content for every document, from labelled sentences.

A string-kernel machine (`string_svm`) is trained on the labelled sentences and on sentences of the corpus about which
counts over all documents leave no doubt. Offenders address people and disguise their spelling far more often than
others do; how often, the labels and the corpus say. Each occurrence of a phrase of three words is such evidence for or
against it (a log likelihood ratio; copies of a text count once for each author, or once), and phrases with much of it give one sentence each:
offending ones said so in several texts, and harmless ones that are widespread and are never said so. A sentence that is
widespread as it is counts as much as its evidence, so that what else a few texts say along with it, such as a greeting
before an insult, does not make cases of all the others that have it. Labels that models trained on the other folds
contradict clearly are left out. A document's score is that of its worst sentence, over its
whole text; it is a case above 0, the machine's own boundary.

Defined results: a null or empty text, or one without letters, has a null score and is no case; null labels are not
used; with fewer than one label of either kind every score is null; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cisweave import storage
from cisweave.llm.spelling import MANNERS, sentences, sentences_said
from cisweave.llm.string_svm import Machine, train

#: bound of the labelled rows that the classifier is fitted on
MOST_LABELS = 5_000
CONTRADICTED = 0.5
THRESHOLD = 0.0
CHUNK = 1_000
WORDS = 3
#: least evidence of an offending phrase, also as a share of all such evidence; together they bound how many there are
OFFENDING, OFFENDING_SHARE = 5.0, 2e-4
#: most evidence of a harmless phrase, and the least share of the texts that hold it; these bound their number too
HARMLESS, HARMLESS_SHARE = -4.0, 3e-3
#: least share of the texts that hold a harmless sentence as it is
SENTENCE_SHARE = 5e-4
#: sentences drawn, by hash, for a harmless phrase
DRAWN = 4
#: most landmarks that are chosen by trust
MORE = 250


def labelled(rows: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sentences, +1 or -1, example number). Of an offending example all sentences but the worst are dropped later."""
    strings, y, of = [], [], []
    for n, (text, label) in enumerate(zip(rows["example_text"], rows["label"])):
        if isinstance(label, str) and label.strip():
            for s in sentences(text):
                strings.append(s)
                y.append(-1 if label.strip().lower() == "none" else 1)
                of.append(n)
    return strings, np.array(y), np.array(of)


def _worst_only(strings: list[str], y: np.ndarray, of: np.ndarray, machine: Machine) -> np.ndarray:
    """Which strings to train on: every harmless one, and of an offending example the one that scores highest."""
    score = machine.score(strings)
    order = np.lexsort((-score, of))
    first = np.r_[True, of[order][1:] != of[order][:-1]]
    use = y < 0
    use[order[first]] = True
    return use


def _once(strings: list[str], y: np.ndarray, of: np.ndarray, most: int) -> Machine:
    """A first machine from examples of one sentence, then one from the worst sentence of each."""
    single = (y < 0) | (np.bincount(of)[of] == 1)
    machine = train([s for s, u in zip(strings, single) if u], y[single], most=most)
    use = _worst_only(strings, y, of, machine)
    return machine if (use == single).all() else train([s for s, u in zip(strings, use) if u], y[use], most=most)


@dataclass(frozen=True)
class Exemplars:
    """Sentences of the corpus taken for offending or harmless."""

    offending: list[str] = field(default_factory=list)
    harmless: list[str] = field(default_factory=list)
    #: of harmless ones that are widespread as they are: how many times the least evidence they have
    trust: dict[str, int] = field(default_factory=dict)


def fit(labels: pd.DataFrame, exemplars: Exemplars = Exemplars(), folds: int = 3) -> Machine | None:
    strings, y, of = labelled(labels)
    if not (y > 0).any() or not (y < 0).any():
        return None
    fold = np.array([crc32(s.encode()) % folds for s in strings])
    fold = fold[np.searchsorted(of, of)]  # an example is in one fold
    score = np.zeros(len(y))
    for f in range(folds):
        inside = fold != f
        if (y[inside] > 0).any() and (y[inside] < 0).any() and not inside.all():
            score[~inside] = _once([s for s, i in zip(strings, inside) if i], y[inside], of[inside], 150).score([s for s, i in zip(strings, inside) if not i])
    best = pd.Series(score).groupby(of).transform("max").to_numpy()
    keep = ~(((y > 0) & (best < -CONTRADICTED)) | ((y < 0) & (best > CONTRADICTED)))
    strings, y, of = [s for s, k in zip(strings, keep) if k], y[keep], of[keep]
    use = _worst_only(strings, y, of, _once(strings, y, of, 300))
    own = [s for s, u in zip(strings, use) if u]
    more = exemplars.offending + exemplars.harmless
    trust = np.r_[np.ones(len(own) + len(exemplars.offending)), [exemplars.trust.get(s, 1) for s in exemplars.harmless]]
    return train(own + more, np.r_[y[use], np.ones(len(exemplars.offending)), -np.ones(len(exemplars.harmless))], trust, most=500, more=MORE if exemplars.trust else 0)


def manner_rates(labels: pd.DataFrame) -> tuple[dict[int, float], dict[int, float]]:
    """Of the sentences of offending and of harmless examples, the share said in each manner (half a count added)."""
    said = [(m, label.strip().lower() != "none") for text, label in zip(labels["example_text"], labels["label"]) if isinstance(label, str) and label.strip() for _, m in sentences_said(text)]
    rates = []
    for kind in (True, False):
        own = [m for m, offends in said if offends is kind]
        rates.append({b: (sum(bool(m & b) for m in own) + 0.5) / (len(own) + 1) for b in MANNERS})
    return rates[0], rates[1]


def distinct_sentences(documents: DataFrame) -> DataFrame:
    """(t, authors, s, m): the sentences and their manners of each distinct text, t being its hash, and how many authors wrote
    it; rows without an author are one's together, and so are all if documents have no column author_id."""
    author = F.coalesce(F.col("author_id").cast("string"), F.lit("")) if "author_id" in documents.columns else F.lit("")
    texts = documents.where("text IS NOT NULL").select(F.xxhash64("text").alias("t"), "text", author.alias("author"))
    texts = texts.groupBy("t").agg(F.any_value("text").alias("text"), F.count_distinct("author").alias("authors"))

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [sentences_said(text) for text in pdf["text"]]
            yield pd.DataFrame({"t": pdf["t"], "authors": pdf["authors"], "s": [[s for s, _ in x] for x in said], "m": [[m for _, m in x] for x in said]})

    return texts.mapInPandas(divide, "t long, authors long, s array<string>, m array<int>")


def _keys(s: str) -> list[int]:
    """Hashes of a sentence as a whole, then of its distinct phrases, its ends being words."""
    w = f"^ {s} $".split(" ")
    return [xxh64_intdigest("=" + s) >> 1, *dict.fromkeys([xxh64_intdigest(" ".join(w[i : i + WORDS])) >> 1 for i in range(len(w) - WORDS + 1)])]


def _each(pdf: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
    """(sentence, manner, how often it counts): one said in no manner counts for each author of the text, one said in a
    manner once, as copies prove nothing."""
    for authors, own, manners in zip(pdf["authors"], pdf["s"], pdf["m"]):
        for s, m in zip(own, manners):
            yield s, int(m), 1 if m else int(authors)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        strings: Counter[tuple[str, int]] = Counter()
        for s, m, k in _each(pdf):
            strings[s, m] += k
        n: Counter[tuple[int, int, bool]] = Counter()
        for (s, m), k in strings.items():
            whole = True
            for p in _keys(s):
                n[p, m, whole] += k
                whole = False
        out = pd.DataFrame(list(n), columns=["p", "m", "whole"])
        yield out.assign(n=list(n.values())).astype({"p": "int64", "m": "int32", "whole": "bool", "n": "int64"})


def exemplars(said: DataFrame, labels: pd.DataFrame) -> Exemplars:
    """Sentences that counts over all texts show to be offending or harmless. said: of distinct_sentences()."""
    rows = said.select(F.explode("m").alias("m"))
    with_manner = [F.sum(F.when(F.col("m").bitwiseAND(b) != 0, 1).otherwise(0)).alias(f"b{b}") for b in MANNERS]
    total = rows.agg(F.count("*").alias("n"), *with_manner).first()
    if not total["n"]:
        return Exemplars()
    offending, harmless = manner_rates(labels)
    odds = F.lit(0.0)
    for b in MANNERS:
        # of harmless sentences at most the share of all; a manner that labels do not set apart is no evidence
        q, q0 = offending[b], (total[f"b{b}"] + 0.5) / (total["n"] + 1)
        if q > harmless[b] and q > q0:
            odds = odds + F.when(F.col("m").bitwiseAND(b) != 0, float(np.log(q / q0))).otherwise(float(np.log((1 - q) / (1 - q0))))
    n_texts = said.agg(F.sum("authors")).first()[0]
    counted = said.mapInPandas(_count, "p long, m int, whole boolean, n long").groupBy("p", "whole").agg(F.sum("n").alias("n"), F.sum(odds * F.col("n")).alias("e"), F.sum(F.when(F.col("m") > 0, F.col("n"))).alias("n_said"))
    offends = ~F.col("whole") & (F.col("e") > OFFENDING) & (F.col("n_said") > 1)
    share = F.when(F.col("whole"), SENTENCE_SHARE).otherwise(HARMLESS_SHARE)
    strong = storage.materialise(counted.where(offends | ((F.col("e") < HARMLESS) & (F.col("n") >= share * n_texts))).select("p", "whole", "e"), "phrases")
    least = OFFENDING_SHARE * (strong.where("e > 0").agg(F.sum("e")).first()[0] or 0.0)
    # the shares bound this table
    chosen = strong.where((F.col("e") < 0) | (F.col("e") > least)).collect()
    kinds = {r["p"]: r["e"] > 0 for r in chosen}
    wholes = {r["p"]: max(1, round(r["e"] / HARMLESS)) for r in chosen if r["whole"]}
    shared = said.sparkSession.sparkContext.broadcast(kinds)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best: dict[tuple[int, int], tuple[int, str]] = {}
            for s, m in {(s, m) for s, m, _ in _each(pdf)}:
                held = [p for p in _keys(s) if p in shared.value]
                many = sum(shared.value[p] for p in held)
                if many > 1 and m or held and not many:
                    # an offending one that holds a harmless phrase too only where there is no other
                    last = (0 < many < len(held)) << 62
                    lots = [(xxh64_intdigest(s, seed=k) >> 2 | last, s) for k in range(1 if many else DRAWN)]
                    for p in held:
                        if shared.value[p] == bool(many):
                            for k, lot in enumerate(lots):
                                if (p, k) not in best or lot < best[p, k]:
                                    best[p, k] = lot
            yield pd.DataFrame([(p, k, lot, s) for (p, k), (lot, s) in best.items()], columns=["p", "k", "lot", "s"]).astype({"p": "int64", "k": "int32", "lot": "int64"})

    drawn = said.mapInPandas(draw, "p long, k int, lot long, s string").groupBy("p", "k").agg(F.min(F.struct("lot", "s")).alias("x")).select("p", "x.s").collect()
    trust = {r["s"]: wholes[r["p"]] for r in drawn if r["p"] in wholes}
    return Exemplars(*(sorted({r["s"] for r in drawn if kinds[r["p"]] is kind}) for kind in (True, False)), trust)


def machine_of(said: DataFrame, labels: DataFrame) -> Machine | None:
    rows = labels.select("example_id", "example_text", "label").sort("example_id").limit(MOST_LABELS).toPandas()
    return fit(rows, exemplars(said, rows))


def scores(documents: DataFrame, said: DataFrame, machine: Machine | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """documents' columns `keep` with `score` (double or null) and `worst`, the normalised sentence behind it.
    said: of distinct_sentences(documents)."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Machine | None = shared.value
        for pdf in batches:
            best = np.full(len(pdf), np.nan)
            worst: list[str | None] = [None] * len(pdf)
            of = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["s"]])
            distinct, at = np.unique(np.array([s for x in pdf["s"] for s in x], dtype=object), return_inverse=True) if len(of) and m else (np.array([], object), np.array([], int))
            value = np.concatenate([m.score(list(distinct[i : i + CHUNK])) for i in range(0, len(distinct), CHUNK)]) if len(distinct) else np.array([])
            for i, k in zip(of, at):
                if not best[i] >= value[k]:
                    best[i], worst[i] = value[k], distinct[k]
            out = pd.DataFrame({"_t": pdf["t"], "score": pd.array(best, dtype="Float64"), "worst": worst})
            out.loc[np.isnan(best), "score"] = pd.NA
            yield out

    scored = said.mapInPandas(score, "_t long, score double, worst string")
    return documents.select(*keep, F.xxhash64("text").alias("_t")).join(scored, "_t", "left").select(*keep, "score", "worst")


def cases(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("score") > threshold)
