"""Passages of held-out test items inside a corpus, through a positional inverted index.

1. `forward_index` turns every document into its words, once, in Arrow batches. Words outside the tests' vocabulary can
   never be looked up and are kept as a gap (-1), so positions stay true and the index is small.
2. Each window of `seed` words of a test item is to be looked up by its two rarest terms in this corpus, by the counts of
   the terms over all documents.
3. `postings` is the inverted index (term, doc_id, positions) of the terms chosen, written sorted by term. It is
   partitioned by term and document, so that a frequent term is spread over all files. The position lists of a window's
   two terms, adjusted by the terms' offsets in the item, are intersected. A passage that repeats `least` words with at most one
   edit in `share` always holds such a window unchanged ((least - e) / (e + 1) words between e edits), so nothing is lost.
4. Documents with a surviving offset are aligned around it, outwards in both directions, on the forward index; exact
   phrases and passages with changed, dropped or added words (proximity) come out with their length and edits.

Tests are taken in blocks of about BLOCK items, by hash, so the broadcast vocabulary and windows stay bounded however many there are.

Defined results: null or empty texts and passages match nothing; a passage shorter than `least` words matches only as a
whole (by default it has no match); repeated documents count each; of items with one id a document has the longest match;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.llm.alignment import stretch
from cisweave.llm.words import words
from cisweave.operators.ranking import bounded_broadcast

LEAST, SHARE = 20, 8
BLOCK = 5_000
#: documents up to which the set of candidates is broadcast; beyond, both sides are shuffled
BROADCAST_CANDIDATES = 200_000
BROADCAST_PAIRS = BROADCAST_TERMS = 1_000_000


def seed_length(least: int = LEAST, share: int = SHARE) -> int:
    """Words in a row that are unchanged in every admissible passage: the least over all lengths and their edits."""
    return min(-(-(n - n // share) // (n // share + 1)) for n in range(least, least + 50 * share))


def passage(text: str | None) -> str:
    """The item without its instruction: the first line, where another follows."""
    head, _, rest = (text or "").strip().partition("\n")
    return rest if rest.strip() else head


def test_block(items: pd.DataFrame, seed: int) -> tuple[dict[str, int], list[tuple[int, np.ndarray]], pa.Table]:
    """Vocabulary (word -> term), (item_id, passage as terms) by row, and windows (item: its row, at, terms) of one block."""
    vocabulary: dict[str, int] = {}
    passages = [(int(i), np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(passage(t))], np.int32)) for i, t in zip(items["item_id"], items["item_text"])]
    many = np.array([max(0, len(p) - seed + 1) for _, p in passages], np.int64)
    cut = [np.lib.stride_tricks.sliding_window_view(p, seed) for (_, p), n in zip(passages, many) if n]
    terms = np.concatenate(cut).ravel() if cut else np.zeros(0, np.int32)
    at = np.concatenate([np.arange(n) for n in many]) if len(many) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(terms) + 1, seed), pa.int32()), pa.array(terms, pa.int32()))
    return vocabulary, passages, pa.table({"item": pa.array(np.repeat(np.arange(len(many)), many), pa.int64()), "at": pa.array(at, pa.int32()), "terms": lists})


def forward_index(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, terms array<int>) of the documents that hold any word of the vocabulary; other words are -1."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for pdf in batches:
            terms = [np.array([get(w, -1) for w in words(t)], np.int32) for t in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "terms": terms})
            yield out[[bool((t >= 0).any()) for t in terms]]

    return documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(index, "doc_id long, terms array<int>")


def frequencies(forward: DataFrame) -> DataFrame:
    """(term, n): occurrences of each term in all documents."""
    return forward.select(F.explode("terms").alias("term")).where("term >= 0").groupBy("term").agg(F.count("*").alias("n"))


def postings(forward: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, positions): the inverted index of the given terms, sorted by term and document in each part."""
    flat = forward.select("doc_id", F.posexplode("terms").alias("pos", "term")).where("term >= 0").join(bounded_broadcast(terms, BROADCAST_TERMS), "term", "left_semi")
    lists = flat.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return lists.sortWithinPartitions("term", "doc_id")


def rarest_pairs(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item, a, a_at, b, b_at), distinct: of each window the two terms that occur least and their places in the item. A
    window with a term that the corpus lacks cannot occur in it."""
    each = windows.select("item", "at", F.posexplode("terms").alias("off", "term")).join(frequency, "term", "left")
    least = each.groupBy("item", "at").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))), 1, 2).alias("r")
    ).where("r[0].n > 0")
    return least.select(
        "item", F.col("r")[0]["term"].alias("a"), (F.col("at") + F.col("r")[0]["off"]).alias("a_at"),
        F.col("r")[1]["term"].alias("b"), (F.col("at") + F.col("r")[1]["off"]).alias("b_at"),
    ).distinct()


def intersect(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, item, at, pos): places where both terms of a pair stand at the right distance; `pos` is that of `a`,
    `at` its place in the item. The lists are intersected per document, rarest term first."""
    left = bounded_broadcast(pairs, BROADCAST_PAIRS).join(index.select(F.col("term").alias("a"), "doc_id", F.col("positions").alias("a_pos")), "a")
    both = left.join(index.select(F.col("term").alias("b"), "doc_id", F.col("positions").alias("b_pos")), ["b", "doc_id"])
    adjusted = F.array_intersect("a_pos", F.expr("transform(b_pos, p -> p + a_at - b_at)"))
    return both.select("doc_id", "item", F.col("a_at").alias("at"), F.explode(adjusted).alias("pos"))


def align(candidates: DataFrame, forward: DataFrame, passages: list[tuple[int, np.ndarray]], seed: int, least: int, share: int) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits): the longest stretch of each item that a candidate document repeats."""
    # per document a set of (item, diagonal): bounded by the items' words and the document's length
    per_doc = candidates.groupBy("doc_id").agg(F.collect_set(F.struct("item", (F.col("pos") - F.col("at")).alias("diagonal"))).alias("places"))
    per_doc = storage.materialise(per_doc, "candidates")
    joined = forward.join(bounded_broadcast(per_doc, BROADCAST_CANDIDATES), "doc_id")
    shared = forward.sparkSession.sparkContext.broadcast(passages)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            rows = []
            for doc, terms, places in zip(pdf["doc_id"], pdf["terms"], pdf["places"]):
                text = np.asarray(terms, np.int32)
                best: dict[int, tuple[int, int]] = {}
                as_list = None
                for place in places:
                    (item, p), d = known[place["item"]], int(place["diagonal"])
                    lo, hi = max(0, -d), min(len(p), len(text) - d)
                    same = p[lo:hi] == text[lo + d : hi + d]
                    # runs of equal words on this diagonal; those of seed length start an alignment
                    edges = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
                    for s, e in zip(edges[::2], edges[1::2]):
                        if e - s >= seed and best.get(item, (0, 0))[0] < len(p):
                            as_list = text.tolist() if as_list is None else as_list
                            found = stretch(p.tolist(), as_list, int(lo + s), int(lo + s + d), int(e - s), least, share)
                            if found[0] > best.get(item, (0, 0))[0]:
                                best[item] = found
                rows += [(doc, i, n, k) for i, (n, k) in best.items() if n >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_edits"])

    return joined.select("doc_id", "terms", "places").mapInPandas(verify, "doc_id long, item_id long, n_words int, n_edits int")


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits): documents (doc_id, text) that repeat passages of items (item_id, item_text)."""
    spark = documents.sparkSession
    seed = seed_length(least, share)
    own = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "item_text")
    blocks = max(1, -(-own.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()
        vocabulary, passages, windows = test_block(block, seed)
        if not windows.num_rows:
            continue
        forward = storage.materialise(forward_index(documents, vocabulary), "forward")
        pairs = storage.materialise(rarest_pairs(spark.createDataFrame(windows), frequencies(forward)), "pairs")
        terms = pairs.select(F.explode(F.array("a", "b")).alias("term")).distinct()
        index = storage.materialise(postings(forward, terms), "postings")
        found = align(intersect(pairs, index), forward, passages, seed, least, share)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "doc_id long, item_id long, n_words int, n_edits int") if out is None else out
