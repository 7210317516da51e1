"""Ranked search against scores computed document by document."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playseq.llm.lexical_search import bags, item_terms, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def by_hand(documents, items, top=10):
    held = [(doc, Counter(terms(text))) for doc, text in documents]
    held = [(doc, tf) for doc, tf in held if tf]
    big_n, big_l = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(t for _, tf in held for t in tf)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    found = Counter()
    for item, wanted in asked.items():
        scores = []
        for doc, tf in held:
            m = 100 - 90 + (90 * sum(tf.values()) * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in wanted
                if t in tf
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, unknown, doc) in enumerate(sorted(scores)[:top], 1):
            found[item, rank, None if unknown else doc, -score] += 1
    return found


@pytest.fixture(scope="module")
def items(awkward):
    texts = [r.text or "" for r in awkward.filter("doc_id in (1, 7, 8, 12, 16)").orderBy("doc_id").collect()]
    some = [(k, t[at : at + 300]) for k, t in enumerate(texts) for at in (0, 200)]
    return [*some, (20, None), (21, ""), (22, "nowhere123"), (None, "one two"), (23, "DE one"), (23, "one TWO"), (24, "de")]


@pytest.fixture(scope="module")
def asked(spark, items):
    return spark.createDataFrame([(k, t, 1, 2, 3) for k, t in items], "item_id bigint, text string, score int, rank int, doc_id int")


@pytest.mark.parametrize("top,block_bytes", [(10, 8 << 20), (2, 6000)])
def test_search(awkward, items, asked, top, block_bytes):
    documents = [(r.doc_id, r.text) for r in awkward.collect()]
    rows = search(awkward, asked, top=top, block_bytes=block_bytes).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == by_hand(documents, items, top)


def test_many_copies_are_one_class(spark, asked):
    """A class of thousands of documents gives its smallest ids, and one row of each slice."""
    documents = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "de one").otherwise("other words").alias("text"))
    rows = search(documents, asked.filter("item_id = 24")).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [3 * k for k in range(10)]
    assert len({r.score for r in rows}) == 1


def test_equal_scores_of_different_classes(spark):
    documents = spark.createDataFrame([(3, "a b x"), (1, "b a y"), (2, "a c z"), (4, "c a w"), (5, "q q q")], "doc_id bigint, text string")
    asked = spark.createDataFrame([("i", "b c")], "item_id string, text string")
    assert [(r["rank"], r.doc_id) for r in search(documents, asked).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_nothing_to_search(spark, nothing, awkward, asked):
    assert search(nothing, asked).collect() == []
    assert search(awkward, asked.limit(0)).collect() == []
    assert search(awkward, asked.filter("item_id in (20, 21, 22)")).collect() == []


def test_terms_are_the_contracts(spark):
    asked = spark.createDataFrame([(1, "Straße_x-ÄB [y]`z` 中文{w}\x7fv")], "item_id int, text string")
    assert {r.term for r in item_terms(asked).collect()} == {"straße", "x", "Äb", "y", "z", "中文", "w", "v"}
