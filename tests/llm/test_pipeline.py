"""Each stage of the pipeline against plain Python, on its own input, and all of them on empty tables."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    some = next(r.text for r in awkward.collect() if r.doc_id == 7).split()
    items = [(1, " ".join(some[5:25])), (2, None), (None, "one")]
    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    awkward.write.parquet(f"{path}/documents.parquet")
    return path


def words(text):
    return WORD.findall(text or "")


def rows_of(docs):
    return Counter((r.doc_id, r.text, r.source, r.row) for r in docs.collect())


def test_quality_keeps_rows_as_they_are(spark, awkward, folder):
    kept = STAGES["quality"](spark, awkward, folder)
    assert kept.columns == awkward.columns
    found, given = Counter(map(repr, kept.collect())), Counter(map(repr, awkward.collect()))
    assert found <= given and found
    for r in kept.collect():
        w = words(r.text)
        counts = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {k for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        assert len(w) >= 20 and 100 * len(inside) <= 30 * len(w)


def test_one_of_each_group_of_near_duplicates_stays(spark, awkward, folder):
    found = rows_of(STAGES["near_dedup"](spark, awkward, folder))
    given = rows_of(awkward)
    # Texts 1, 2 and 3 are one group, equal rows another.
    assert found == Counter({k: 1 for k in given if k[0] not in (2, 3)})


def test_one_stays_whatever_the_ids(spark, folder):
    """Groups without any id, groups that share their smallest id, and rows that differ in other columns only."""
    rng = np.random.default_rng(3)

    def near(seed):
        w = [f"w{seed}x{i}" for i in range(120)]
        for variant in range(4):
            yield " ".join([*w[:119], f"last{variant}"])

    rows = [(None, t, "a") for t in near(1)] + [(5, t, "b") for t in near(2)] + [(9, next(near(3)), s) for s in "edc"]
    rows += [(None, next(near(4)), "f"), (4, list(near(4))[2], "g"), (None, None, "h"), (None, None, "h"), (8, "", "i")]
    found = []
    for _ in range(3):
        docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id bigint, text string, source string")
        docs = docs.repartition(5).withColumn("n_chars", F.length("text"))
        found.append(sorted(map(repr, STAGES["near_dedup"](spark, docs, folder).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 6
    assert [sum(f"source='{s}'" in r for r in found[0]) for s in "abfghi"] == [1, 1, 0, 1, 1, 1]


def test_columns_of_the_mix_are_replaced(spark, awkward, folder):
    again = awkward.withColumns({"mix_copy": F.lit("x"), "MIX_TAKEN": F.lit(0)})
    mixed = STAGES["mixture"](spark, again, folder)
    assert mixed.columns == [*awkward.columns, "mix_copy", "mix_target", "mix_taken"]
    assert mixed.filter("mix_copy >= 1 AND mix_taken >= 0").count() == STAGES["mixture"](spark, awkward, folder).count()


def test_repeated_strings_are_cut(spark, awkward, folder):
    size = corpus_pipeline.REPEAT_BYTES
    texts = [(r.doc_id, (r.text or "").encode()) for r in awkward.collect()]
    seen = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    want = Counter()
    for doc, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        want[doc, bytes(np.frombuffer(t, np.uint8)[~gone]).decode(errors="ignore")] += 1
    found = STAGES["repeated_strings"](spark, awkward, folder)
    assert found.columns == awkward.columns
    assert Counter((r.doc_id, r.text or "") for r in found.collect()) == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in found.collect())


def test_repeated_passages_of_short_words_are_cut(spark):
    passage = [chr(97 + k % 26) + "xyz"[k % 3] * (k % 2) for k in range(51)]
    assert len(" ".join(passage)) < corpus_pipeline.REPEAT_BYTES
    texts = [
        "first words " + " ".join(passage) + " then others",
        "é\n" + "\n ".join(passage),
        "start " + " ".join(passage[:50]) + " end",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = docs.selectExpr("*", "'en' AS lang", "'a' AS source", "length(text) AS n_chars")
    found = {r.doc_id: r.text for r in STAGES["repeated_strings"](spark, docs, None).collect()}
    assert found == {0: "first words  then others", 1: "é\n", 2: texts[2]}


def test_benchmark_passages_are_cut(spark, awkward, folder):
    found = STAGES["benchmark_passages"](spark, awkward, folder)
    item = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.item_id == 1)
    item = LETTERS.findall(item.translate(LOWER))
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)} | {("one",)}
    left = defaultdict(list)
    for r in awkward.collect():
        w, hit = LETTERS.findall((r.text or "").translate(LOWER)), set()
        for window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
        left[r.doc_id].append([x for i, x in enumerate(w) if i not in hit])
    got = defaultdict(list)
    for r in found.collect():
        got[r.doc_id].append(LETTERS.findall((r.text or "").translate(LOWER)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in left.items()}
    assert found.columns == awkward.columns


def test_mixture_fills_every_target(spark, awkward, folder):
    found = STAGES["mixture"](spark, awkward, folder).collect()
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r.source] += len(words(r.text))
        target[r.source] = r.mix_target
        assert 1 <= r.mix_copy <= 3
    assert target and all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and not {r.doc_id for r in rows} & {2, 3, 4, 5, 6, 13, 14, 15}


def test_empty_tables(spark, nothing, folder):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, nothing, folder)
        assert found.columns[: len(nothing.columns)] == nothing.columns and found.count() == 0, name
