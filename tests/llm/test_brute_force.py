"""Operators against plain Python on awkward documents, and what they do with nothing at all."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playseq.llm import near_dedup, substring_dedup, suffix_dedup
from playseq.llm.decontaminate import decontaminate
from playseq.llm.language import best_temperature, fit, identify, softmax
from playseq.llm.licenses import known_sentences, match_rules, normalise, scan
from playseq.llm.mixing import copies, mix
from playseq.llm.near_dedup import ShingleSets, near_duplicates
from playseq.llm.quality import RULES, judge, learn_lexicon
from playseq.llm.quality_features import beginnings, measure, plain_words
from playseq.llm.text import flat
from playseq.llm.token_counts import END, TOKENIZERS, VOCABULARY, _encoding, count_tokens, read_stream, token_stream

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def keyed(rows, *columns):
    return Counter((r["row"]["doc_id"], *(r[c] for c in columns)) for r in rows)


def test_word_runs(awkward):
    texts = [(r.doc_id, words(r.text)) for r in awkward.collect()]
    for window, period in ((35, 21), (6, 3), (1, 1)):
        seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
        want = Counter()
        for doc, w in texts:
            gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            want[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        found = substring_dedup.remove_repeats(awkward, window=window, period=period, keep_text=True, chunk_bytes=2000, bucket_bytes=500)
        rows = found.collect()
        assert keyed(rows, "n_words", "n_removed", "kept_sha256") == want
        assert all((r.kept_text is None) == (r.n_words == 0 and r.row.doc_id == 4) for r in rows)


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21])
def test_difference_covers(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("length,gram,class_pieces", [(400, 50, 2048), (60, 7, 1), (60, 60, 2048), (5, 2, 3)])
def test_byte_strings(awkward, length, gram, class_pieces):
    docs = awkward.filter("doc_id is null or doc_id <> 12") if length < 60 else awkward
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    want = Counter()
    for doc, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        want[doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    found = suffix_dedup.remove_repeats(docs, length=length, gram=gram, class_pieces=class_pieces, keep_text=True).collect()
    assert keyed(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_passages_of_many_words_go_by_their_bytes(spark):
    """Passages of 51 words and more, each in three documents: those that hold 400 bytes go, whatever their words."""
    rng = np.random.default_rng(9)
    shared, serial = [(51, 312), (51, 399), (51, 400), (80, 399), (80, 400), (80, 900)], iter(range(10**6))

    def own(n):
        # No number comes twice, so documents share nothing else.
        return " ".join(f"{next(serial):06}" for _ in range(n))

    rows, want = [], {}
    for words_in, size in shared:
        sizes = np.full(words_in, 1)
        np.add.at(sizes, rng.integers(0, words_in, size - 2 * words_in + 1), 1)
        passage = " ".join("".join(rng.choice(list("abcdefgh"), n)) for n in sizes)
        assert len(passage) == size and len(words(passage)) == words_in
        for k in range(3):
            # Neighbouring bytes differ, so no string reaches beyond the passage.
            text = f"{own(20)}{'xyz'[k]}{passage}{'uvw'[k]}{own(30)}"
            kept = text.replace(passage, "") if size >= 400 else text
            want[len(rows)] = (len(text), len(text) - len(kept), int(size >= 400), hashlib.sha256(kept.encode()).hexdigest())
            rows.append((len(rows), text))
    for _ in range(6):
        text = own(90)
        want[len(rows)] = (len(text), 0, 0, hashlib.sha256(text.encode()).hexdigest())
        rows.append((len(rows), text))
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(awkward, shingle):
    def shingles(text):
        w = words((text or "").translate(LOWER))
        return {tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))} if w else set()

    docs = [(r.doc_id, shingles(r.text)) for r in awkward.collect()]
    n = len(docs)
    label = list(range(n))
    changed = True
    linked = [(i, j) for i in range(n) for j in range(i) if docs[i][1] and 100 * len(docs[i][1] & docs[j][1]) >= 80 * len(docs[i][1] | docs[j][1])]
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    want = Counter()
    for (doc, s), mine in zip(docs, label, strict=True):
        ids = [d for (d, _), other in zip(docs, label, strict=True) if other == mine and d is not None]
        least = (min(ids) if ids else None) if s else doc
        want[doc, len(s), least, doc == least] += 1
    rows = near_duplicates(awkward, shingle=shingle).rows.collect()
    assert Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in rows) == want


@pytest.mark.parametrize("loose", [0, 20])
def test_links_beyond_the_smallest_set(spark, monkeypatch, loose):
    """Chains and groups around the threshold: members that only link to others than their bucket's smallest.

    With `loose`, pairs that fail the exact check are proposed too, one at first, so that rounds must follow.
    """
    between, rounds = near_dedup._between, []

    def loosened(shared, labels, full, percent, proposed):
        rounds.append(proposed)
        return between(shared, labels, full, percent - loose, proposed)

    monkeypatch.setattr(near_dedup, "_between", loosened)
    if loose:
        monkeypatch.setattr(near_dedup, "PROPOSED", 1)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(160):
        w = list(base)
        for at in rng.choice(120, rng.integers(1, 14), replace=False):
            w[at] = f"v{rng.integers(0, 40)}"
        rows.append((k, " ".join(w)))
    sets = [{(a, b) for a, b in zip(w, w[1:])} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        break
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).rows.collect()
    assert {r.id: r.component_id for r in found} == {k: label[k] for k in range(len(rows))}
    assert len(set(label)) > 3
    assert (len(rounds) > 1) == bool(loose)


def test_sketches_estimate_similarity():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    shared, other = [f"a{i}" for i in range(300)], [f"b{i}" for i in range(100)]
    found = ShingleSets.of(pa.array([" ".join(shared + other), " ".join(shared), "x", "", " ".join(rng.permutation(shared))]), 1)
    sketches = found.sketches(400)
    assert found.sizes.tolist() == [400, 300, 1, 0, 300]
    assert (sketches[:3] != np.iinfo(np.uint64).max).all()
    assert (sketches[0] == sketches[1]).mean() == pytest.approx(0.75, abs=0.1)
    assert (sketches[1] == sketches[4]).all()


def test_benchmark_windows(spark, awkward):
    docs = {r.doc_id: r.text for r in awkward.collect()}
    some = (docs[7] or "").split()
    items = [
        (1, " ".join(some[30:55]).upper()), (2, " ".join(some[30:38])), (3, "one"), (4, None), (5, "!!"),
        (None, " ".join(some[80:95])), (6, " ".join((docs[12] or "").split()[100:111])), (1, " ".join(some[30:55]).upper()),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("row", F.lit(1))

    def plain(text):
        return LETTERS.findall((text or "").translate(LOWER))

    windows = defaultdict(set)
    for item, text in items:
        w = plain(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add("null" if item is None else str(item))
    want = Counter()
    for r in awkward.collect():
        w, hit, found = plain(r.text), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= names
        want[r.doc_id, len(w), len(hit), tuple(sorted(found))] += 1
    for block_bytes in (1 << 20, 200):  # all at once, and in several blocks
        rows = decontaminate(awkward, benchmark, clean=True, block_bytes=block_bytes).collect()
        got = Counter((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)
        assert got == want
        for r in rows:
            raw = (docs[r.row.doc_id] or "").encode() if r.row.doc_id not in (None, 9) else None
            if raw is not None:
                cut = b"".join(raw[a:b] for a, b in zip([0, *(s.past for s in r.spans)], [*(s.first for s in r.spans), len(raw)], strict=True))
                assert (r.clean_text or "").encode() == cut


def test_quality_features(awkward):
    judged = judge(awkward)
    want = Counter()
    for r in awkward.collect():
        text = r.text or ""
        w = words(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        counts = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {k for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        want[r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)] += 1
    rows = judged.rows.collect()
    assert keyed(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in rows:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept) and len(r.votes) == len(RULES)


def test_quality_learns_marks_of_toxic_texts(spark):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" + "." * (i % 8 == 0) for i in range(300)]
    rows, labels = [], []
    for k in range(300):
        w = list(rng.choice(plain, 80))
        toxic = k % 10 == 0
        if toxic:
            w[7] = f"grmpf{rng.choice(list('abc'))}"
        rows.append((k, " ".join(w)))
        if k < 200:
            labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = learn_lexicon(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert len(lexicon)
    verdict = {r.row.doc_id: r.kept for r in judge(docs, lexicon=lexicon).rows.collect()}
    assert [k for k, kept in verdict.items() if not kept] == [k for k in verdict if k % 10 == 0]


def plain_em(patterns, good, bad, rules):
    """Posterior of being good by vote pattern: rates and share estimated in turn, in plain Python."""
    def rate(kind, stated, k):
        spoke = sum(n for p, n in kind.items() if p[k] != 0)
        return (sum(n for p, n in kind.items() if p[k] == 2) + 10 * stated) / (spoke + 10)

    anchors = [(rate(good, r.in_good, k), rate(bad, r.in_bad, k)) for k, r in enumerate(rules)]
    rates, share, n = anchors, 0.1, sum(patterns.values())

    def posterior(p):
        odds = math.log(share / (1 - share))
        for vote, (g, b) in zip(p, rates):
            odds += max(math.log(b / g), 0) if vote == 2 else min(math.log((1 - b) / (1 - g)), 0) if vote == 1 else 0
        return 1 / (1 + math.exp(odds))

    for _ in range(500):
        held = {p: posterior(p) for p in patterns}
        new = []
        for k, (g, b) in enumerate(anchors):
            sums = []
            told = sum(c for p, c in bad.items() if p[k] != 0)
            bad_weight = 10 * n * told / (told + 10) + 1
            for anchor, weight, held_by in ((g, lambda p: held[p], 10 * n), (b, lambda p: 1 - held[p], bad_weight)):
                votes = sum(weight(p) * c for p, c in patterns.items() if p[k] == 2)
                spoke = sum(weight(p) * c for p, c in patterns.items() if p[k] != 0)
                sums.append((votes + held_by * anchor) / (spoke + held_by))
            new.append(tuple(sums))
        rates, share = new, (sum((1 - held[p]) * c for p, c in patterns.items()) + 0.5) / (n + 1)
    return posterior


def test_verdicts_equal_those_of_plain_em(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = judge(docs, lexicon=learn_lexicon(docs, labels), labels=labels).rows.collect()
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    everything, good, bad = Counter(), Counter(), Counter()
    for r in rows:
        everything[tuple(r.votes)] += 1
        if r.row.doc_id in known:
            quality, toxic = known[r.row.doc_id]
            (bad if quality == 0 or toxic == 1 else good)[tuple(r.votes)] += 1
    posterior = plain_em(everything, good, bad, RULES)
    assert len(rows) > 100 and good and bad
    for r in rows:
        assert r.good_probability == pytest.approx(posterior(tuple(r.votes)), abs=1e-6)
        assert r.kept == (not r.base_failed and r.good_probability >= 0.5)
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_a_rule_that_fires_in_good_texts_loses_its_say(spark):
    rng = np.random.default_rng(1)
    plain = [f"word{i}" + "." * (i % 8 == 0) for i in range(300)]
    rows = []
    for k in range(400):
        w = list(rng.choice(plain, 80))
        if k % 10 == 0:  # tables and code, which nobody calls bad
            w[::4] = ["|"] * 20
        if k % 10 == 1:
            w = [x.upper() + "!" for x in w]
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(k, int(k % 10 != 1), 0) for k in range(200)] + [(None, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int"
    )
    def lost(labels):
        return {r.row.doc_id % 10 for r in judge(docs, labels=labels).rows.collect() if not r.kept}

    assert lost(None) == {0, 1}
    assert lost(labels) == {1}


def test_one_word_does_not_condemn_a_long_text():
    plain = " ".join(f"word{i % 97}" for i in range(3000))
    lexicon = learned("grmpf")
    short, long, often = (
        measure(pa.array([t]), lexicon=lexicon) for t in ("a grmpf text", plain + " grmpf", plain + " grmpf" * 9)
    )
    rule = next(r for r in RULES if r.name == "learned_insults")
    assert [bool(rule.bad(f)[0]) for f in (short, long, often)] == [True, False, True]


def learned(word):
    """A lexicon of one whole word, found once."""
    _, entries = beginnings(plain_words(*flat(pa.array([word]))))
    return entries[(entries["size"] == 0) & (entries["level"] == 1)]


def test_mixing(spark, awkward):
    quality = spark.createDataFrame([(7, 2.0), (12, 0.5), (1, None)], "doc_id bigint, weight double")
    mixed = mix(awkward, quality=quality, carry=["doc_id", "row"], keep_text=True)
    rows = mixed.collect()
    assert Counter(r.row.doc_id for r in rows) == Counter(r.doc_id for r in awkward.collect())
    sizes = defaultdict(int)
    for r in awkward.collect():
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), sum(sizes.values()), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.epochs * r.size + r.cut_words
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert Counter(map(repr, rows)) == Counter(map(repr, mixed.collect()))
    made = copies(mixed).collect()
    assert sum(len(words(r.copy_text)) for r in made) == sum(taken.values())


def test_better_documents_come_first_more_often(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'a b c' AS text", "if(id < 1000, 's', concat('t', id % 2)) AS source")
    quality = spark.range(500).selectExpr("id AS doc_id", "8.0D AS weight")
    taken = mix(docs, quality=quality, weights=(1, 20)).filter("source = 's'").collect()
    share = [np.mean([r.taken > 0 for r in taken if (r.row.doc_id < 500) == good]) for good in (True, False)]
    assert share[0] > 1.5 * share[1] and 0 < share[1]


def test_language(spark, awkward):
    rng = np.random.default_rng(3)
    alphabets = {"xx": "abcde", "yy": "vwxyz", "zz": "äöüßé"}
    rows = [(k, "".join(rng.choice(list(alphabets[lang]), 80)), lang) for k in range(150) for lang in alphabets]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(docs, F.col("doc_id") < 100, order=F.xxhash64("doc_id", "lang"), sample=240)
    found = identify(docs, model, carry=["doc_id", "lang"]).filter("row.doc_id >= 100").collect()
    assert np.mean([r.lang_pred == r.row.lang for r in found]) > 0.98
    assert all(0 <= r.score <= 1 for r in found) and 0 < np.mean([r.score for r in found]) <= 1
    for r in identify(awkward, model).collect():
        letters = {4: False, 5: False, 6: False, 15: False}.get(r.row.doc_id, True)
        assert (r.lang_pred != "und") == letters
    empty = fit(docs, F.lit(False), order=F.xxhash64("doc_id"))
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}


def test_temperature_spreads_overconfident_scores():
    rng = np.random.default_rng(0)
    true = softmax(rng.normal(size=(4000, 3)))
    classes = np.array([rng.choice(3, p=p) for p in true])
    assert best_temperature(3 * np.log(true), classes) == pytest.approx(3, rel=0.15)


def test_token_counts(spark, awkward, tmp_path):
    from playseq.llm.token_counts import TOKENIZERS, VOCABULARY, _encoding

    encoding = _encoding(TOKENIZERS, VOCABULARY)
    want = Counter((r.doc_id, len(encoding.encode_ordinary(r.text or ""))) for r in awkward.collect())
    for block_tokens in (17, 1 << 16):
        rows = count_tokens(token_stream(awkward, block_tokens=block_tokens)).collect()
        assert keyed(rows, "n_tokens") == want and all(r.ended for r in rows)
    # Flat files of their own: no index, and an open end.
    tokens = np.array([5, 6, END, END, 7, END, 8, 9, 10], "<u2")
    (tmp_path / "flat.bin").write_bytes(tokens.tobytes())
    for block_tokens in (2, 4, 100):
        found = count_tokens(read_stream(spark, str(tmp_path), block_tokens)).orderBy("number").collect()
        assert [(r.start, r.n_tokens, r.ended) for r in found] == [(0, 2, True), (3, 0, True), (4, 1, True), (6, 3, False)]


@pytest.mark.parametrize("end", [70_000, None])
def test_tokens_that_a_stream_cannot_hold(spark, end):
    """An id beyond 16 bits, and a separator that the vocabulary uses itself."""
    docs = spark.createDataFrame([(1, "".join(map(chr, range(33, 127))))], "doc_id int, text string")
    if end is None:
        end = _encoding(TOKENIZERS, VOCABULARY).encode_ordinary(docs.first().text)[0]
    with pytest.raises(Exception, match="separator"):
        count_tokens(token_stream(docs, end=end), end=end).collect()


def test_licence_sentences(spark, awkward):
    bsd = (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that:"
    )
    assert normalise("  The MIT-License,\n v2.0 ") == "the mit license v2.0"
    patterns = [(n, re.compile(p)) for n, p in __import__("playseq.llm.licenses", fromlist=["x"]).SENTENCES]
    text = "Intro. Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nNo license here. " + bsd.replace("\n", " ")
    found = known_sentences(text, patterns)
    assert [k.sentence for k in found] == ["mit-name", "apache-name", "bsd-grant"]
    assert text[found[0].first : found[0].past] == "Released under the MIT License"
    assert [x[0] for x in match_rules(found, __import__("playseq.llm.licenses", fromlist=["x"]).RULES)] == ["MIT", "Apache-2.0", "unknown-BSD-style"]
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0.")], "doc_id int, text string")
    got = {r.row.doc_id: r.expression for r in scan(docs).collect()}
    assert got == {1: "Apache-2.0 AND MIT AND unknown-BSD-style", 2: "", 3: "", 4: "CC-BY-NC-4.0"}
    assert scan(awkward).count() == awkward.count()


def test_nothing_gives_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert len(learn_lexicon(nothing, labels)) == 0
    for found in (
        substring_dedup.remove_repeats(nothing),
        suffix_dedup.remove_repeats(nothing),
        near_duplicates(nothing).rows,
        decontaminate(nothing, benchmark),
        judge(nothing).rows,
        mix(nothing),
        identify(nothing, fit(nothing, F.lit(True), order=F.xxhash64("doc_id"))),
        count_tokens(token_stream(nothing)),
        scan(nothing),
    ):
        assert found.count() == 0


def test_documents_without_benchmark(spark, awkward):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(awkward, benchmark).filter("n_hit > 0").count() == 0
