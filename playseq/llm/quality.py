"""Quality by weak supervision: rules vote or abstain, and their votes are weighed by EM.

Each rule votes that a text is good or bad, or abstains where it has too little to go by.
The number of texts with each pattern of votes is all that the model needs; those counts
are gathered over the whole corpus, and expectation-maximisation over the patterns gives
every rule's accuracy in either class and the share of bad texts. Labelled texts anchor it: the
rates found in them weigh as much as the whole corpus, so a rule that fires in good texts loses its
say, and a rare fault that only one rule sees isn't explained away as that rule's error. The posterior
probability of being good then decides, instead of requiring every rule to pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.quality_features import ENTRY, FEATURES, beginnings, measure, plain_words
from playseq.llm.text import flat, mix, slices

ABSTAIN, GOOD, BAD = 0, 1, 2
Features = dict[str, np.ndarray]


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good; abstains below `least_words`.

    `in_bad` and `in_good` are what is believed before any label is seen: how often the rule votes
    bad in bad and good texts. The belief is worth `BELIEF` labelled texts.
    """

    name: str
    bad: Callable[[Features], np.ndarray]
    least_words: int = 1
    in_bad: float = 0.3
    in_good: float = 1e-4


RULES = (
    Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("repeated_words", lambda f: 5 * f["n_repeat_words"] > f["n_words"], 20),
    Rule("repeated_lines", lambda f: 10 * f["n_dup_lines"] > 3 * f["n_lines"], 20),
    Rule("capitals", lambda f: 2 * f["n_upper"] > f["n_ascii_letters"], 10),
    Rule("shouting", lambda f: 5 * f["n_shouts"] > f["n_words"], 10),
    Rule("learned_insults", lambda f: 1000 * f["n_learned"] > f["n_words"]),
    Rule("sentence_ends", lambda f: (200 * f["n_ends"] < f["n_words"]) | (2 * f["n_ends"] > f["n_words"]), 50, in_good=0.1),
)

BASE_WORDS = 20
BASE_REPEAT_PERCENT = 30

#: Labelled texts of either kind that the lexicon of `learned_insults` is learned from.
SAMPLE = 1500

#: How many labelled texts the stated rates of a rule are worth.
BELIEF = 10

#: How many times as much as the whole corpus the rates found in labelled texts weigh. Faults are seldom found
#: together, so that where the corpus weighs more, EM takes for bad only what several rules see.
ANCHOR = 10


def votes(features: Features, rules: Sequence[Rule]) -> np.ndarray:
    out = np.full((len(features["n_words"]), len(rules)), GOOD, np.int8)
    for k, rule in enumerate(rules):
        out[rule.bad(features), k] = BAD
        out[features["n_words"] < rule.least_words, k] = ABSTAIN
    return out


def patterns(voted: np.ndarray) -> np.ndarray:
    return voted.astype(np.int64) @ 3 ** np.arange(voted.shape[1])


@dataclass
class Model:
    """The share of bad texts and, by rule, the probability of a bad vote in good and bad texts."""

    bad_share: float
    in_good: np.ndarray
    in_bad: np.ndarray

    def log_odds(self, voted: np.ndarray) -> np.ndarray:
        """Of being bad. A vote never speaks for the other side, and abstaining says nothing."""
        bad = np.maximum(np.log(self.in_bad / self.in_good), 0)
        good = np.minimum(np.log((1 - self.in_bad) / (1 - self.in_good)), 0)
        return (
            np.log(self.bad_share / (1 - self.bad_share))
            + (voted == BAD) @ bad
            + (voted == GOOD) @ good
        )

    def good_probability(self, voted: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.log_odds(voted), -500, 500)))


def labelled_rates(voted: np.ndarray, counts: np.ndarray, stated: Sequence[float]) -> np.ndarray:
    """How often each rule votes bad in labelled texts of one kind, and without labels the stated rates."""
    return (counts @ (voted == BAD) + BELIEF * np.array(stated)) / (counts @ (voted != ABSTAIN) + BELIEF)


def fit(
    voted: np.ndarray,
    counts: np.ndarray,
    rules: Sequence[Rule],
    labelled_good: np.ndarray | None = None,
    labelled_bad: np.ndarray | None = None,
    steps: int = 500,
) -> Model:
    """Expectation-maximisation over the patterns of votes and how many texts have each.

    `labelled_good` and `labelled_bad` count the labelled texts with each pattern. Their rates enter
    every step as if `ANCHOR` times as many texts as the corpus has were known to have them; the stated
    rates of bad texts don't, since which faults a corpus has can't be known beforehand.
    """
    labelled_good, labelled_bad = (np.zeros(len(voted)) if c is None else c for c in (labelled_good, labelled_bad))
    anchor_good = labelled_rates(voted, labelled_good, [r.in_good for r in rules])
    anchor_bad = labelled_rates(voted, labelled_bad, [r.in_bad for r in rules])
    model = Model(0.1, anchor_good, anchor_bad)
    n = counts.sum()
    told = labelled_bad @ (voted != ABSTAIN)
    weight_good, weight_bad = ANCHOR * n, ANCHOR * n * told / (told + BELIEF) + 1
    for _ in range(steps if n else 0):
        good = model.good_probability(voted)
        rates = []
        for weight, anchor, held in ((counts * good, anchor_good, weight_good), (counts * (1 - good), anchor_bad, weight_bad)):
            bad, spoke = weight @ (voted == BAD), weight @ (voted != ABSTAIN)
            rates.append(np.clip((bad + held * anchor) / (spoke + held), 1e-12, 1 - 1e-12))
        new = Model(float((counts @ (1 - good) + 0.5) / (n + 1)), *rates)
        moved = max(abs(new.bad_share - model.bad_share), np.abs(new.in_good - model.in_good).max(), np.abs(new.in_bad - model.in_bad).max())
        model = new
        if moved < 1e-9:
            break
    return model


def learn_lexicon(documents: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Word beginnings that mark texts labelled toxic, from `sample` labelled texts of either kind.

    The sample is the labelled documents with the smallest hashes of their ids. Beginnings are
    chosen one by one, each for the toxic texts that the earlier ones leave, among those hardly
    found in other texts. Without labels the lexicon is empty.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(
        known.filter("toxic <> 1").orderBy(order, "doc_id").limit(sample)
    )
    # At most 2 * sample rows are broadcast.
    rows = (
        documents.select("doc_id", F.col(text).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select(F.col("toxic").cast("int").alias("toxic"), "text")
    )

    def choose(batches):
        entries = _choose_beginnings(list(slices(batches, "text")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(entries["size"]), pa.array(entries["level"]), pa.array(entries["hash"].astype(np.int64))],
            ["size", "level", "hash"],
        )

    found = rows.repartition(1).mapInArrow(choose, "size int, level int, hash long").collect()
    return np.array([(r["size"], r["level"], r["hash"] & (1 << 64) - 1) for r in found], ENTRY)


def _choose_beginnings(pieces: list[pa.RecordBatch]) -> np.ndarray:
    if not pieces:
        return np.zeros(0, ENTRY)
    toxic = np.concatenate([p.column("toxic").to_numpy(zero_copy_only=False) for p in pieces]) == 1
    texts, entries, seen = [], [], 0
    for p in pieces:
        who, found = beginnings(plain_words(*flat(p.column("text"))))
        texts.append(who + seen)
        entries.append(found)
        seen += p.num_rows
    texts, entries = np.concatenate(texts), np.concatenate(entries)
    keys = mix(entries["hash"] + entries["size"].astype(np.uint64) * np.uint64(8) + entries["level"].astype(np.uint64))
    n_toxic, n_other = int(toxic.sum()), int((~toxic).sum())
    least = max(3, 0.01 * n_toxic)
    kinds, example, which = np.unique(keys, return_index=True, return_inverse=True)
    in_toxic = np.bincount(which[toxic[texts]], minlength=len(kinds))
    in_other = np.bincount(which[~toxic[texts]], minlength=len(kinds))
    telling = (in_toxic >= least) & (in_other <= 0.003 * n_other) & (in_toxic / max(n_toxic, 1) > 30 * (in_other + 0.5) / max(n_other, 1))
    mine = telling[which] & toxic[texts]
    texts, which = texts[mine], which[mine]
    left, out = np.ones(len(toxic), bool), []
    while len(which):
        gained = np.bincount(which[left[texts]], minlength=len(kinds))
        best = int(np.argmax(gained - 2 * in_other))
        if gained[best] < least:
            break
        out.append(best)
        left[texts[which == best]] = False
    return entries[example[np.array(out, np.int64)]]


def _known_good(labels: DataFrame) -> DataFrame:
    """By doc_id whether the text is good; ids whose labels don't tell are left out."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    told = labels.select("doc_id", F.when(bad, False).when(good, True).alias("good"))
    return told.filter("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))


@dataclass
class Judged:
    rows: DataFrame
    model: Model
    rules: Sequence[Rule]


def judge(
    documents: DataFrame,
    *,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    lexicon: np.ndarray | None = None,
    labels: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    least_good: float = 0.5,
    keep_text: bool = False,
) -> Judged:
    """Features, votes, posterior and verdict of every document.

    Returns the rows, one for each document: `row` (a struct of the `carry` columns), the
    features (counts, see quality_features), votes (by rule: 0 abstains, 1 good, 2 bad),
    base_failed (under 20 words, or over 30 % of them in repeated 8-word windows),
    good_probability, kept and, with `keep_text`, text. Null and empty texts have no words, so they fail the base.
    Equal texts get equal results, whatever else their rows hold. The documents are read twice:
    once to count patterns of votes (at most 3 to the number of rules come to the driver), once to judge.
    `labels` (doc_id, quality, toxic) anchor the model: a text of quality 0 or toxic is bad, one of
    quality 1 that isn't toxic good; where an id has several, the worst counts.
    """
    words = documents.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text).alias("text"))

    anchored = labels is not None

    def count(batches):
        for batch in slices(batches, "text"):
            found = patterns(votes(measure(batch.column("text"), lexicon=lexicon), rules))
            if anchored:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "pattern"])
                continue
            found, times = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["pattern", "n"])

    if not anchored:
        counted = words.select("text").mapInArrow(count, "pattern long, n long").withColumn("good", F.lit(None).cast("boolean"))
    else:
        read = documents.select("doc_id", F.col(text).alias("text"))
        id_type = read.schema["doc_id"].dataType.simpleString()
        # Rows of one id are counted before they meet their label.
        by_id = read.mapInArrow(count, f"doc_id {id_type}, pattern long").groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))
        counted = by_id.join(_known_good(labels), "doc_id", "left")
    totals = counted.groupBy("pattern").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.when(F.col("good") == kind, F.col("n")).otherwise(0)).alias(name) for name, kind in (("good", True), ("bad", False))),
    ).collect()
    found = np.array([r["pattern"] for r in totals], np.int64)
    voted = found[:, None] // 3 ** np.arange(len(rules)) % 3
    counts, good, bad = (np.array([r[name] for r in totals], np.float64) for name in ("n", "good", "bad"))
    model = fit(voted, counts, rules, good, bad)

    def score(batches):
        for batch in slices(batches, "text"):
            features = measure(batch.column("text"), lexicon=lexicon)
            voted = votes(features, rules)
            n = features["n_words"]
            failed = (n < BASE_WORDS) | (100 * features["n_repeat_words"] > BASE_REPEAT_PERCENT * n)
            good = model.good_probability(voted)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    *(pa.array(features[name], pa.int64()) for name in FEATURES),
                    pa.array(voted.tolist(), pa.list_(pa.int32())),
                    pa.array(failed),
                    pa.array(good),
                    pa.array(~failed & (good >= least_good)),
                    *([batch.column("text")] if keep_text else []),
                ],
                ["row", *FEATURES, "votes", "base_failed", "good_probability", "kept", *(["text"] if keep_text else [])],
            )

    row_type = words.schema["row"].dataType.simpleString()
    columns = ", ".join(f"{name} long" for name in FEATURES)
    columns += ", votes array<int>, base_failed boolean, good_probability double, kept boolean"
    rows = words.mapInArrow(score, f"row {row_type}, {columns}" + ", text string" * keep_text)
    return Judged(rows, model, rules)
