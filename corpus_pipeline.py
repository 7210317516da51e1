"""From raw documents to a mix: quality, near duplicates, repeated strings, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of documents; the last returns the mix, with a row for each copy. Extra columns of the
documents are carried along. A null or empty text fails the quality stage; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playseq.llm import substring_dedup, suffix_dedup
from playseq.llm.decontaminate import decontaminate
from playseq.llm.mixing import copies, mix
from playseq.llm.near_dedup import near_duplicates
from playseq.llm.quality import judge, learn_lexicon
from playseq.llm.queries import quality_weights
from playseq.llm.tables import checkpoint, documents, on_workers, row_key, table

#: Bytes of a repeated string, and words of a repeated passage, which may have fewer bytes.
REPEAT_BYTES = 250
REPEAT_WORDS = 51


def _rewritten(rows: DataFrame, text: str, columns: list[str], *added: str) -> DataFrame:
    """The documents whose other columns are in `row` with another text, and n_chars to match."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns), *added)


def _others(docs: DataFrame) -> list[str]:
    """What an operator carries along: all but the text, which it has anyway, and its length."""
    return [c for c in docs.columns if c not in ("text", "n_chars")] or ["n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good; the others go."""
    labels = table(spark, sf_dir, "labels")
    lexicon = learn_lexicon(docs, labels)
    carried = [c for c in docs.columns if c != "text"]
    kept = judge(docs, carry=carried, lexicon=lexicon, labels=labels, keep_text=True).rows.filter("kept")
    return kept.select(*((F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 80 %), that with the smallest id.

    A missing id comes last; where rows share the smallest id, or none has any, the hash of id and text
    decides, and among rows equal in both that of the other columns. Documents without words are groups of
    their own, but for rows equal in id and text.
    """
    wordless = F.col("component").isNull()
    groups = near_duplicates(docs).rows.groupBy(
        "component", F.when(wordless, F.col("k1")).alias("own1"), F.when(wordless, F.col("k2")).alias("own2")
    )
    kept = groups.agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "k1", "k2")).alias("least")).select("least.k1", "least.k2")
    keyed = docs.select(*row_key(F.struct("doc_id"), F.col("text")), F.struct("*").alias("row"))
    others = F.to_json(F.struct(*(F.col(f"row.`{c}`") for c in docs.columns if c != "text")))
    return (
        keyed.join(kept, ["k1", "k2"], "left_semi")
        .groupBy("k1", "k2")
        .agg(F.min_by("row", F.struct(F.xxhash64(others), F.xxhash64(F.lit(1), others))).alias("row"))
        .select("row.*")
    )


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 250 bytes and passages of over 50 words that occur twice are cut out of the texts.

    Passages are compared word by word, whatever white space stands between.
    """
    passages = checkpoint(substring_dedup.repeated_spans(docs, window=REPEAT_WORDS))
    found = suffix_dedup.remove_repeats(docs, carry=_others(docs), length=REPEAT_BYTES, keep_text=True, also=passages)
    return _rewritten(found, "kept_text", docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 10 benchmark words are cut out of the texts."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=_others(docs), clean=True)
    return _rewritten(found, "clean_text", docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their targets: a row for each copy of a document that the mix takes.

    Adds mix_copy (from 1), mix_target (words, of the source) and mix_taken (words, of the document
    in all its copies), in place of columns of these names. The text of the copy at which a source's budget
    ends is cut.
    """
    docs = docs.drop("mix_copy", "mix_target", "mix_taken")
    mixed = mix(docs, quality=quality_weights(table(spark, sf_dir, "labels")), carry=_others(docs), keep_text=True)
    rows = copies(mixed).withColumnsRenamed({"copy": "mix_copy", "target": "mix_target", "taken": "mix_taken"})
    return _rewritten(rows, "copy_text", docs.columns, "mix_copy", "mix_target", "mix_taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", on_workers(quality)),
    ("near_dedup", on_workers(near_dedup)),
    ("repeated_strings", on_workers(repeated_strings)),
    ("benchmark_passages", on_workers(benchmark_passages)),
    ("mixture", on_workers(mixture)),
]

#: The first stage fits a model by iteration, which SQL can't express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on a checkpoint of the one before."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
