"""Token counts from flat token streams without an index: a scan for the end-of-document id."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playseq.llm.tables import checkpoint
from playseq.llm.text import slices

#: Folder and file of a public vocabulary whose id END is free.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
BLOCK_TOKENS = 1 << 16
#: The largest id that 16 bits hold.
MOST_TOKEN = (1 << 16) - 1
#: Blocks that are stitched in one window; sums of such groups are stitched in a second one.
GROUP_BLOCKS = 4096


@lru_cache(maxsize=2)
def _encoding(folder: str, vocabulary: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_stream(
    documents: DataFrame,
    *,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    end: int = END,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The documents as flat streams of 16-bit token ids, `end` after each, one stream for each input partition.

    Rows are blocks: stream, block, tokens (little-endian; a stream's last block may be short) and
    rows (the `carry` columns of the documents that end in the block, which a reader of the stream
    doesn't have). A null text is an empty document. Ids that 16 bits can't hold, and texts whose
    tokens include `end`, are refused.
    """
    named = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text).alias("text"), F.spark_partition_id().alias("stream")
    )
    row_type = named.schema["row"].dataType

    def write(batches):
        encoding = _encoding(folder, vocabulary)
        pending, held, block, ended, stream, kind = [], 0, 0, [], 0, None

        def cut(size):
            nonlocal pending, held, block, ended
            tokens = np.concatenate(pending)
            done, rest = tokens[:size], tokens[size:]
            n = int(np.count_nonzero(done == end))
            rows = [r for r in ended[:n]]
            out = pa.RecordBatch.from_arrays(
                [pa.array([stream], pa.int32()), pa.array([block], pa.int64()), pa.array([done.astype("<u2").tobytes()], pa.binary()), pa.array([rows], pa.list_(kind))],
                ["stream", "block", "tokens", "rows"],
            )
            pending, held, block, ended = [rest], len(rest), block + 1, ended[n:]
            return out

        for batch in slices(batches, "text"):
            stream, kind = batch.column("stream")[0].as_py(), batch.column("row").type
            texts = batch.column("text").to_pylist()
            for row, value in zip(batch.column("row").to_pylist(), texts, strict=True):
                tokens = np.array([*encoding.encode_ordinary(value or ""), end], np.int64)
                if tokens.max() > MOST_TOKEN or (tokens[:-1] == end).any():
                    raise ValueError(f"a text has the id {end} of the separator, or an id beyond {MOST_TOKEN}")
                pending.append(tokens)
                ended.append(row)
                held += len(tokens)
                while held >= block_tokens:
                    yield cut(block_tokens)
        if held:
            yield cut(held)

    return named.mapInArrow(write, f"stream int, block long, tokens binary, rows array<{row_type.simpleString()}>")


def read_stream(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat files of 16-bit token ids as streams of blocks; a file is read by one task, 2 GB at most."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def split(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for block, at in enumerate(range(0, len(content), 2 * block_tokens)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([block], pa.int64()), pa.array([content[at : at + 2 * block_tokens]], pa.binary())],
                        ["stream", "block", "tokens"],
                    )

    return files.mapInArrow(split, "stream string, block long, tokens binary")


def count_tokens(stream: DataFrame, *, end: int = END) -> DataFrame:
    """The documents of flat token streams, found by their separators alone.

    Every block is searched by itself. A prefix scan over the blocks of a stream then gives each its
    place, the number of documents before it and the last separator before it, with which the
    documents that cross blocks are stitched.

    Returns, one row for each document: stream, number (from 0), start (its first token's place in
    the stream), n_tokens (without the separator), ended (false for what stands after the last
    separator of a stream, if anything does) and, if the stream has rows, row. Empty documents
    count; an empty stream has none.
    """
    has_rows = "rows" in stream.columns
    types = dict(stream.dtypes)
    rows_type = f", rows {types['rows']}" if has_rows else ""

    def search(batches):
        for batch in batches:
            tokens = [np.frombuffer(t.as_buffer(), "<u2") for t in batch.column("tokens")]
            found = [np.flatnonzero(t == end) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("stream"),
                    batch.column("block"),
                    pa.array([len(t) for t in tokens], pa.int64()),
                    pa.array([f.tolist() for f in found], pa.list_(pa.int32())),
                    *([batch.column("rows")] if has_rows else []),
                ],
                ["stream", "block", "n", "ends", *(["rows"] if has_rows else [])],
            )

    blocks = checkpoint(stream.mapInArrow(search, f"stream {types['stream']}, block long, n long, ends array<int>{rows_type}"))
    blocks = blocks.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    n_ends, last = F.size("ends"), F.try_element_at("ends", F.lit(-1))
    inner = Window.partitionBy("stream", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    last_end = F.when(n_ends > 0, F.col("before") + last)
    placed = placed.withColumns({"ends_before": F.coalesce(F.sum(n_ends).over(inner), F.lit(0)), "end_before": F.max(last_end).over(inner), "last_end": last_end})
    groups = placed.groupBy(F.col("stream").alias("of"), F.col("group").alias("at")).agg(
        F.sum("n").alias("n"), F.sum(n_ends).alias("n_ends"), F.max("last_end").alias("last")
    )
    groups = groups.withColumn("begin", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    groups = groups.withColumn("last", F.col("begin") + F.col("last")).select(
        "of",
        "at",
        "begin",
        F.coalesce(F.sum("n_ends").over(outer), F.lit(0)).alias("group_ends"),
        F.max("last").over(outer).alias("group_end"),
        F.lead("at").over(Window.partitionBy("of").orderBy("at")).isNull().alias("is_last"),
    )
    stitched = placed.join(groups, (F.col("stream") == F.col("of")) & (F.col("group") == F.col("at")))
    stitched = stitched.select(
        "stream",
        "ends",
        "n",
        *(["rows"] if has_rows else []),
        (F.col("begin") + F.col("before")).alias("begin"),
        (F.col("group_ends") + F.col("ends_before")).alias("number"),
        # Of the last separator before the block, in the stream; -1 if there is none.
        F.coalesce(F.col("begin") + F.col("end_before"), F.col("group_end"), F.lit(-1)).alias("open"),
        (F.col("is_last") & F.lead("block").over(Window.partitionBy("stream", "group").orderBy("block")).isNull()).alias("is_last"),
    )
    end_at = F.col("begin") + F.col("end")
    start = F.when(F.col("k") == 0, F.col("open") + 1).otherwise(F.col("begin") + F.element_at("ends", F.col("k")) + 1)
    row = [F.element_at("rows", F.col("k") + 1).alias("row")] if has_rows else []
    closed = stitched.select("*", F.posexplode("ends").alias("k", "end")).select(
        "stream", (F.col("number") + F.col("k")).alias("number"), start.alias("start"), (end_at - start).alias("n_tokens"), F.lit(True).alias("ended"), *row
    )
    tail = F.coalesce(F.col("begin") + F.try_element_at("ends", F.lit(-1)), F.col("open")) + 1
    size = F.col("begin") + F.col("n") - tail
    left = stitched.filter("is_last").filter(size > 0).select(
        "stream",
        (F.col("number") + F.size("ends")).alias("number"),
        tail.alias("start"),
        size.alias("n_tokens"),
        F.lit(False).alias("ended"),
        *([F.lit(None).cast(types["rows"][6:-1]).alias("row")] if has_rows else []),
    )
    return closed.unionByName(left)
