"""Token counts from a cache of digests.

The cache is a Parquet table of (content digest, tokenizer digest, tokens).  Texts whose
pair of digests is there are never encoded; of the others each distinct one is encoded
once and appended.

Cases: a null text counts as empty (0 bytes, 0 tokens, not encoded but cached like any other
content); repeated rows and null ids each get their row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm._units import encoder
from plumbline.session import cut_lineage

CACHE = "content binary, tokenizer string, n_tokens long"
ARROW_CACHE = pa.schema([("content", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + version.encode()).hexdigest()


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_batch(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the file's own library counts them."""
    if path.endswith(".model"):
        return [len(ids) for ids in _pieces(path).encode(texts, num_threads=1)]
    return encoder(path).counts(texts).tolist()


def count_tokens(docs: DataFrame, path: str, cache: str, *, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``cache`` is a folder all executors reach; it is created if missing, and what is
    missing in it is appended.  A repeated run after a lost one encodes only what the lost
    one has not committed; rows appended twice count once.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    source = docs.select(F.col(id_col).alias("_id"), text)
    content = F.unhex(F.sha2(F.col("text"), 256)).alias("content")
    keyed = cut_lineage(source.select("_id", content, F.octet_length("text").cast("long").alias("n_bytes")))
    # One row of each content speaks for all.
    misses = keyed.groupBy("content").agg(F.min("_id").alias("_id")) \
        .join(_cached(spark, cache, version).select("content"), "content", "left_anti")
    found = source.select("_id", content, "text").alias("s").join(
        misses.alias("m").hint("shuffle_hash"),
        F.col("s._id").eqNullSafe(F.col("m._id")) & (F.col("s.content") == F.col("m.content")), "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows of one id meet in one partition
        for b in batches:
            new = {c: t for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if c not in seen}
            seen.update(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.binary()), pa.array(count_batch(path, list(new.values())), pa.int64())],
                schema=ARROW_CACHE)

    found.select("content", "text").mapInArrow(encode, "content binary, n_tokens long") \
        .select("content", F.lit(version).alias("tokenizer"), "n_tokens") \
        .write.mode("append").parquet(cache)
    counts = _cached(spark, cache, version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "content").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The tokenizer's rows of the cache, which need not exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(CACHE).parquet(cache) if exists else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == version)


def new_cache(folder: str) -> str:
    """A folder name for a cache of its own."""
    return f"{folder}/token-cache-{uuid.uuid4()}"
