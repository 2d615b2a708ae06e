"""Token counts through a digest cache: a text is encoded once, ever, by one tokenizer version.

The cache is a Parquet folder, one sub-folder for each tokenizer version, with a row for each
content digest. A job joins its content digests to the stored counts, encodes only the distinct
misses and appends them. A null text is the empty text. Repeated texts share one row of the cache;
rows with equal or null ids are all kept; further columns are ignored. An empty table adds nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.session import materialize

CACHE = "digest binary, n_tokens long"
#: Words whose counts a Python worker remembers (about 60 MB); then it starts anew.
REMEMBERED = 400_000
#: Between two spaces of a text that both have ink on either side no token crosses.
_UNEVEN = re.compile(r"^\s|\s$|\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, tuple] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(name: str) -> str:
    """A digest of the tokenizer's file and of the library that runs it."""
    import tokenizers

    with open(tokenizer_path(name), "rb") as file:
        content = file.read()
    return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + content).hexdigest()[:32]


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Counter:
    """Counts tokens piece by piece.

    The pre-tokenizer begins a new token at every single space between two non-space characters,
    so a text's count is the sum over its pieces cut there, each with its leading space. Most
    pieces repeat; each distinct one is encoded by the library once and remembered.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer_path(name))
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.later: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        cut = [(_CUT.split(t) if _UNEVEN.search(t) else t.split(" ")) for t in texts]
        first = self.encode([parts[0] for parts in cut])
        if len(self.later) > REMEMBERED:
            self.later = {}
        wanted: set[str] = set()
        for parts in cut:
            wanted.update(parts[1:])
        missing = [p for p in wanted if p not in self.later]
        self.later.update(zip(missing, self.encode([" " + p for p in missing]), strict=True))
        known = self.later.__getitem__
        return [n + sum(map(known, parts[1:])) for n, parts in zip(first, cut, strict=True)]


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders[name] = Counter(name)
        counter = _encoders[name]
        for batch in batches:
            counts = counter.count(batch["text"].to_pylist())
            yield pa.record_batch(
                [batch["digest"], pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return run


def stored_counts(docs: DataFrame, cache: str, version: str) -> DataFrame | None:
    try:
        return docs.sparkSession.read.schema(CACHE).parquet(f"{cache}/tokenizer={version}")
    except AnalysisException:  # nothing stored yet
        return None


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; fills the cache first.

    Distinct misses are found by digest before any text is encoded, so a text that a third of all
    rows share is one row from the map side on. An append is one commit: a task that is run again
    adds nothing twice. Two jobs may append the same digest; reading takes one of them.
    """
    version = tokenizer_version(tokenizer)
    digest = content_digest(F.col("text"))
    text = F.coalesce("text", F.lit("")).alias("text")
    misses = docs.select(digest.alias("digest"), text).dropDuplicates(["digest"])
    before = stored_counts(docs, cache, version)
    if before is not None:
        misses = misses.join(before, "digest", "left_anti")
    encoded = misses.mapInArrow(_encode(tokenizer), CACHE)
    encoded.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    counts = materialize(
        stored_counts(docs, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")),
        "token-counts",
    )
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        digest.alias("digest"),
    )
    return rows.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
