"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import builtins
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary file of ranks; its folder's ``__init__.py`` names the split pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _pattern(path: str) -> str:
    spec = importlib.util.spec_from_file_location("_tokenizer_folder", os.path.join(os.path.dirname(path), "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def _encoder(raw, pattern: str):
    """The encoder, built once per Python worker; ``raw`` is the broadcast vocabulary file (under 1 MB)."""
    cache = builtins.__dict__.setdefault("_parcelspark_encoders", {})
    if pattern not in cache:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.value.splitlines() if line)}
        cache[pattern] = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[pattern]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, cluster, n_tokens), one row per row of ``documents``; whole texts, a null text has no tokens.

    ``cluster`` is a hash of the text, equal for exact copies. Only these four columns leave the scan.
    """
    raw = documents.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())
    pattern = _pattern(tokenizer)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(raw, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "cluster")), pa.array(n, pa.int64())], names=["doc_id", "source", "cluster", "n_tokens"])

    rows = documents.select("doc_id", "source", F.xxhash64("text").alias("cluster"), "text")
    return rows.mapInArrow(sizes, "doc_id long, source string, cluster long, n_tokens long")
