"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are encoded in runs balanced by UTF-8 bytes; a longer text is split before ASCII white space, where no piece of the
vocabulary spans, and its parts add up.

Defined results: null text counts as empty (0 bytes, 0 tokens); very long texts count whole, and one without white space is
encoded in one piece; ties don't arise; repeated rows each get their row; an input column named like a result column gives
way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoding
from .common import lean, vocabulary_path, with_results


def n_tokens(text: Column | str, path: str) -> Column:
    """Token counts of a text column by the tokenizer file at path (.json or .model)."""

    @F.arrow_udf("bigint")
    @lean
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(encoding.token_counts(column, path))

    return count(text)


def token_counts(df: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """df plus n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    tokens = n_tokens(F.col(text), path)
    return with_results(
        df,
        F.transform(F.array(tokens), lambda n: F.struct(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > F.lit(limit)).alias("over_limit")))[0],
        ["n_bytes", "n_tokens", "over_limit"],
    )
