"""Sizes of whole texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; every function takes another place.
TOKENIZERS = os.environ.get("LURESCOPE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the texts of this vocabulary are cut into pieces before its merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_count(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> Column:
    """Number of tokens of each whole text; 0 for a null or empty one. Arrow batches, one tokenizer a Python worker.

    VOCABULARY is a file of ranks in FOLDER: a token in base64 and its rank a line. Special tokens are ordinary text.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=pieces, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts.tolist()], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None, **tokenizer: str) -> DataFrame:
    """``id, tokens`` and the columns KEEP, one row per id: of repeated rows of an id the one with most tokens counts.

    A blank text has no tokens to place, whatever white space it has. Rows with a null id are left out.
    """
    keep = keep or {}
    blank = F.coalesce(F.regexp_replace(text, r"[\s\p{Z}\p{C}]+", "") == "", F.lit(True))
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.when(blank, None).otherwise(F.col(text)).alias("_text"), *[c.alias(k) for k, c in keep.items()]
    )
    sized = rows.select("id", *keep, token_count(F.col("_text"), **tokenizer).alias("tokens"))
    first = F.max(F.struct("tokens", *keep)).alias("_row")
    return sized.groupBy("id").agg(first).select("id", "_row.*")
