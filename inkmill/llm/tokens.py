"""Sizes of texts in tokens of a public tokenizer, whose files stay outside of the repository."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every machine, and the one that is used unless another is named.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, folder: str = FOLDER):
    """A function from text to token ids, loaded once in each worker."""
    path = os.path.join(folder, vocabulary)
    if vocabulary.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).encode


def token_counts(df: DataFrame, text_col: str, vocabulary: str = VOCABULARY, folder: str = FOLDER, name: str = "n_tokens") -> DataFrame:
    """``df`` with its text column replaced by ``name``, the number of its tokens (0 for null)."""
    rest = [c for c in df.columns if c != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col), f"`{name}` long"])

    def run(batches):
        encode = encoder(vocabulary, folder)
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes, pa.int64())], names=[*rest, name])

    return df.select(*rest, F.col(text_col)).mapInArrow(run, schema)
