"""Tokens, n-grams, prompts and label masks."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import _c

# Fixed value: what a model is asked for, around a description.
REQUEST = "Generate a complete LaTeX document that contains a TikZ figure according to the following requirements:\n"
FORM = "\nWrap your code using \\documentclass[tikz]{standalone}, and include \\begin{document}...\\end{document}. Only output valid LaTeX code with no extra text."
IGNORED = -100


def request_text(description: Column | str) -> Column:
    """T-38, T-39: the request for a figure of that description."""
    return F.concat(F.lit(REQUEST), _c(description), F.lit(FORM))


def chat(turns: list[tuple[str, Column]], start: str = "<|im_start|>", stop: str = "<|im_end|>\n", answer: bool = False) -> Column:
    """T-38: turns of (role, text) in a chat model's form; ``answer`` opens the assistant's turn. The marks are the model's."""
    parts = [c for role, text in turns for c in (F.lit(f"{start}{role}\n"), text, F.lit(stop))]
    return F.concat(*parts, *([F.lit(f"{start}assistant\n")] if answer else []))


# T-39: what is asked of a model at each level of difficulty of template sets.
LEVELS = {
    "easy": "simple, concrete templates of basic shapes, colours and positions",
    "medium": "templates that combine several elements and their relations",
    "medium_hard": "templates of labelled diagrams with structure and repetition",
    "hard": "templates of scientific figures with several coordinated parts",
}


def template_request(level: str, count: int) -> str:
    """T-39: asks for ``count`` templates and their terms, as the JSON that ``template_rows`` reads."""
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}")
    return f'Write {count} {LEVELS[level]} that describe images which are easy to draw in TikZ. Mark what varies as <term>. Answer with JSON only: "template_1": "...", "terms_1": {{"term": ["value", ...]}}, and so on.'


def fill_request(template: Column | str, terms: Column | str, count: int = 10) -> Column:
    """T-39: asks for ``count`` descriptions from a template and its terms (a map), as the JSON that ``query_rows`` reads."""
    return F.concat(F.lit(f"Fill this template in {count} different ways and answer with JSON only, a key for each.\nTemplate: "), _c(template), F.lit("\nTerms: "), F.to_json(_c(terms)))


def code_request(query: Column | str) -> Column:
    """T-39: asks for the code of a figure."""
    return request_text(query)


PRETOKEN = re.compile(r"\\[A-Za-z@]+|\w+|[^\w\s]")


def pretoken_count(x: Column | str) -> Column:
    """X-27: the default size of a text in tokens: control words, words and signs. Runs without Python; null counts 0."""
    return F.coalesce(F.regexp_count(_c(x), F.lit(r"\\[A-Za-z@]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")), F.lit(0))


def counted(x: Column | str, counter: Callable[[str], int]) -> Column:
    """X-27, M-11: the size of a text by another counter, which is called in Arrow batches; null counts 0."""
    return F.udf(lambda t: counter(t) if t is not None else 0, "int", useArrow=True)(x)


def bpe_count(x: Column | str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> Column:
    """X-27, M-11: the size of a text in tokens of a public tokenizer, whose file lies in ``folder`` on every machine; null counts 0.
    It is read once in each worker."""

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        encode = _encoder(os.path.join(folder, vocabulary))
        return pa.array([len(encode(t)) if t else 0 for t in column.to_pylist()], pa.int32())

    return run(_c(x))


# Fixed value: the pattern that splits text before the merges of a rank file.
SPLITTING = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoder(path: str) -> Callable[[str], list[int]]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=path).encode
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("file", pat_str=SPLITTING, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def fits_training(code: Column | str, description_tokens: Column, total_tokens: Column, longest: int = 2048) -> Column:
    """F-16, F-17: the code is a whole document, the description has at most a quarter of the tokens and all fewer than ``longest``."""
    from inkmill.functions.text import strip

    return F.endswith(strip(code), F.lit("\\end{document}")) & (description_tokens <= longest // 4) & (total_tokens < longest)


def fits_reward(prompt_tokens: Column, completion_tokens: Column, longest: int = 2048) -> Column:
    """F-18: at most a quarter for the prompt, at most ``longest`` for the completion."""
    return (prompt_tokens <= longest // 4) & (completion_tokens <= longest)


def ngrams(tokens: Column | str, n: int) -> Column:
    """X-24: all runs of ``n`` tokens."""
    t = _c(tokens)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - n + 1)), lambda i: F.slice(t, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def joined_ngrams(tokens: Column | str, n: int, by: str = " ") -> Column:
    """X-24: all runs of ``n`` tokens as texts; no array is made for a run."""
    t = _c(tokens)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(t) - n)), lambda i: F.concat_ws(by, *(F.get(t, i + j) for j in range(n))))
    return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<string>"))


def all_ngrams(tokens: Column | str, most: int = 4) -> Column:
    """X-24: the runs of 1 to ``most`` tokens."""
    return F.concat(*(ngrams(tokens, n) for n in range(1, most + 1)))


def label_mask(ids: Column | str, prompt_length: Column | int) -> Column:
    """M-12: the ids with the first ``prompt_length`` ones ignored."""
    n = F.lit(prompt_length) if isinstance(prompt_length, int) else prompt_length
    return F.transform(_c(ids), lambda x, i: F.when(i < n, F.lit(IGNORED)).otherwise(x))


def mask_values(ids: Column | str, *ignored: int) -> Column:
    """M-12: the ids with those values (padding, image) ignored."""
    return F.transform(_c(ids), lambda x: F.when(x.isin(*ignored), F.lit(IGNORED)).otherwise(x))


def running_sums(x: Column) -> Column:
    """The running sums of an array of numbers, nulls as 0. Spark's array functions have none that costs less than the square of the
    length, so whole Arrow batches are added up at once."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        starts = lists.offsets.to_numpy().astype(np.int64)
        values = pc.fill_null(lists.values.slice(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(values)))
        here = np.arange(starts[0], starts[-1])
        sums = total[here + 1] - np.repeat(total[starts[:-1]], np.diff(starts))
        return pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pa.array(sums.astype(np.int32)), mask=lists.is_null() if lists.null_count else None)

    return run(x)


def image_prompt(text: Column | str, image_token: str, length: int, bos: str = "", eos: str = "") -> Column:
    """M-13: ``length`` image tokens, the text and the marks after it."""
    return F.concat(F.repeat(F.lit(image_token), length), _c(text), F.lit(bos + eos))


def image_length(image_size: Column | int = 420, patch_size: Column | int = 14, factor: Column | int = 3) -> Column:
    """M-19."""
    size, patch, by = (F.lit(v) if isinstance(v, int) else v for v in (image_size, patch_size, factor))
    return F.floor(F.floor(size / patch) * F.floor(size / patch) / by).cast("int")


def merge_image_tokens(ids: Column | str, patches: Column | str, image_id: int) -> Column:
    """M-18: for each place the number of the patch that is put there (from 0, in order), null where the id is no image token."""
    t = _c(ids)
    seen = running_sums(F.transform(t, lambda x: F.coalesce((x == image_id).cast("int"), F.lit(0))))
    return F.zip_with(t, seen, lambda x, n: F.when((x == image_id) & (n <= F.size(_c(patches))), n - 1))


def position_ids(mask: Column | str) -> Column:
    """M-20: the running sum of the attention mask less 1; masked places get 1."""
    m = F.transform(_c(mask), lambda x: x.cast("int"))
    return F.zip_with(running_sums(m), m, lambda s, x: F.when(x == 0, F.lit(1)).otherwise(s - 1))


def _lexed(text: str, fold: bool) -> list[str]:
    from pygments.lexers import TexLexer
    from pygments.token import Comment, Name, Text

    out = []
    for kind, value in TexLexer().get_tokens(text):
        if not value.strip() or kind is Comment:
            continue
        if fold:
            out.extend(re.sub(r"[^a-z0-9\s]", "", value.lower()).split() if kind is Text else value.split())
        elif kind in (Text, Name.Attribute, Name.Builtin):
            out.extend(PRETOKEN.findall(value))
        else:
            out.append(value.strip())
    return out


def lexed(x: Column | str, fold: bool = False) -> Column:
    """X-25 (``fold``: X-26): the tokens of LaTeX source, without comments; running text is cut into words and signs, or folded to
    words of a-z and 0-9. Null gives null."""

    @F.udf("array<string>", useArrow=True)
    def run(text):
        return None if text is None else _lexed(text, fold)

    return run(_c(x))
