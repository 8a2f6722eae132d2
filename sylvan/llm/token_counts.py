"""Token counts: lengths of whole texts under a public tokenizer, nothing else leaves Python.

Arrow batches are cut into pieces balanced by bytes; a text beyond `split_chars` is cut where the
tokenizer's own pre-tokenizer always cuts, so the sum of its pieces' lengths is the text's length.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows give repeated results. An empty table
gives an empty result. Columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import slices

#: A letter, one space or line break, a letter; or closing CJK punctuation before CJK text. Byte-level
#: pre-tokenizers start a new piece at each of these, and no special string holds one.
SAFE = re.compile("(?<=[A-Za-z])(?=[ \n][A-Za-z])|(?<=[、。！，？])(?=[぀-ヿ一-鿿])")

_tokenizers: dict = {}


def load(path: str):
    """The tokenizer of a file, once per Python worker: `tokenizers` for .json, `sentencepiece` for .model."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _tokenizers[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            _tokenizers[path] = own
    return _tokenizers[path]


def pieces(text: str, split_chars: int) -> list[str]:
    """The text, cut at safe boundaries into pieces of about split_chars; whole where there is none."""
    out, start = [], 0
    while len(text) - start > split_chars:
        cut = SAFE.search(text, start + split_chars)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def lengths(texts: list[str], path: str, split_chars: int) -> list[int]:
    """Tokens of each text, without begin, end or other added tokens."""
    own = load(path)
    if path.endswith(".model"):  # its white-space handling looks across any boundary, so no text is split
        return [len(x) for x in own.encode(texts, num_threads=1)] if texts else []
    parts, owner = [], []
    for i, text in enumerate(texts):
        for piece in pieces(text, split_chars) if len(text) > split_chars else [text]:
            parts.append(piece)
            owner.append(i)
    counts = [0] * len(texts)
    for i, encoded in zip(owner, own.encode_batch_fast(parts, add_special_tokens=False), strict=True):
        counts[i] += len(encoded)
    return counts


def count_tokens(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    batch_bytes: int = 1 << 20, split_chars: int = 1 << 16,
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row. No shuffle; memory is bounded by batch_bytes and the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__sv_text", batch_bytes):
                texts = part.column("__sv_text").to_pylist()
                n = pa.array(lengths(texts, tokenizer, split_chars), pa.int64())
                size = pc.binary_length(part.column("__sv_text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("__sv_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__sv_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
