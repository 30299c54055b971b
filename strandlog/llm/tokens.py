"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rank file of the vocabulary; it must exist on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """A loaded vocabulary. Byte-level, so a text never has more tokens than bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.longest = int(self.token_bytes.max())

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def tokenizer(path: str = TOKENIZER) -> Tokenizer:
    """The vocabulary at ``path``, loaded once per Python worker."""
    return Tokenizer(path)


def token_sizes(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every document; a null text has 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            n = [t.count(x.as_py()) if x.is_valid else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")
