"""Oversized texts into overlapping pieces, cut at natural boundaries."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, Tokenizer, tokenizer

LIMIT = 4096
OVERLAP = 128
#: Characters without a natural boundary that are tokenized at a time.
STRETCH = 20_000
#: Pieces of one text that are handed on at a time.
_WRITTEN = 512

#: Kinds of boundary, weakest first; the strength is the place in this list.
KINDS = ("anywhere", "sentence", "line", "paragraph", "hunk", "file")

# Where a boundary lies: at the start of the match for files and hunks, at its end for the others.
_BOUNDARIES = (
    ("sentence", re.compile(r"[.!?]+[\"')\]]*[ \t]+"), "end"),
    ("line", re.compile(r"\r\n|\n|\r"), "end"),
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+"), "end"),
    ("hunk", re.compile(r"^@@ ", re.MULTILINE), "start"),
    ("file", re.compile(r"^diff --git ", re.MULTILINE), "start"),
)


def _cuts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets of the natural boundaries inside ``text``, in order, and the greatest strength at each."""
    places, strengths = [], []
    for kind, pattern, side in _BOUNDARIES:
        found = np.fromiter((m.start() if side == "start" else m.end() for m in pattern.finditer(text)), np.int64)
        places.append(found)
        strengths.append(np.full(len(found), KINDS.index(kind), np.int8))
    at, strength = np.concatenate(places), np.concatenate(strengths)
    inside = (at > 0) & (at < len(text))
    at, strength = at[inside], strength[inside]
    order = np.lexsort((strength, at))
    at, strength = at[order], strength[order]
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
    return at[last], strength[last]


def boundaries(text: str) -> dict[int, int]:
    """Character offset to strength of every natural boundary inside ``text``."""
    return {int(a): int(s) for a, s in zip(*_cuts(text))}


def _edges(text: str, tokens: list[int], t: Tokenizer) -> np.ndarray:
    """Character offset of each token's end; -1 where a token ends within a character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = np.nonzero((raw & 0xC0) != 0x80)[0]  # first byte of each character
    ends = np.cumsum(t.token_bytes[np.asarray(tokens, dtype=np.int64)])
    at = np.searchsorted(starts, ends)
    whole = (at == len(starts)) | (starts[np.minimum(at, len(starts) - 1)] == ends)
    return np.where(whole, at, -1)


def _atoms(text: str, budget: int, t: Tokenizer) -> tuple[array, array, array]:
    """Start, token count and strength of the cut before each atomic segment.

    A text is tokenized segment by segment, never as a whole, and stretches without a
    natural boundary in parts of ``STRETCH`` characters; only these three numbers are kept.
    """
    at, strength = _cuts(text)
    starts, sizes, strengths = array("q"), array("q"), array("b")
    for n in range(len(at) + 1):
        a, z = int(at[n - 1]) if n else 0, int(at[n]) if n < len(at) else len(text)
        cut = int(strength[n - 1]) if n else 0
        for low in range(a, z, STRETCH):
            segment = text[low : min(z, low + STRETCH)]
            tokens = t.encode(segment)
            begin = begin_char = 0
            if len(tokens) > budget:  # no natural boundary in reach: cut between tokens
                last_char = last_token = 0
                for i, e in enumerate(_edges(segment, tokens, t).tolist(), 1):
                    if e < 0:
                        continue
                    if i - begin > budget and last_token > begin:
                        starts.append(low + begin_char)
                        sizes.append(last_token - begin)
                        strengths.append(cut)
                        begin, begin_char, cut = last_token, last_char, 0
                    last_char, last_token = e, i
            starts.append(low + begin_char)
            sizes.append(len(tokens) - begin)
            strengths.append(cut)
            cut = 0
    return starts, sizes, strengths


def _back(text: str, starts: array, head: int, t: Tokenizer) -> Iterator[tuple[int, int]]:
    """(character offset, tokens from it to the start of atom ``head``) of the token edges before that atom, nearest first."""
    total = 0
    for i in range(head - 1, -1, -1):
        segment = text[starts[i] : starts[i + 1]]
        tokens = t.encode(segment)
        ends = [0, *_edges(segment, tokens, t).tolist()]
        for j in range(len(tokens) - 1, -1, -1):
            if ends[j] >= 0:
                yield starts[i] + ends[j], total + len(tokens) - j
        total += len(tokens)


def _merge(sizes: array, strengths: array, first: int, budget: int, overlap: int) -> list[int]:
    """Indexes of the atoms that begin a piece, after merging weakest boundaries first.

    ``first`` leading atoms are one from the start. A heap holds adjacent pairs by
    (strength, combined size, place); a pair that does not fit never will.
    """
    n = len(sizes)
    size = list(sizes)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    version = [0] * n
    for i in range(1, first):
        size[0] += size[i]
        alive[i] = False
    right[0] = first
    if first < n:
        left[first] = 0

    def room(i: int) -> int:
        return budget + (overlap if i == 0 else 0)  # the first piece has no overlap to carry

    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and size[i] + size[j] <= room(i):
            heapq.heappush(heap, (strengths[j], size[i] + size[j], i, version[i], j, version[j]))

    i = 0
    while i < n:
        offer(i)
        i = right[i]
    while heap:
        _, _, i, vi, j, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j] and version[i] == vi and version[j] == vj):
            continue
        size[i] += size[j]
        alive[j] = False
        version[i] += 1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(i)
        i = right[i]
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> list[dict] | None:
    """The pieces of one text, or None if it has at most ``limit`` tokens.

    A piece is the last ``overlap`` tokens before it plus a body; bodies joined give the
    text. Every piece has fewer than ``limit`` tokens when it is tokenized by itself.
    """
    t = tokenizer(path)
    # a text of more bytes than the longest tokens could make up is over the limit without being counted
    if len(text) <= limit * t.longest and (len(text) * 4 <= limit or t.count(text) <= limit):
        return None
    budget = limit - 1 - overlap
    while True:
        starts, sizes, strengths = _atoms(text, budget, t)
        first = 1
        while first < len(sizes) and t.count(text[: starts[first]]) < overlap:  # the second piece needs a whole overlap before it
            first += 1
        heads = _merge(sizes, strengths, first, budget, overlap)
        pieces, excess = [], 0
        for k, h in enumerate(heads):
            a = starts[h]
            b = starts[heads[k + 1]] if k + 1 < len(heads) else len(text)
            carried = a
            if k and overlap:
                least = pieces[-1]["start_char"]
                back = overlap
                for place, n_tokens in _back(text, starts, h, t):
                    if n_tokens < back and place > least:
                        continue
                    carried = max(place, least)
                    short = overlap - t.count(text[carried:a])  # the shared text must have that many tokens by itself
                    if short <= 0 or carried == least:
                        break
                    back = n_tokens + short
            n = t.count(text[carried:b])
            excess = max(excess, n - (limit - 1))
            pieces.append({"piece_no": k, "cut_kind": KINDS[strengths[h]] if k else "start", "start_char": carried, "body_char": a, "end_char": b, "n_tokens": n, "text": text[carried:b]})
        if excess <= 0:
            return pieces
        if budget - excess < 1:
            raise ValueError("the limit leaves no room beside the overlap")
        budget -= excess  # seams took more tokens than their parts: try again with less


_SCHEMA = "doc_id bigint, piece_no int, cut_kind string, start_char bigint, body_char bigint, end_char bigint, n_tokens int, text string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("cut_kind", pa.string()), ("start_char", pa.int64()), ("body_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int32()), ("text", pa.string())]
)


def split_documents(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, piece_no, cut_kind, start_char, body_char, end_char, n_tokens, text)`` of every text over ``limit`` tokens.

    ``start_char`` is where the piece begins with its overlap, ``body_char`` where its own
    part begins; ``cut_kind`` is the boundary at the latter. Texts of at most ``limit``
    bytes cannot exceed the limit (no byte-level vocabulary makes more tokens than bytes)
    and never leave the JVM. Null and short texts give nothing. Repeated rows are split each.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                pieces = split_text(text.as_py(), limit, overlap, path)
                for at in range(0, len(pieces or ()), _WRITTEN):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id.as_py(), **p} for p in pieces[at : at + _WRITTEN]], schema=_ARROW)

    return docs.where(F.octet_length("text") > limit).select("doc_id", "text").mapInArrow(split, _SCHEMA)
