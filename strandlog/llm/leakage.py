"""Evaluation texts leaking into training text: a prefix-filtered set join on word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

WORD = re.compile(r"[^\W_]+")  # maximal runs of letters or digits
WINDOW = 12
SHINGLE = 5

#: Characters of item text that one pass over the documents looks for.
BLOCK_CHARS = 2_000_000

#: Characters from which a text's words are read one by one, and words coded before they are looked up.
_LONG, _HELD = 1_000_000, 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class ItemIndex:
    """The shingles of one block of items, numbered; bounded by the block's size."""

    item_ids: list[int]
    #: word to number from 1; 0 stands for every other word
    vocabulary: dict[str, int]
    #: per item the shingle numbers in order of position
    shingles: list[np.ndarray]
    #: distinct shingles as rows of word numbers, sorted by key
    rows: np.ndarray
    keys: np.ndarray
    multiplier: int
    size: int = SHINGLE
    prefix: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)


def _keys(columns: list[np.ndarray], multiplier: int) -> np.ndarray:
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        key = key * np.uint64(multiplier) + c.astype(np.uint64)
    return key ^ (key >> np.uint64(29))


def build_index(items: list[tuple[int, str]], size: int = SHINGLE, window: int = WINDOW) -> ItemIndex:
    """Items with fewer words than a window cannot leak and are left out (length bound)."""
    vocabulary: dict[str, int] = {}
    ids, coded = [], []
    for item_id, text in items:
        words = words_of(text)
        if len(words) >= window:
            ids.append(item_id)
            coded.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.int64))
    parts = [np.lib.stride_tricks.sliding_window_view(c, size) for c in coded]
    rows = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, size), np.int64)
    multiplier = 0x9E3779B97F4A7C15
    while True:  # a multiplier that gives every shingle its own key
        keys = _keys([rows[:, i] for i in range(size)], multiplier)
        if len(np.unique(keys)) == len(keys):
            break
        multiplier = (multiplier * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
    order = np.argsort(keys)
    index = ItemIndex(ids, vocabulary, [], rows[order], keys[order], multiplier, size)
    for p in parts:
        index.shingles.append(np.searchsorted(index.keys, _keys([p[:, i] for i in range(size)], multiplier)))
    return index


def rank_prefixes(index: ItemIndex, frequency: dict[int, int], window: int = WINDOW) -> None:
    """Orders shingles by rarity and keeps of every window the rarest one.

    A document that holds the window holds all its shingles, so this single shingle is a
    necessary prefix. A window with a shingle that no document has cannot occur.
    """
    span = window - index.size + 1
    for item, numbers in enumerate(index.shingles):
        ranks = [(frequency.get(int(n), 0), int(n)) for n in numbers]
        for w in range(len(ranks) - span + 1):
            (n_docs, shingle), k = min((ranks[w + k], k) for k in range(span))
            if n_docs:
                index.prefix.setdefault(shingle, []).append((item, w, k))


_POSTINGS = "doc_id bigint, n_words int, positions array<int>, shingles array<int>"
_POSTINGS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int32()), ("positions", pa.list_(pa.int32())), ("shingles", pa.list_(pa.int32()))])


def postings(docs: DataFrame, index: ItemIndex) -> DataFrame:
    """``(doc_id, n_words, positions, shingles)``: where each whole text holds shingles of the items.

    Only documents with such a shingle have a row. A text shorter than a window has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def hits(ix: ItemIndex, codes: list[int], starts: list[int], lengths: list[int], ids: list[int]) -> list[dict]:
        """The shingles of the items in a run of coded texts, separated by a 0 each."""
        n = ix.size
        c = np.array(codes, dtype=np.int64)
        if len(c) < n:
            return []
        known = np.concatenate([[0], np.cumsum(c > 0)])
        at = np.nonzero(known[n:] - known[:-n] == n)[0]  # all words of the shingle are item words
        found = _keys([c[at + i] for i in range(n)], ix.multiplier)
        slot = np.minimum(np.searchsorted(ix.keys, found), len(ix.keys) - 1)
        same = ix.keys[slot] == found
        for i in range(n):  # equal keys, and equal words
            same &= ix.rows[slot, i] == c[at + i]
        at, slot = at[same], slot[same]
        doc = np.searchsorted(starts, at, side="right") - 1
        cuts = np.nonzero(np.diff(doc))[0] + 1
        out = []
        for positions, numbers in zip(np.split(at, cuts), np.split(slot, cuts)):
            if len(positions):
                k = int(np.searchsorted(starts, positions[0], side="right") - 1)
                out.append({"doc_id": ids[k], "n_words": lengths[k], "positions": (positions - starts[k]).tolist(), "shingles": numbers.tolist()})
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        get = ix.vocabulary.get
        if not len(ix.keys):
            return
        for batch in batches:
            codes: list[int] = []
            starts, lengths, ids = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                lower = text.as_py().lower()
                # the words of a very long text are never held all at once
                coded = [get(w, 0) for w in WORD.findall(lower)] if len(lower) < _LONG else [get(m[0], 0) for m in WORD.finditer(lower)]
                if len(coded) < WINDOW:
                    continue
                starts.append(len(codes))
                lengths.append(len(coded))
                ids.append(doc_id)
                codes += coded
                codes.append(0)  # no shingle goes on into the next text
                if len(codes) > _HELD:
                    if out := hits(ix, codes, starts, lengths, ids):
                        yield pa.RecordBatch.from_pylist(out, schema=_POSTINGS_ARROW)
                    codes, starts, lengths, ids = [], [], [], []
            if out := hits(ix, codes, starts, lengths, ids):
                yield pa.RecordBatch.from_pylist(out, schema=_POSTINGS_ARROW)

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(scan, _POSTINGS)


def join_prefixes(rows: DataFrame, index: ItemIndex, window: int = WINDOW) -> DataFrame:
    """``(doc_id, item_id, n_windows)``: the prefix join with bounds and exact verification.

    A posting of a window's prefix shingle proposes the window's place in the text; it must
    lie within the text (positional and length bound), and all its shingles must stand
    there one after the other, which is word for word equality.
    """
    shared = rows.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int32())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        span = window - ix.size + 1
        numbers = [s.tolist() for s in ix.shingles]
        for batch in batches:
            out: list[tuple] = []
            cols = (batch.column(c).to_pylist() for c in ("doc_id", "n_words", "positions", "shingles"))
            for doc_id, n_words, positions, shingles in zip(*cols):
                here = dict(zip(positions, shingles))
                found: dict[int, set[int]] = {}
                for position, shingle in zip(positions, shingles):
                    for item, w, k in ix.prefix.get(shingle, ()):
                        start = position - k
                        if start < 0 or start + window > n_words or w in found.get(item, ()):
                            continue
                        if all(here.get(start + j) == numbers[item][w + j] for j in range(span)):
                            found.setdefault(item, set()).add(w)
                out += [(doc_id, ix.item_ids[item], len(ws)) for item, ws in found.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(join, "doc_id bigint, item_id bigint, n_windows int")


_STRETCHES = pa.schema([("text_id", pa.string()), ("words", pa.string())])


def stretches(texts: DataFrame, most: int) -> DataFrame:
    """``(text_id, words)``: the words of each text, in stretches of at most ``most`` characters where it has more.

    Consecutive stretches share all but one word of a window, so every window lies in
    exactly one of them; a single window is never cut. Texts of fewer words than a window have none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, text in zip(batch.column("text_id").to_pylist(), batch.column("text")):
                held: list[str] = []
                size = fresh = 0  # words since the last cut
                for m in WORD.finditer(text.as_py().lower()):
                    held.append(m[0])
                    size, fresh = size + len(m[0]) + 1, fresh + 1
                    if size > most and len(held) >= WINDOW:
                        yield pa.RecordBatch.from_arrays([pa.array([text_id]), pa.array([" ".join(held)])], schema=_STRETCHES)
                        held = held[-(WINDOW - 1) :]
                        size, fresh = sum(map(len, held)) + len(held), 0
                if len(held) >= WINDOW and fresh:
                    yield pa.RecordBatch.from_arrays([pa.array([text_id]), pa.array([" ".join(held)])], schema=_STRETCHES)

    return texts.mapInArrow(cut, "text_id string, words string")


def blocks_of(parts: DataFrame, block_chars: int) -> list[DataFrame]:
    """``parts`` (stretch_id, words) in blocks of at most ``block_chars`` characters, or of one stretch.

    The sizes of hash blocks are counted, and the number of blocks is doubled until all
    are within the bound, so what a block takes on the driver and in a broadcast is checked.
    """
    total, n = parts.agg(F.sum(F.length("words")), F.count(F.lit(1))).first()
    n_blocks = max(1, -(-(total or 0) // block_chars))
    while True:
        block = F.pmod(F.xxhash64("stretch_id"), F.lit(n_blocks))
        # the largest of the blocks that hold several stretches
        worst = parts.groupBy(block.alias("b")).agg(F.sum(F.length("words")).alias("size"), F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.max("size")).first()[0]
        if (worst or 0) <= block_chars:
            return [parts.where(block == b) for b in range(n_blocks)] if n_blocks > 1 else [parts]
        n_blocks *= 2


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, n_windows)``: documents with at least 12 consecutive words of an item.

    ``n_windows`` counts the item's 12-word windows that the document holds. Equal item
    texts are looked up once, long ones in stretches (an eighth of a block). Items are
    taken in blocks of bounded size, each against all documents in one pass without a
    shuffle of the documents; only the postings of item shingles are kept. Document
    frequencies, which order the shingles, are counted over all documents. Null ids or
    texts and texts of fewer than 12 words match nothing; rows of equal ids count once.
    """
    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.sha2("text", 256).alias("text_id"), "text")
    parts = materialise(stretches(usable.select("text_id", "text").dropDuplicates(["text_id"]), max(1, block_chars // 8)).withColumn("stretch_id", F.monotonically_increasing_id()), "stretches")
    found = []
    for block in blocks_of(parts.select("stretch_id", "words"), block_chars):
        index = build_index([(r.stretch_id, r.words) for r in block.collect()])
        if not index.item_ids:
            continue
        rows = materialise(postings(docs, index), "postings")
        counts = rows.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").count().collect()  # at most the block's shingles
        rank_prefixes(index, {r.s: r["count"] for r in counts})
        found.append(join_prefixes(rows, index).withColumnRenamed("item_id", "stretch_id"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_windows int")
    each = reduce(DataFrame.unionByName, found).groupBy("doc_id", "stretch_id").agg(F.max("n_windows").alias("n_windows"))
    texts = each.join(parts.select("stretch_id", "text_id"), "stretch_id").groupBy("doc_id", "text_id").agg(F.sum("n_windows").cast("int").alias("n_windows"))
    return texts.join(usable.select("item_id", "text_id").distinct(), "text_id").groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))


def leaked_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """``(item_id, suite, n_docs)``: the report per leaked test item."""
    docs = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return items.select("item_id", "suite").distinct().join(docs, "item_id")
