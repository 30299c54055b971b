import random

import pytest
from pyspark.sql import functions as F

from strandlog.llm.leakage import blocks_of, build_index, leaked_items, leaks, stretches, words_of
from tests.conftest import rows_of, set_of

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(docs, items) -> set[tuple]:
    grams = lambda t: {tuple(w[i : i + 12]) for w in [words_of(t)] for i in range(len(w) - 11)}
    have = {i: grams(t) for i, t in items if i is not None and t}
    return {(d, i, len(g & have[i])) for d, t in docs if d is not None and t for g in [grams(t)] for i in have if g & have[i]}


def corpus(seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so many shingles are shared by chance
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([5, 11, 12, 13, 40]))) for i in range(30)]
    docs = []
    for d in range(60):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(items)[1].split()
            a = rng.randrange(len(words))
            part = words[a : a + rng.choice([11, 12, 13, 30])]
            if rng.random() < 0.3 and len(part) > 6:
                part[6] = "other"
            parts += [rng.choice(["\n+ ", " // ", "_", "-- "]).join(part).upper(), text(rng.randrange(10))]
        docs.append((d, "\n".join(parts)))
    return docs, items


@pytest.mark.parametrize(("seed", "block"), [(1, 2_000_000), (2, 500), (3, 100)])
def test_against_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block)
    want = brute(docs, items)
    assert {r[:2] for r in set_of(found)} == {r[:2] for r in want}


def test_edges_of_texts(spark):
    words = [f"a{i}" for i in range(14)]
    item = " ".join(words)
    docs = [(1, " ".join(words[:12])), (2, " ".join(words[2:])), (3, " ".join(words[:11])), (4, " ".join(words[:6] + ["x"] + words[6:])), (5, "pre " + "_".join(words[1:13]) + " post"), (6, " ".join(words[:8])), (7, " ".join(words[4:]))]
    found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(9, item)], ITEMS))
    assert set_of(found) == {(1, 9, 1), (2, 9, 1), (5, 9, 1)}


def test_no_match_runs_over_two_documents(spark):
    words = [f"a{i}" for i in range(12)]
    docs = [(1, " ".join(words[:6])), (2, " ".join(words[6:])), (3, " ".join(words[6:] + words[:6]))]
    assert rows_of(leaks(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame([(9, " ".join(words))], ITEMS))) == []


def test_odd_rows(spark):
    words = " ".join(f"a{i}" for i in range(12))
    long = "filler " * 150_000 + words + " tail" * 50_000
    docs = [(None, words), (1, None), (2, ""), (3, long), (3, long), (4, words), (5, "日本 é " + words.upper())]
    items = [(None, words), (7, None), (8, ""), (9, words), (9, words), (10, "short item")]
    d = spark.createDataFrame(docs, DOCS).withColumns({"shingles": F.lit(1), "positions": F.lit("x"), "n_words": F.lit("y")})
    i = spark.createDataFrame(items, ITEMS).withColumn("suite", F.lit("s"))
    found = leaks(d, i)
    assert set_of(found) == {(3, 9, 1), (4, 9, 1), (5, 9, 1)}
    assert set_of(leaked_items(i, found)) == {(9, "s", 3)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a " * 20)], ITEMS)
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert rows_of(leaks(none_d, items)) == rows_of(leaks(docs, none_i)) == rows_of(leaks(none_d, none_i)) == []


def test_shingles_are_told_apart_exactly():
    index = build_index([(1, " ".join(f"q{i % 7}" for i in range(60)))])
    assert len(index.keys) == len(set(index.keys.tolist())) == len(index.rows)


def test_blocks_are_bounded(spark):
    """Long items, one item again and again: no block passes its bound, and no window is lost."""
    rng = random.Random(4)
    word = lambda: f"u{rng.randrange(4000)}"
    long = " ".join(word() for _ in range(3000))
    items = [(1, long), *((100 + i, "same words here " * 9) for i in range(50)), (2, long + " end"), *((1000 + i, " ".join(word() for _ in range(14))) for i in range(40))]
    words = long.split()
    docs = [(1, " ".join(words[k : k + 12])) for k in (0, 500)] + [(2, "x " + " ".join(words[700:725]) + " y"), (3, long), (4, "Same. Words? here " * 5), (5, items[60][1])]
    parts = stretches(spark.createDataFrame([(str(i), t) for i, t in dict(items).items()], "text_id string, text string"), 250).withColumn("stretch_id", F.monotonically_increasing_id()).persist()
    sizes = [sum(len(r.words) for r in b.collect()) for b in blocks_of(parts, 2000)]
    assert max(sizes) <= 2000 and sum(sizes) == parts.agg(F.sum(F.length("words"))).first()[0]
    seen = [tuple(w[k : k + 12]) for r in parts.where("text_id = '1'").collect() for w in [r.words.split()] for k in range(len(w) - 11)]
    assert sorted(seen) == sorted(tuple(words[k : k + 12]) for k in range(len(words) - 11))  # each window once
    found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 2000)
    got = {r[:2]: r[2] for r in set_of(found)}
    assert set(got) == {r[:2] for r in brute(docs, items)} and got[3, 1] == len(words) - 11 and got[2, 1] == 14


def test_one_huge_item_is_read_in_blocks(spark):
    text = " ".join(f"h{i * 7919 % 1_000_003}" for i in range(600_000))
    words = text.split()
    docs = [(k, "- " + "\n+ ".join(words[a : a + 15])) for k, a in enumerate((0, 299_990, 599_985))]
    found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, text)], ITEMS))
    assert set_of(found) == {(k, 1, 4) for k in range(3)}
