import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandlog.llm.splitting import boundaries, split_documents, split_text
from strandlog.llm.tokens import tokenizer
from tests.conftest import rows_of

DOCS = "doc_id bigint, text string"


def check(text: str, limit: int, overlap: int) -> list[dict]:
    t = tokenizer()
    pieces = split_text(text, limit, overlap)
    at = 0
    for k, p in enumerate(pieces):
        assert p["text"] == text[p["start_char"] : p["end_char"]] and p["body_char"] == at < p["end_char"]
        assert p["n_tokens"] == t.count(p["text"]) < limit
        if k:
            assert p["start_char"] >= pieces[k - 1]["start_char"]
            assert overlap <= t.count(text[p["start_char"] : p["body_char"]]) <= overlap + 8
        at = p["end_char"]
    assert at == len(text)
    return pieces


def commit(seed: int, n: int) -> str:
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma_delta", "x", "日本", "🙂", "12", "foo(bar)", "é"])
    out = ["commit abc\n\n    Message. It has sentences! Really?\n\n"]
    while sum(map(len, out)) < n:
        kind = rng.random()
        if kind < 0.05:
            out.append(f"diff --git a/{word()} b/{word()}\n")
        elif kind < 0.15:
            out.append(f"@@ -{rng.randrange(99)},3 +1,4 @@ {word()}\n")
        elif kind < 0.25:
            out.append(rng.choice(["\n", "\r\n", " \n"]))
        else:
            out.append(rng.choice("+- ") + "    " * rng.randrange(3) + " ".join(word() for _ in range(rng.randrange(14))) + rng.choice(["\n", ".\n", ". ", "\r\n"]))
    return "".join(out)


@pytest.mark.parametrize(("seed", "limit", "overlap"), [(1, 4096, 128), (2, 256, 32), (3, 100, 10), (4, 300, 100), (5, 512, 0)])
def test_pieces_cover_overlap_and_fit(seed, limit, overlap):
    text = commit(seed, limit * 20)
    pieces = check(text, limit, overlap)
    at = boundaries(text)
    assert sum(p["body_char"] in at for p in pieces[1:]) == len(pieces) - 1  # there was always a natural place
    assert sum(p["n_tokens"] for p in pieces) / len(pieces) > limit * 0.4


def test_text_without_boundaries():
    for text in ("a" * 20_000, "日本語" * 3000, "🙂" * 2000, " " * 30_000, "x1" * 9000, "é" * 9000):
        if tokenizer().count(text) > 1000:
            check(text, 1000, 50)


def test_strong_boundaries_survive():
    files = "".join(f"diff --git a/{i} b/{i}\n" + "".join(f"@@ -{j} @@\n" + "+ some changed line of code\n" * 20 for j in range(3)) for i in range(12))
    pieces = check(files, 900, 20)
    assert all(p["cut_kind"] == "file" for p in pieces[1:])


def test_short_texts_give_nothing():
    assert split_text("", 4096) is None and split_text("short", 4096) is None and split_text("a " * 2000, 4096) is None


def test_frames(spark):
    long = commit(7, 60_000)
    docs = [(1, long), (2, "short"), (3, None), (4, ""), (None, long), (1, long)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"piece_no": F.lit("x"), "start_char": F.lit(1)})
    found = rows_of(split_documents(df))
    n = len(check(long, 4096, 128))
    assert sorted((r[0] is None, r[0] or 0) for r in found) == [(False, 1)] * (2 * n) + [(True, 0)] * n
    assert rows_of(split_documents(spark.createDataFrame([], DOCS))) == []


def test_impossible_limit():
    with pytest.raises(ValueError, match="no room"):
        split_text("a b c d e f g h " * 50, 10, 9)


def test_one_huge_text_stays_small_in_memory(tmp_path):
    """50 MB in one text: the memory beside the text and its pieces is bounded by a few bytes a character."""
    code = """
import resource, sys
from strandlog.llm.splitting import split_text
kind = sys.argv[1]
text = ("alpha beta_gamma(12), delta. " * 4 + "\\n") * 430_000 if kind == "lines" else "x1y2 " * 2_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
pieces = split_text(text)
after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert pieces[0]["body_char"] == 0 and all(a["end_char"] == b["body_char"] for a, b in zip(pieces, pieces[1:])) and pieces[-1]["end_char"] == len(text)
assert max(p["n_tokens"] for p in pieces) < 4096 and min(p["body_char"] - p["start_char"] for p in pieces[1:]) > 128
print((after - before) // 1024, len(text) // 1_000_000)
"""
    for kind in ("lines", "one line"):
        done = subprocess.run([sys.executable, "-c", code, kind], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=600, check=False)
        assert done.returncode == 0, done.stderr
        mb, size = map(int, done.stdout.split())
        assert size >= 10 and mb < 900, (kind, mb)
