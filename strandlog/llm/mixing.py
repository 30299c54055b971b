"""Mixing sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tokens import TOKENIZER, token_sizes

#: Documents of one source that one flight works on.
BLOCK = 20_000
#: The most sources a mix can have; their totals are planned on the driver.
MAX_SOURCES = 10_000

#: Settled documents of all sizes that a block passes on with its open ones, as counterweights for the landing.
CARRIED = 256

#: The most pairs of settled units that a landing exchanges; a miss of one very long document takes many short ones.
EXCHANGES = 1_000

_EPS = 1e-9


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: moves ``p`` to 0 or 1 but for at most two entries, keeping the
    expected number and the expected total size.

    Three units at a time have a direction in which both totals stay (the null space of
    the two constraints); a step along it, drawn so that every expectation is kept,
    settles at least one of them. Large documents go first (equal sizes in random order),
    so that small ones absorb what is left and the landing problem is small in tokens too.
    """
    p = p.astype(float).copy()
    order = np.lexsort((rng.random(len(p)), -sizes.astype(float))).tolist()
    draws = rng.random(len(p) + 1).tolist()
    s = sizes.astype(float).tolist()
    q = p.tolist()
    held: list[int] = []
    for unit in order:
        if not _EPS < q[unit] < 1 - _EPS:
            q[unit] = float(q[unit] >= 0.5)
            continue
        held.append(unit)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)  # equal sizes: one unit's probability goes to another
        scale = max(abs(x) for x in u)
        u = tuple(x / scale for x in u)
        up = down = math.inf
        for i, x in zip(held, u):
            if x > 0:
                up, down = min(up, (1 - q[i]) / x), min(down, q[i] / x)
            elif x < 0:
                up, down = min(up, q[i] / -x), min(down, (1 - q[i]) / -x)
        step = up if draws.pop() * (up + down) < down else -down
        for i, x in zip(held, u):
            q[i] += step * x
        settled = [i for i in held if not _EPS < q[i] < 1 - _EPS]
        for i in settled:
            q[i] = float(q[i] >= 0.5)
        held = [i for i in held if i not in settled]
    return np.array(q)


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase: settles the at most two entries the flight left by dropping one constraint after another.

    First the total size is dropped: two open units exchange probability, which keeps their
    number, until one settles. Then the number: the last unit is drawn. Every expectation
    is kept, and the number settled differs from the expected one by less than 1.
    """
    q = p.astype(float).copy()
    open_ = [int(i) for i in np.nonzero((q > _EPS) & (q < 1 - _EPS))[0]]
    while len(open_) > 1:
        a, b = open_[-2:]
        up, down = min(1 - q[a], q[b]), min(q[a], 1 - q[b])
        step = up if rng.random() * (up + down) < down else -down
        q[a], q[b] = q[a] + step, q[b] - step
        open_ = [i for i in open_ if _EPS < q[i] < 1 - _EPS]
    for i in open_:
        q[i] = float(rng.random() < q[i])
    return np.round(q)


def balance(sizes: np.ndarray, out: np.ndarray, want: float) -> np.ndarray:
    """Brings the total size of settled units nearer to ``want`` by exchanging units in for units out.

    The landing can miss by the size of the units it settled. An exchange keeps the
    number; each is the pair that misses least, and there are at most ``EXCHANGES``.
    """
    out = out.copy()
    for _ in range(EXCHANGES):
        miss = want - float((out * sizes).sum())
        ins, outs = np.nonzero(out == 1)[0], np.nonzero(out == 0)[0]
        if abs(miss) < 0.5 or not len(ins) or not len(outs):
            break
        outs = outs[np.argsort(sizes[outs], kind="stable")]
        ideal = sizes[ins] + miss  # the size that should come in for each
        at = np.searchsorted(sizes[outs], ideal)
        near = np.stack([np.clip(at - 1, 0, len(outs) - 1), np.clip(at, 0, len(outs) - 1)])
        left = np.abs(sizes[outs][near] - ideal)
        side, k = np.unravel_index(int(np.argmin(left)), left.shape)
        if left[side, k] >= abs(miss):
            break
        out[ins[k]], out[outs[near[side, k]]] = 0.0, 1.0
    return out


def plan_mix(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per target source its totals and how often its documents are used on average.

    Sources without a document (or without tokens) cannot contribute; the weights of the
    others are scaled up to 1. Without ``total`` the mix is the largest that keeps every
    weight within the repeats allowed; with a greater ``total`` than that, sources at their
    cap stay below their weight. Repeated target rows: the greatest weight counts.
    """
    wanted = targets.where("source IS NOT NULL AND weight > 0").groupBy("source").agg(F.max("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = wanted.join(have, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    able = [r for r in rows if r.tokens and r.max_repeats > 0]
    whole = sum(r.weight for r in able)
    most = min((r.max_repeats * r.tokens * whole / r.weight for r in able), default=0.0)
    size = most if total is None else float(total)
    plan = []
    for r in sorted(rows, key=lambda r: r.source):
        ratio = min(float(r.max_repeats), size * r.weight / whole / r.tokens) if r in able else 0.0
        ratio = float(round(ratio)) if abs(ratio - round(ratio)) < _EPS else ratio
        plan.append({"source": r.source, "weight": r.weight, "max_repeats": r.max_repeats, "tokens": int(r.tokens or 0), "docs": int(r.docs or 0), "base": int(ratio), "p": ratio - int(ratio)})
    return plan


def _spread(units: DataFrame, block: int) -> DataFrame:
    """``units`` with a ``salt`` that parts equal rows (repeated documents, documents without an id) into several blocks.

    Only groups of more than a quarter block are parted, by a number stored with the rows.
    """
    units = materialise(units.withColumns({"uid": F.monotonically_increasing_id(), "key": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}), "units")
    share = max(1, block // 4)
    many = materialise(units.groupBy("source", "key", "n_tokens").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share), "repeated")
    if many.isEmpty():
        return units.drop("key", "uid").withColumn("salt", F.lit(0).cast("bigint"))
    parted = units.join(many, ["source", "key", "n_tokens"], "left")
    return parted.withColumn("salt", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / share)))).drop("key", "uid", "n")


def _fly(units: DataFrame, seed: int, level: int, block: int) -> DataFrame:
    """Settles all units of ``(doc_id, source, n_tokens, base, p, salt)``, level by level.

    A block passes on at most an eighth of its size, CARRIED at most, and 2 units, so levels shrink.
    """
    blocks = units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    last = most <= 1

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens", "salt"], kind="stable").reset_index(drop=True)  # a repeated task draws the same
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{level}/{pdf.source[0]}/{pdf.block[0]}".encode()))
        size = pdf.n_tokens.to_numpy()
        start = pdf.p.to_numpy()
        p = flight(size, start, rng)
        if last:
            p = balance(size, landing(p, rng), float((size * start).sum()))
        up = (p > _EPS) & (p < 1 - _EPS)
        up[np.argsort(size, kind="stable")[np.linspace(0, len(p) - 1, min(CARRIED, block // 8, len(p))).astype(int)]] = True
        return pdf.assign(p=p, up=up)[["doc_id", "source", "n_tokens", "base", "p", "salt", "up"]]

    schema = "doc_id bigint, source string, n_tokens bigint, base int, p double, salt bigint, up boolean"
    # blocks by a hash of the document, so a source with most documents is many groups
    placed = units.join(F.broadcast(blocks), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(level), "doc_id", "n_tokens", "salt"), "blocks"))
    flown = placed.groupBy("source", "block").applyInPandas(work, schema)
    if last:
        return flown.drop("up")
    flown = materialise(flown, "flight")
    return flown.where("NOT up").drop("up").unionByName(_fly(flown.where("up").drop("up"), seed, level + 1, block))


def mix(sizes: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``(doc_id, source, n_tokens, uses)``: the documents of the mix and how often each is used.

    A source that should appear r times its size uses each document floor(r) times and,
    with probability r - floor(r), once more. Which ones, the cube method decides: it
    keeps number and token total of each source while probabilities move to 0 or 1,
    block by block; what the blocks leave open (two units each, and a few settled ones as
    counterweights) goes to the next level, until one block per source lands it. The uses
    of a source differ from the expected number by less than 1; what the landing misses
    in tokens is made up by exchanging a few settled documents, in for out.
    No document is used more than ``max_repeats`` times.
    ``sizes`` as from :func:`~strandlog.llm.tokens.token_sizes`; rows are documents, also
    repeated ones; null and unlisted sources are not part of the mix.
    """
    if block < 64:
        raise ValueError("a block takes at least 64 documents")
    plan = plan_mix(sizes, targets, total)
    spark = sizes.sparkSession
    table = spark.createDataFrame([(p["source"], p["base"], p["p"]) for p in plan], "source string, base int, p double")
    units = sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).join(F.broadcast(table), "source")  # at most MAX_SOURCES rows
    whole = units.where("p = 0")
    settled = whole
    if any(p["p"] > 0 for p in plan):
        settled = whole.unionByName(_fly(_spread(units.where("p > 0"), block), seed, 0, block).drop("salt"))
    return settled.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, targets: DataFrame, plan: list[dict] | None = None) -> DataFrame:
    """``(source, target_share, actual_share, tokens, docs, uses, most_uses)`` of every target source, absent ones with 0.

    With the ``plan`` of the mix also ``expected_tokens`` and ``expected_uses``, from which
    the actual ones deviate by what the landing could not meet.
    """
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("weight").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = wanted.join(got, "source", "left").withColumn("whole", F.sum("tokens").over(Window.partitionBy()))  # a row per source
    rows = rows.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("docs"), zero("uses"), zero("most_uses"))
    if plan is None:
        return rows
    expected = mixed.sparkSession.createDataFrame([(p["source"], (p["base"] + p["p"]) * p["tokens"], (p["base"] + p["p"]) * p["docs"]) for p in plan], "source string, expected_tokens double, expected_uses double")
    return rows.join(F.broadcast(expected), "source", "left").fillna(0.0, ["expected_tokens", "expected_uses"])  # at most MAX_SOURCES rows


def mix_documents(docs: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """:func:`mix` over documents; every text is tokenized once, the sizes are kept for all passes."""
    return mix(materialise(token_sizes(docs, tokenizer), "token-sizes"), targets, total=total, seed=seed)
