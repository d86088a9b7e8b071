"""Source divergence (hash-consed segment trees) against a plain recomputation."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from innsight.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_documents: int = dv.MIN_DOCUMENTS, top: int = dv.TOP_TERMS) -> list[tuple]:
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_documents]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        v = len(kept)

        def p(c, whole, v=v):
            return 1 + 10**9 * (c + 2) // (whole + 2 * v)

        wholes = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        shares = {s: {t: p(c[t], wholes[s]) for t in kept} for s, c in groups.items()}
        of_lang = {t: p(sum(c[t] for c in groups.values()), sum(wholes.values())) for t in kept}
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(price(shares[s][t], shares[o][t]) for t in kept)) for o in groups if o != s]
            pairs.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, "pair", o, value, i + 1) for i, (o, value) in enumerate(pairs)]
            terms = [(t, price(shares[s][t], of_lang[t])) for t in kept if groups[s][t] and shares[s][t] > of_lang[t]]
            terms.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, "term", t, value, i + 1) for i, (t, value) in enumerate(terms[:top])]
    return out


def made(n: int, seed: int, vocabulary: int = 60, sources: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary)] + ["Über", "数据", "ÉTÉ"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de"])
        source = "s0" if rng.random() < 0.3 else f"s{rng.randrange(sources)}"
        text = " ".join(rng.choice(words[: rng.randrange(1, len(words))]).upper() for _ in range(rng.randrange(30)))
        rows.append((i, text, lang, source))
    return rows


def run(spark, rows, **kwargs) -> list[tuple]:
    return [tuple(r) for r in dv.source_divergence(spark.createDataFrame(rows, SCHEMA), **kwargs).collect()]


def test_equals_plain_recomputation(spark):
    rows = made(300, seed=1)
    assert sorted(run(spark, rows)) == sorted(brute(rows))


def test_small_tiles_and_subtrees(spark, monkeypatch):
    """Several tiles of sources and several subtrees of terms give the same sums."""
    monkeypatch.setattr(dv, "TILE", 2)
    monkeypatch.setattr(dv, "CHUNK", 8)
    rows = made(200, seed=2)
    assert sorted(run(spark, rows, min_documents=3, top_terms=4)) == sorted(brute(rows, 3, 4))


def test_defined_cases(spark):
    rows = made(60, seed=3, vocabulary=5, sources=2) + [
        (None, None, None, None),
        (1, "", "xx", "alone"),
        (1, "rare word", "yy", "a"),
        (1, "rare word", "yy", "a"),
        (2, "123 ,.- 45", "yy", "b"),
        (3, "tie " * 3, "zz", None),
    ] + [(4, "tie tied", "zz", "c")] * 12
    assert sorted(run(spark, rows)) == sorted(brute(rows))
    assert run(spark, []) == []


def test_very_long_texts_and_terms(spark, monkeypatch):
    monkeypatch.setattr(dv, "PIECE", 1 << 12)
    long_term = "x" * 10_000
    rows = [(i, f"{long_term} some words {i} " * 20, "en", f"s{i % 2}") for i in range(12)]
    rows.append((99, "a" * 300_000 + " words" * 50_000, "en", "s0"))
    assert sorted(run(spark, rows)) == sorted(brute(rows))


def test_other_columns_may_clash(spark):
    rows = made(80, seed=4)
    df = spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], SCHEMA + ", term string, n int, VALUE int, chunk int")
    assert sorted(tuple(r) for r in dv.source_divergence(df).collect()) == sorted(brute(rows))


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**6, 4 * 10**12], dtype=np.int64)
    whole, terms = 9 * 10**12, 10**6
    wanted = [1 + 10**9 * (int(c) + 2) // (whole + 2 * terms) for c in counts]
    assert dv.shares(counts, whole, terms).tolist() == wanted


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_trees_share_equal_subtrees_and_price_each_pair(width):
    rng = np.random.default_rng(width)
    rows = rng.integers(0, 3, (4, width))
    trees = dv.ConsedTrees(rows)
    one, other = np.triu_indices(4, 1)
    pair, a, b, times = trees.leaf_pairs(one, other)
    got = Counter()
    for p, x, y, n in zip(pair.tolist(), a.tolist(), b.tolist(), times.tolist()):
        if x >= 0:
            got[p, x, y] += n
    wanted = Counter((p, int(x), int(y)) for p in range(len(one)) for x, y in zip(rows[one[p]], rows[other[p]]))
    assert got == wanted
    # a tree of equal leaves is one node per level
    assert [len(left) for left, _ in dv.ConsedTrees(np.zeros((3, 64), dtype=np.int64)).levels] == [1] * 6
