"""Summaries by centrality against plain Python."""

import math
import re

import numpy as np

from claimspark.operators import summarize


def brute_summary(content, rounds=summarize.CENTRAL_ROUNDS):
    sentences = [s.strip() for s in re.split("[.!?]+", content[:3000])]
    sets = {i: set(re.findall(r"[^\W_]+", s.lower())) for i, s in enumerate(sentences)}
    sets = {i: s for i, s in sets.items() if s}
    if not sets:
        return None
    near = {(i, j): len(sets[i] & sets[j]) / math.sqrt(len(sets[i]) * len(sets[j])) for i in sets for j in sets}
    out = {i: sum(near[i, j] for j in sets) for i in sets}
    rank = {i: 1 / len(sets) for i in sets}
    for _ in range(rounds):
        rank = {
            j: (1 - summarize.DAMPING) / len(sets) + summarize.DAMPING * sum(rank[i] * near[i, j] / out[i] for i in sets) for j in sets
        }
    best = sorted(sorted(sets, key=lambda i: (-round(rank[i], 6), i))[:3])
    return ". ".join(sentences[i] for i in best) + "."


def test_equals_brute_force(one):
    bodies = [
        "Cats eat fish. Dogs eat meat. Birds eat seeds and fish. Fish swim. Cats and dogs eat fish and meat! Nothing here",
        "Same words. Same words. Same words. Same words. other",
        "A lone sentence",
        "... ?! ",
        "",
        None,
        " ".join(f"Word{i % 13} and word{i % 7} of w{i}." for i in range(400)),
        "x. " * 2000,
        "Ünï cöde. Straße und ünï! Und straße? ¿Qué",
    ]
    got = one(summarize.central_summary, bodies)
    assert got == [b and brute_summary(b) for b in bodies[:4]] + [None, None] + [brute_summary(b) for b in bodies[6:]]
    assert got[1] == "Same words. Same words. Same words."


def test_rounds_hold_the_tolerance():
    draw = np.random.default_rng(5)
    for _ in range(20):
        words, owners = draw.integers(0, 30, 200), draw.integers(0, 25, 200)
        near = summarize.centrality(words, owners, 26)
        far = summarize.centrality(words, owners, 26, rounds=500)
        assert np.nansum(np.abs(near - far)) < summarize.TOLERANCE
        assert np.isnan(near[25]) and abs(np.nansum(near) - 1) < 1e-3
