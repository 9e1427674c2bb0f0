"""Katz scores against a direct evaluation, and their exact normalisation."""

import math
import zlib
from collections import Counter

import pytest

from tessellum.llm import katz

END, START = "\n", "\0"


def good_turing(times, most=5):
    """Katz's discounts for counts up to ``most``, straight from the formula; (r - 0.5) / r where it has no answer."""
    out = []
    for r in range(1, most + 1):
        try:
            cut = (most + 1) * times[most + 1] / times[1] if times[1] else 0.0
            d = ((r + 1) * times[r + 1] / times[r] / r - cut) / (1 - cut)
        except ZeroDivisionError:
            d = -1.0
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


def brute(rows):
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    one, two, context = Counter(), Counter(), Counter()
    for i, ws in texts:
        if not held[i]:
            seq = [START, *ws, END]
            one.update(seq[1:])
            context.update(seq[:-1])
            two.update(zip(seq, seq[1:]))
    n, v = sum(one.values()), len(one)
    d = good_turing(Counter(two.values()))
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    seen = {}
    for (h, w), r in two.items():
        seen.setdefault(h, []).append((w, (d[r - 1] if r <= katz.K else 1.0) * r / (context[h] + 1)))
    alpha = {h: (1 - sum(p for _, p in ws)) / (1 - sum(p1(w) for w, _ in ws)) for h, ws in seen.items()}

    def p(h, w):
        r = two[h, w]
        return (d[r - 1] if 0 < r <= katz.K else 1.0) * r / (context[h] + 1) if r else alpha.get(h, 1.0) * p1(w)

    out = {}
    for i, ws in texts:
        seq = [START, *ws, END]
        out[i] = (held[i], len(ws) + 1, sum(one[w] > 0 for w in seq[1:]), n, sum(math.log10(p1(w)) for w in seq[1:]), sum(math.log10(p(h, w)) for h, w in zip(seq, seq[1:])))
    return out, p, list(one), seen


def corpus():
    texts = ["the cat sat on the mat", "The dog sat", "", None, "a b a b a b c", "zzz qqq the", "on the mat the cat", "x " * 300 + "y"]
    rows = [(k, texts[k % len(texts)] and texts[k % len(texts)] + f" w{k % 13} w{k % 3}") for k in range(80)]
    return rows


@pytest.mark.parametrize("sizes", [(katz.CHUNK, katz.PART, katz.HOT), (50, 40, 5)])
def test_scores(frame, monkeypatch, sizes):
    for name, value in zip(("CHUNK", "PART", "HOT"), sizes):
        monkeypatch.setattr(katz, name, value)
    rows = corpus()
    want, _, _, _ = brute(rows)
    got = {r["doc_id"]: r for r in katz.score(frame(rows).repartition(3)).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)


def test_contexts_sum_to_one():
    _, p, words, seen = brute(corpus())
    for h in seen:
        assert sum(p(h, w) for w in words) + p(h, "never seen") == pytest.approx(1)


def test_discounts():
    for times in ({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, {1: 3}, {}, {1: 5, 2: 9, 6: 1}, {2: 4, 3: 1}):
        assert katz.discounts(times) == pytest.approx(good_turing(Counter(times)))


def test_odd_rows(odd, empty):
    got = sorted(katz.score(odd).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(1, 4), (2, 1), (3, 1), (4, 1), (5, 4), (5, 4), (6, 60_001), (None, 4)]
    assert katz.score(empty).count() == 0


def test_repeated_and_missing_ids(frame):
    rows = [(1, "a b c"), (1, "d e"), (None, "a b"), (None, "x y z w"), (3, "a b c")]
    got = katz.score(frame(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (0, 5), (1, 3), (1, 4), (3, 4)]
