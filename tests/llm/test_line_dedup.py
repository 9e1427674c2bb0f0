"""Line dedup against all pairs compared one by one."""

import random

import pytest

from tessellum.llm import line_dedup as ld


def similar(a, b):
    sets = [{x[i : i + ld.SHINGLE] for i in range(max(1, len(x) - ld.SHINGLE + 1))} for x in (a, b)]
    return len(sets[0] & sets[1]) >= ld.THRESHOLD * len(sets[0] | sets[1])


def brute(rows):
    """What is left of each text: one line of each component, the first in the document with the least id."""
    found = [(i, p, " ".join(x.split()).lower()) for i, t in rows for p, x in enumerate((t or "").split("\n")) if x.split()]
    root = {f: f for _, _, f in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = sorted(root)
    for k, a in enumerate(texts):
        for b in texts[:k]:
            if similar(a, b):
                root[top(a)] = top(b)
    stays = {}
    for i, p, f in sorted(found):
        stays.setdefault(top(f), (i, p))
    keep = set(stays.values())
    words = {(i, p) for i, p, _ in found}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) in keep or (i, p) not in words) for i, t in rows}


def corpus():
    rng = random.Random(3)
    words = [f"w{k}ord" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(25)]
    tails = [" ".join(base[0].split()[:20] + [rng.choice(words) for _ in range(9)]) for _ in range(12)]

    def edit(x):
        parts = x.split()
        parts[rng.randrange(len(parts))] = rng.choice(words)
        return " ".join(parts)

    rows = []
    for i in range(40):
        lines = [rng.choice(base) if rng.random() < 0.3 else edit(rng.choice(base)) for _ in range(4)] + ["", "short", rng.choice(tails).upper()]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("rounds", [64, 1])
def test_against_all_pairs(frame, monkeypatch, rounds):
    monkeypatch.setattr(ld, "FEW", rounds)
    rows = corpus()
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(frame(rows)).collect()}
    want = brute(rows)
    assert got == want


def test_odd_rows(odd, empty):
    out = ld.dedup_lines(odd)
    assert out.columns == odd.columns
    got = out.collect()
    assert len(got) == 8 and sorted(r["text"] for r in got if r["doc_id"] == 5) == ["", ""]
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (1, 2, 3)} == {1: "hello there world", 2: None, 3: ""}
    assert ld.dedup_lines(empty).count() == 0


def test_crowded_buckets_of_unlike_lines_are_split(frame, monkeypatch):
    """Most lines that share a band but not AGREE minima are told apart by more minima, not by all their shingles."""
    made = {}

    class Counted(ld.Cut):
        def __init__(self, df, name="cut", codec="snappy"):
            super().__init__(df, name, codec)
            made[name] = made.get(name, 0) + self.df.count()

    monkeypatch.setattr(ld, "Cut", Counted)
    monkeypatch.setattr(ld, "FEW", 24)
    rng = random.Random(5)

    def letters(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    head = letters(40)
    texts = [head + letters(80) for _ in range(300)]
    rows = list(enumerate(texts + [x[:-4] + letters(4) for x in texts[:10]]))
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(frame(rows)).collect()}
    assert got == brute(rows) and sum(t == "" for t in got.values()) == 10
    assert made["line-rest"] > 200 and 0 < made["line-crowd"] < 60


def test_dense_buckets_are_not_split(frame, monkeypatch):
    """Lines of one family agree in most minima: by two more of them they would stay together, each in over twenty parts."""
    made = {}

    class Counted(ld.Cut):
        def __init__(self, df, name="cut", codec="snappy"):
            super().__init__(df, name, codec)
            made[name] = made.get(name, 0) + self.df.count()

    monkeypatch.setattr(ld, "Cut", Counted)
    monkeypatch.setattr(ld, "FEW", 16)
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}ord" for _ in range(40)]

    def edited():
        own = list(base)
        for k in rng.sample(range(40), 5):
            own[k] = f"x{rng.randrange(10**6)}"
        return " ".join(own)

    rows = list(enumerate(edited() for _ in range(120)))
    rows += [(200 + i, t.rsplit(" ", 1)[0]) for i, t in rows[:30]]
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(frame(rows)).collect()}
    assert got == brute(rows) and 30 <= sum(t == "" for t in got.values()) < 120
    assert made["line-crowd"] > 60 and made.get("line-parts", 0) < made["line-rest"]


def test_few_pairs_are_compared_by_their_sets(spark, monkeypatch):
    """Of lines in many pairs, those that differ in too many parities are told apart without their sets; no pair at the threshold goes."""
    made = {}

    class Counted(ld.Cut):
        def __init__(self, df, name="cut", codec="snappy"):
            super().__init__(df, name, codec)
            made[name] = made.get(name, 0) + self.df.count()

    monkeypatch.setattr(ld, "Cut", Counted)
    rng = random.Random(7)
    texts = ["short", "shorter", "shörter line", "ab" * 300, "ab" * 200, "ba" * 300 + "c"]
    for words in (20, 60, 400):
        base = [f"w{rng.randrange(900)}ord" for _ in range(words)]
        for edits in (0, 1, 2, 4, 6, 8) * 4:
            own = list(base)
            for k in rng.sample(range(words), words * edits // 60):
                own[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own) + f" {rng.randrange(10)}")
    texts = sorted(set(texts))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    found = spark.createDataFrame(list(enumerate(texts)), "node long, folded string")
    got = {tuple(r) for r in ld.verified(spark.createDataFrame(pairs, "a long, b long"), found, often=True).collect()}
    want = {(a, b) for a, b in pairs if similar(texts[a], texts[b])}
    assert got == want and len(want) > 100
    assert len(want) <= made["line-possible"] < len(want) + (len(pairs) - len(want)) / 4
