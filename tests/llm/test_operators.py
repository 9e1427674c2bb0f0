"""The other operators against brute force, exact libraries or held-out labels, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessellum.llm import bpe, fingerprint, licenses, mixing, pii, quality, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def components(n, linked):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


# ---- op2


def test_fingerprint_bits():
    text = "The cat  sat on\tthe MAT the cat sat on"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in zip(w, w[1:], w[2:])]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("node", [simhash.NODE, 4])
def test_links_of_two_bits(spark, frame, monkeypatch, node):
    monkeypatch.setattr(simhash, "NODE", node)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(150):
        x = rng.choice(prints)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    docs = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda _: docs)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert [got[i]["component_id"] for i in range(len(prints))] == want
    assert [got[i]["fingerprint"] for i in range(len(prints))] == [f"{x:016x}" for x in prints]


def test_near_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 8 and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 6, None: None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 6]


# ---- op3


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans():
    rng = random.Random(2)
    alphabet = "a.@-+%0123456789  ()4111é\n"
    cases = ["x@y.z", "a@b@c.d.e", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "0001.02.3.255"]
    for text in cases + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(3000)]:
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_rows(spark, frame, odd, empty):
    rows = [(k, f"contact: Zebulon a@b.cc today\nplain words number {k}") for k in range(6)] + [(9, None), (10, "nothing")]
    got = {r["doc_id"]: r for r in pii.detect(spark, frame(rows)).collect()}
    assert got[0]["base"] == "email:17:23" and got[0]["n_email"] == 1 and "remove:9:16" in got[0]["spans"]
    assert got[9]["spans"] == got[10]["spans"] == ""
    assert "a@b.cc" not in pii.sanitise(spark, frame(rows)).where("doc_id = 0").first()["text"]
    assert pii.detect(spark, odd).count() == 8 and pii.detect(spark, empty).count() == 0


def test_pii_of_rare_entities(spark, frame):
    rare = "Wu Quillfeather\nj.m@x.org\nplain words\n\nlater Quillfeather again"
    rows = [(k, f"plain words and later again number {k}") for k in range(40)] + [(100, rare), (101, "Wu plain")]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark, frame(rows)).collect()}
    assert got[100] == "email:16:25,generalise:0:2,generalise:3:15,generalise:45:57" and got[101] == got[0] == ""
    often = [(100 + k, rare) for k in range(3)]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark, frame(rows[:40] + often)).collect()}
    assert got[101] == "email:16:25,remove:0:2,remove:3:15,remove:45:57"
    assert pii.detect(spark, frame([(1, "me a@b.cc"), (2, "you a@b.cc")])).count() == 2


def test_sanitise_by_row(spark):
    rows = [(None, "mail a@b.cc now", 1, "x"), (None, "nothing here", 2, "x"), (2, "me c@d.ee", 3, "x"), (2, "this holds no data at all", 4, "x"), (3, None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, __spans string")
    out = pii.sanitise(spark, docs)
    assert out.columns == docs.columns
    got = {r["__id"]: r["text"] for r in out.collect()}
    assert "a@b.cc" not in got[1] and "[EMAIL]" in got[1] and got[2] == "nothing here" and "[EMAIL]" in got[3]
    assert got[4] == "this holds no data at all" and got[5] is None


# ---- op4


def brute_targets(sizes):
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, total = set(), sum(sizes.values())
    while True:
        free = sum(w for s, w in weight.items() if s not in capped)
        left = total - sum(3 * sizes[s] for s in capped)
        over = {s for s in sizes if s not in capped and left * weight[s] / free > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        capped |= over


def test_mixing(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 40), "en", s, 0) for i, s in enumerate(["a"] * 900 + ["b"] * 60 + ["c"] * 9 + [None] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes, taken = Counter(), Counter()
    for i, t, _, s, _ in rows:
        assert got[i]["size"] == len(t.split()) and got[i]["taken"] <= 3 * got[i]["size"]
        sizes[s] += got[i]["size"]
        taken[s] += got[i]["taken"]
    for s, target in brute_targets(sizes).items():
        own = [got[i] for i, r in enumerate(rows) if r[3] == s]
        assert {x["source_size"] for x in own} == {sizes[s]} and own[0]["target"] == pytest.approx(target)
        assert abs(taken[s] - target) <= 40
    assert {r["doc_id"]: r for r in mixing.mix(docs.repartition(5)).collect()} == got
    mixed = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert all(mixed[i] * got[i]["size"] == got[i]["taken"] for i in got)
    assert mixing.mix(odd).count() == 8 and mixing.mix(empty).count() == 0


def test_mixing_fills_past_what_does_not_fit(spark):
    for long in (3, 4, 5):  # ids whose blocks stand in different places
        sizes = {i: 24_000 if i == long else 40 for i in range(400)}
        rows = [(i, "w " * n, "en", "a", 0) for i, n in sizes.items()] + [(1000 + i, "w " * 5000, "en", "bbcc"[i], 0) for i in range(4)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
        own = [r for r in got if r["doc_id"] < 1000]
        target, taken = own[0]["target"], sum(r["taken"] for r in own)
        assert abs(taken - target) <= 40, (long, target, taken)


def test_mixing_ids_shared_by_sources(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(30) if rng.random() > 0.1 else None, "w " * rng.randrange(1, 30), "en", rng.choice("aabbbc"), 0) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    assert len(got) == 300 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["size"] for r in got) == sum(len(t.split()) for _, t, *_ in rows)


# ---- op5


def test_licenses(spark, frame, odd, empty):
    rows = [(1, "x\nReleased under the CC-BY 4.0\ny"), (2, "Copyright 2020 Me\nLicensed under the Apache License, version 2.0."), (3, "mit licence terms apply"), (4, None)]
    got = {r["doc_id"]: (r["license"], r["line_licenses"]) for r in licenses.scan(spark, frame(rows)).collect()}
    assert got == {1: (None, "CC-BY-4.0"), 2: ("Apache-2.0", "Apache-2.0"), 3: (None, ""), 4: (None, "")}
    assert licenses.scan(spark, odd).count() == 8 and licenses.scan(spark, empty).count() == 0


def test_whole_licenses(spark, frame):
    import textwrap
    from pathlib import Path

    texts = {n: f for n, f in licenses.KNOWN if n in ("BSD-3-Clause", "Zlib", "MIT")}
    rows = [(k, "Copyright (c) 2020 Someone\n\n" + textwrap.fill(texts[n].lower(), 40 + k)) for k, n in enumerate(texts)]
    rows.append((None, "first lines\n\n" + textwrap.fill(texts["Zlib"], 70) + "\n\nlast lines"))
    got = {r["doc_id"]: r for r in licenses.scan(spark, frame(rows)).collect()}
    assert [got[k]["license"] for k in range(len(texts))] == list(texts)
    assert got[None]["license"] is None and got[None]["line_licenses"] == "Zlib"
    place = Path("/usr/share/common-licenses")  # where a system has them
    files = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {n: (place / f).read_text() for n, f in files.items() if (place / f).exists()}
    rows = [(k, " ".join(t.split(" ")).replace("\n", "\n  ")) for k, t in enumerate(there.values())]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark, frame(rows or [(0, "")])).collect()}
    assert not there or [got[k] for k in range(len(rows))] == list(there)


# ---- op6


def brute_statistics(text):
    w = (text or "").split()
    windows = Counter(zip(w, w[1:], w[2:]))
    marked = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality(spark, frame, odd, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "é#", "f\n"] if i % 3 else [f"w{k}" for k in range(90)]) for _ in range(rng.randrange(120)))) for i in range(200)] + [(900, "zq " * 400), (901, None)]
    for r in quality.statistics(frame(rows)).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(dict(rows)[r["doc_id"]])
    normal = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(150, 250)))) for i in range(300)]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(frame(normal + [(999, " ".join(f"##|{k}|##" for k in range(200)))])).collect()}
    assert [i for i, kept in got.items() if not kept] == [999]
    assert quality.verdicts(odd).count() == 8 and quality.verdicts(empty).count() == 0


def test_quality_rejects_by_symbols_alone(spark, frame):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    normal = [(i, " ".join(words(rng.randrange(150, 250)))) for i in range(300)]
    odd = " ".join(w if k % 2 else "#" * len(w) for k, w in enumerate(words(200)))
    got = {r["doc_id"]: r for r in quality.verdicts(frame([*normal, (999, odd)])).collect()}
    assert not got[999]["base_failed"] and [i for i, r in got.items() if not r["kept"]] == [999]


def test_quality_distances_follow_chi_square(spark, frame, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, *map(int, 1000 * (5 + 2 * v))) for i, v in enumerate(rng.standard_normal((4000, quality.P)))]
    rows = spark.createDataFrame(vectors, "doc_id long, a0 long, a1 long, a2 long, a3 long, a4 long")
    monkeypatch.setattr(quality, "statistics", lambda d: d.selectExpr("*", "'en' lang", "'a' source", "100L n_words", "500L word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words", "false base_failed"))
    monkeypatch.setattr(quality, "_vector", lambda: [quality.F.col(f"a{k}").alias(f"x{k}") for k in range(quality.P)])
    d2 = [r["distance"] for r in quality.verdicts(rows).collect()]
    assert np.quantile(d2, 0.75) == pytest.approx(quality.CHI_HALF[-1], rel=0.1) and sum(d > quality.CUTOFF for d in d2) < 20


def test_small_groups_are_judged(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, words(rng.randrange(150, 250)), "en", f"s{i % 40}", 0) for i in range(400)] + [(900, " ".join(f"##|{k}|##" for k in range(200)), "en", "s3", 0), (901, words(200), "fr", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    assert all(r["distance"] is not None for r in got.values()) and not got[900]["kept"] and got[901]["kept"]
    assert sum(not r["kept"] for r in got.values()) <= 5


def numpy_mcd(x):
    """Concentration steps from the two starts, straight from the definition, with exact quantiles."""
    floor = np.array(quality.FLOOR) * quality.UNIT

    def factor(c):
        low = np.zeros_like(c)
        for i in range(len(c)):
            for j in range(i + 1):
                v = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(v, floor[i] ** 2)) if i == j else v / low[j, j]
        return low

    best = None
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for m, low in ((q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floor))), (x.mean(0), factor(np.cov(x.T, bias=True)))):
        for _ in range(20):
            d2 = (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
            near = x[d2 <= np.sort(d2)[int(np.ceil(quality.HALF * len(x))) - 1]]
            m, low = near.mean(0), factor(np.cov(near.T, bias=True))
        if best is None or np.log(np.diag(low)).sum() < best[0]:
            best = np.log(np.diag(low)).sum(), m, low
    _, m, low = best
    d2 = (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
    return d2 * quality.CHI_HALF[-1] / np.quantile(d2, quality.HALF)


def test_estimate_beside_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, quality.P)) @ np.triu(rng.uniform(0.5, 2, (quality.P, quality.P))) * 3000
    x[:150] += 40_000  # a tenth lies apart
    x = np.round(x).astype(int)
    rows = spark.createDataFrame([(i, *map(int, v)) for i, v in enumerate(x)], "doc_id long, a0 long, a1 long, a2 long, a3 long, a4 long")
    monkeypatch.setattr(quality, "statistics", lambda d: d.selectExpr("*", "'en' lang", "'a' source", "100L n_words", "500L word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words", "false base_failed"))
    monkeypatch.setattr(quality, "_vector", lambda: [quality.F.col(f"a{k}").alias(f"x{k}") for k in range(quality.P)])
    got = {r["doc_id"]: r for r in quality.verdicts(rows).collect()}
    want = numpy_mcd(x.astype(float))
    ours = np.array([got[i]["distance"] for i in range(len(x))])
    assert np.corrcoef(np.log(ours), np.log(want))[0, 1] > 0.99 and np.median(np.abs(ours / want - 1)) < 0.1
    assert not any(got[i]["kept"] for i in range(150)) and sum(got[i]["kept"] for i in range(150, 1500)) > 1300
    again = {r["doc_id"]: r["distance"] for r in quality.verdicts(rows.repartition(7)).collect()}
    assert all(again[i] == got[i]["distance"] for i in again)


# ---- op7


def test_bpe_is_exact(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary_text())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(6)
    texts = ["", " ", "It's HE'LL don't", "ΑΣ Σ İI ﬁ", "a<|endoftext|>b <|startoftext|>", "naïve é", "x" * 3000, "​\x85 1234 ½", "\U0001f600\U0001f468‍\U0001f469"]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x3040, 0x30FF)))) for _ in range(60)) for _ in range(300)]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for text in texts:
        ids, decoded = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)
    got = bpe.digests(bpe.encode(spark, odd)).collect()
    assert len(got) == 8 and {r["doc_id"]: r["n_tokens"] for r in got}[2] == 0 and bpe.encode(spark, empty).count() == 0


def test_bpe_decode(spark, frame):
    rows = [(1, "Hello wörld, it's 42"), (2, None), (1, "ab<|endoftext|>c"), (None, " \n")]
    encoded = bpe.encode(spark, frame(rows))
    assert all(r["text"] == r["decoded"] for r in bpe.decode(spark, encoded).collect())
    with pytest.raises(ValueError):
        bpe.checked({"model": {"type": "BPE"}, "normalizer": None, "pre_tokenizer": None})


# ---- op8


def test_fingerprints(frame, odd, empty):
    rows = [(1, "Alpha  beta"), (2, "ALPHA beta"), (5, "ﬁne straße text"), (7, None), (9, "fine STRASSE\ntext"), (12, "")]
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(frame(rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    same = lambda a, b: got[a]["fingerprint"] == got[b]["fingerprint"]
    assert same(1, 2) and same(5, 9) and same(7, 12) and not same(1, 5)
    assert got[2]["near_next"] == 1.0 and got[9]["near_next"] == 0.0
    classes = {r["doc_id"]: r["class_id"] for r in fingerprint.fingerprints(frame(rows)).collect()}
    assert classes == {1: 1, 2: 1, 5: 5, 7: 7, 9: 5, 12: 7}
    assert fingerprint.edited_fingerprints(odd).count() == 8 and fingerprint.edited_fingerprints(empty).count() == 0


def test_equal_digests_are_told_apart(frame, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "digest", lambda canon: F.struct(F.length(canon).cast("long").alias("h1"), F.lit(7).cast("long").alias("h2")))
    rows = [(1, "abc"), (1, "abd"), (2, "ABC"), (None, "abe"), (4, "abcd")]
    got = fingerprint.fingerprints(frame(rows)).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got}) == 4
    assert sorted(r["class_id"] or 0 for r in got) == [0, 1, 1, 1, 4]
    assert len(fingerprint.edited_fingerprints(frame(rows)).collect()) == 5


def test_neighbours_over_many_ranges(frame, monkeypatch):
    monkeypatch.setattr(fingerprint, "QUANTILES", 4)
    monkeypatch.setattr(fingerprint, "ROWS", 3)
    rng = random.Random(7)
    rows = [(i * i % 1009 + 5000 * (i % 7 == 0), f"text {i} " + "x" * rng.randrange(9)) for i in range(300)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(frame(rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


# ---- op9


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(spark, docs, model).where("held_out").join(labels, "doc_id").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.9 * len(rows)
    assert toxicity.score(spark, odd, model).count() == 8 and toxicity.score(spark, empty, model).count() == 0
    assert toxicity.train(docs.limit(0), labels).bias == -4.0


def test_words_of_any_length():
    assert len(toxicity.buckets("字".encode() * 40)) == 122 - 2 + 122 - 3 + 122 - 4 + 1
    rng = random.Random(3)
    letters = [chr(0x4E00 + k) for k in range(300)]
    text = lambda bad: "".join(rng.choice(letters) + ("毒" if bad and k % 4 == 0 else "") for k in range(60))
    toxic = [k % 2 for k in range(120)]
    scorer = toxicity.Scorer(toxicity.fit([text(t) for t in toxic], np.array(toxic)))
    assert all((scorer.score(text(t)) >= 0.5) == bool(t) for t in toxic)


def test_score_is_a_mean_of_means():
    model = toxicity.Model(np.random.default_rng(0).standard_normal(toxicity.BUCKETS).astype(np.float32), 0.25)
    for text in ("one two two three", "", None, "字" * 90 + " x"):
        words = (text or "").lower().encode().split()
        logit = sum(float(np.mean([model.weight[b] for b in toxicity.buckets(w)])) for w in words) / max(1, len(words)) + model.bias
        assert toxicity.Scorer(model).score(text) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


def test_fit_lowers_the_loss_as_its_slope_says():
    texts, toxic = [f"bad{k % 9} word" if k % 2 else f"fine{k % 9} word" for k in range(60)], np.array([k % 2 for k in range(60)])
    model = toxicity.fit(texts, toxic)
    scorer = toxicity.Scorer(model)
    p = np.array([scorer.score(t) for t in texts])
    assert -np.mean(np.log(np.where(toxic, p, 1 - p))) < 0.2 and ((p >= 0.5) == toxic).all()
    again = toxicity.fit(texts, toxic)
    assert (again.weight == model.weight).all() and again.bias == model.bias


def test_toxicity_cut_is_even_whatever_bias_was_fitted(frame, spark, monkeypatch):
    rng = np.random.default_rng(4)
    common, rude = [f"word{k}" for k in range(300)], [f"rude{k}x" for k in range(12)]
    toxic = [k % 2 for k in range(2000)]
    rows = [(k, " ".join([*rng.choice(common, 30), *rng.choice(rude, rng.poisson(4 if t else 1))])) for k, t in enumerate(toxic)]
    model = toxicity.fit([text for _, text in rows[1500:]], np.array(toxic[1500:]))
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: toxicity.Model(model.weight, model.bias + 4))
    scorer = toxicity.Scorer(toxicity.train(frame(rows[:1500]), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")))
    wrong = [np.mean([(scorer.score(x) >= 0.5) != t for (_, x), t in zip(rows[:1500], toxic) if t == k]) for k in (0, 1)]
    assert abs(wrong[0] - wrong[1]) < 0.05, wrong


def test_even_cut():
    assert toxicity.even_cut(np.array([0.0, 1.0, 2.0, 5.0, 6.0]), np.array([0, 0, 0, 1, 1])) == 3.5
    assert 2.0 <= toxicity.even_cut(np.array([0.0, 1.0, 4.0, 2.0, 5.0, 6.0]), np.array([0, 0, 0, 1, 1, 1])) <= 4.0
