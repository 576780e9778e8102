import random
import re

import numpy as np
import pytest
import xxhash

from driftfield.llm import simhash


def plain_fingerprint(text, k):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


TEXTS = [None, "", " \t\n", "One", "one two", "ONE two three four", "one two three four", "É é \xa0 x", "a b c d e a b c d e", " lead  and trail \x0b", "word " * 900]


@pytest.mark.parametrize("k", [1, 4, 5])
def test_fingerprints_equal_brute_force(k):
    assert [simhash.fingerprint(t.encode() if t else None, k) for t in TEXTS] == [plain_fingerprint(t, k) for t in TEXTS]


def test_bit_counts():
    rows = np.random.default_rng(1).integers(0, 1 << 63, (1000, 2), dtype=np.uint64)
    assert simhash.bit_counts(rows).tolist() == [int(((rows[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).sum()) for b in range(128)]


@pytest.mark.parametrize("errors", [0, 4, 9])
def test_trie_join_equals_all_pairs(errors):
    rng = np.random.default_rng(errors)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(12)]])
    trie = rng.integers(0, 3, marks.size)
    order = np.lexsort((marks, trie))
    trie, marks = trie[order], marks[order]
    got = {(int(a), int(b)) for x, y in simhash.trie_links(trie, marks, errors) for a, b in zip(x, y)}
    n = marks.size
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if trie[i] == trie[j] and (int(marks[i]) ^ int(marks[j])).bit_count() <= errors}


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)  # tries are cut, as large groups of copies have them
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    marks = list(base)
    for _ in range(300):
        x = rng.choice(marks[:90])
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        marks.append(x)
    rows = [(1000 - i, (m ^ (1 << 63)) - (1 << 63) if False else m - (1 << 64) if m >> 63 else m) for i, m in enumerate(marks)] + [(None, marks[0] - (1 << 64) if marks[0] >> 63 else marks[0])]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r["fingerprint"]: r["component_id"] for r in simhash.classes(df).collect()}
    roots = grouped(len(marks), [(i, j) for i in range(len(marks)) for j in range(i + 1, len(marks)) if (marks[i] ^ marks[j]).bit_count() <= 4])
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, 10**9), 1000 - i)
    assert got == {m - (1 << 64) if m >> 63 else m: least[r] for m, r in zip(marks, roots)}


def test_rows_with_nulls_ties_and_repeats(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, TEXTS[5])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    same = {r["doc_id"]: r["component_id"] for r in got}
    assert same[0] == same[1] == same[2] == 0 and same[6] == same[None] == 5
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts, groups = [], []
    for g in range(40):
        base = [word() for _ in range(rng.randint(150, 300))]
        for c in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            if c:
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            groups.append(g)
    df = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(zip(texts, groups))] + [(900, None, 100, "x"), (901, "", 100, "x"), (901, "", 100, "x")], "doc_id long, text string, g long, __id string")
    kept = simhash.near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["g"] for r in kept.collect()) == [*range(40), 100]
    assert simhash.near_copies(df.where("false")).count() == 0


def test_texts_below_the_similarity_all_stay(spark):
    a = [f"w{i}" for i in range(60)]
    b = a[:20] + ["x"] + a[21:40] + ["y"] + a[41:]
    j = len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b)))
    assert j < 0.8
    assert simhash.near_copies(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).count() == 2


def changed(words, positions, rng):
    out = list(words)
    for i in positions:
        out[i] = f"x{rng.getrandbits(40)}"
    return out


def spaced(n, k, rng):
    """k positions of n, away from the ends and far enough apart that each change touches five shingles."""
    return [5 + 6 * i for i in rng.sample(range((n - 10) // 6), k)]


def hot_templates(n, rng):
    """Documents made of one template, similar to each other below 0.8, and for each a partner above."""
    template = [f"t{rng.getrandbits(40)}" for _ in range(404)]
    texts = []
    for _ in range(n):
        base = changed(template, spaced(404, 6, rng), rng)
        texts += [" ".join(base), " ".join(changed(base, spaced(404, 7, rng), rng))]
    return texts


def least_of_groups(texts):
    sets = [shingles(t) for t in texts]
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    return set(grouped(len(texts), [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near(sets[i], sets[j])]))


def stayed(spark, texts, parts=4):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return {r["doc_id"] for r in simhash.near_copies(df).collect()}


def test_partners_in_a_hot_template_equal_brute_force(spark):
    texts = hot_templates(150, random.Random(5))
    assert 130 < len(least := least_of_groups(texts)) < 160
    assert stayed(spark, texts) == least


def test_layout_and_neighbours_do_not_decide(spark, monkeypatch):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    few = [t for base in (words(184) for _ in range(20)) for t in (" ".join(base), " ".join(changed(base, spaced(184, 4, rng), rng)))]
    texts = few + hot_templates(60, rng)
    one = stayed(spark, texts, 1)
    assert {i for i in one if i < 40} == set(range(0, 40, 2)) == stayed(spark, few)
    monkeypatch.setattr(simhash, "PER_TASK", 500)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    monkeypatch.setattr(simhash, "BELOW", 1)
    monkeypatch.setattr(simhash, "PART", 16)
    monkeypatch.setattr(simhash, "WHOLE", 32)
    assert stayed(spark, texts, 7) == one == least_of_groups(texts)


@pytest.mark.parametrize("n, k", [(184, 4), (304, 6), (164, 3), (264, 4)])
def test_every_pair_at_the_threshold_is_found(spark, n, k):
    rng = random.Random(n)
    texts = []
    for _ in range(150):
        base = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(changed(base, spaced(n, k, rng), rng))]
    a, b = shingles(texts[0]), shingles(texts[1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.87
    assert stayed(spark, texts) == set(range(0, 300, 2))


def without_links(*_):
    def run(batches):
        for _ in batches:
            pass
        return iter(())

    return run


def close_and_far(rng):
    """Pairs with one changed word in 304, and pairs at the threshold."""
    texts = []
    for k in [1] * 60 + [6] * 60:
        base = [f"w{rng.getrandbits(40)}" for _ in range(304)]
        texts += [" ".join(base), " ".join(changed(base, spaced(304, k, rng), rng))]
    return texts


def test_fingerprints_link_near_copies_and_prefixes_the_rest(spark, monkeypatch):
    texts = close_and_far(random.Random(12))
    marks = [plain_fingerprint(t, 5) for t in texts]
    near = {i for i in range(0, len(texts), 2) if (marks[i] ^ marks[i + 1]).bit_count() <= 4}
    assert 40 < len(near) < 90
    with monkeypatch.context() as m:
        m.setattr(simhash, "_similar_links", without_links)
        assert stayed(spark, texts) == set(range(len(texts))) - {i + 1 for i in near}
    assert stayed(spark, texts) == set(range(0, len(texts), 2))


def test_equal_fingerprints_are_confirmed_on_whole_sets(spark, monkeypatch):
    """A trie of one fingerprint alone: half of its texts are copies, the others only look like it."""
    rng = random.Random(13)
    base = [f"w{rng.getrandbits(40)}" for _ in range(104)]
    texts = [" ".join(changed(base, spaced(104, 1, rng), rng)) for _ in range(20)] + [" ".join(f"w{rng.getrandbits(40)}" for _ in range(30)) for _ in range(20)]
    monkeypatch.setattr(simhash, "signature", lambda hashes, k=1: np.zeros(k, dtype=np.uint64))
    monkeypatch.setattr(simhash, "_similar_links", without_links)
    assert stayed(spark, texts) == least_of_groups(texts) == {0, *range(20, 40)}


def test_a_leaf_of_many_equal_marks():
    n = 4000
    got = [x.size for x, _ in simhash.trie_links(np.zeros(n, dtype=np.int64), np.full(n, 7, dtype=np.uint64), 4)]
    assert sum(got) == n * (n - 1) // 2 and max(got) <= 2 << 20
