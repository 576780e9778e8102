import random
import re

from driftfield.llm import decontaminate
from driftfield.llm.decontaminate import WINDOW, Patterns, united, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute(doc, items):
    words, hit, found = WORD.findall(lower(doc)), set(), set()
    for item, text in items:
        w = WORD.findall(lower(text))
        m = min(WINDOW, len(w))
        for i in range(len(w) - m + 1) if m else ():
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "of", "The", "é", "x1", "Ω", "zz"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 7, 8, 9, 14]))) for i in range(12)] + [(90, None), (91, ""), (92, "!!"), (3, text(9))]
    docs = [text(rng.randint(0, 60)) for _ in range(30)] + [items[0][1] + " " + items[5][1], "The " * 400, None, "", "?"]
    return docs, items


def test_search_equals_brute_force():
    for seed in range(5):
        docs, items = data(seed)
        patterns = Patterns([(i, t.encode() if t is not None else None) for i, t in items])
        for d in docs:
            words = words_of(d.encode() if d is not None else None)
            spans, found, full = patterns.hits(words)
            assert (len(words), sum(b - a for a, b in united(spans)), sorted(map(str, found))) == brute(d, items)
            assert full == any(b - a >= WINDOW for a, b in spans)


def test_operator_in_one_part_and_in_many(spark, monkeypatch):
    docs, items = data(7)
    df = spark.createDataFrame([(i, d, "mine") for i, d in enumerate(docs + docs[:2])], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [brute(d, items) for d in docs + docs[:2]]
    for size in (decontaminate.PART_BYTES, 40):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.search(df, bench).collect()}
        assert [got[i] for i in range(len(want))] == want


def test_empty_tables(spark):
    df, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.search(df.where("false"), bench).count() == 0
    r = decontaminate.search(df, bench.where("false")).first()
    assert (r["n_words"], r["n_hit"], r["items"], r["full"]) == (2, 0, [], False)
