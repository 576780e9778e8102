import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftfield.llm import bpe, registry

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [None, "", " ", "\n\n", "a", "the of and", "Don't we'll 123 4567", "naïve żółć 日本語 😀👍🏽", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "\0<|endoftext|>", "ab" * 4000, " " * 3000, "#" * 777, "tab\t\x0b\x1c\x85\xa0  end ", "՘ ࢏ a₝1", "the of and", "the of and"]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(registry.tokenizer_file())


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(open(registry.tokenizer_file(), encoding="utf-8").read())


def random_texts(n):
    rng = random.Random(11)
    words = "the of erheou 'll don't 12 345 é 日 <|endoftext|> ## \t \n \x85 \xa0 　 👍🏽 ½ a_b".split(" ")
    return ["".join(rng.choice(words) + rng.choice([" ", "", "  ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_ids_equal_the_library(merges, reference):
    words = [b"the", b" the", b" of", b"erheou"]
    lexicon = bpe.Lexicon.over(bpe.Lexicon.compiled({w: merges.encoded([w])[0].tolist() for w in words}).packed())
    encoder, decoder = bpe.Encoder(merges, lexicon), bpe.Decoder(merges)
    texts = [t or "" for t in TEXTS] + random_texts(4000)
    flat, counts = encoder.encoded(pa.array(texts))
    ends = [0, *counts.cumsum()]
    want = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert decoder.decoded(flat, counts).to_pylist() == [reference.decode(i, skip_special_tokens=False) for i in want]


def test_lexicon_finds_its_words_and_no_others(merges, tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): None for _ in range(500)}
    words = {w: [k, k + 1][: 1 + k % 2] for k, w in enumerate(words)}
    built = bpe.Lexicon.compiled(words)
    (tmp_path / "lexicon").write_bytes(built.packed())
    lexicon = bpe.Lexicon.mapped(str(tmp_path / "lexicon"))
    asked = [*words, b"", b"d", b"abcabcabcabc", b"a\xff"]
    for w, at in zip(asked, lexicon.find(asked)):
        assert (at >= 0) == (w in words)
        if at >= 0:
            assert lexicon.ids[lexicon.start[at] : lexicon.start[at + 1]].tolist() == words[w]
    assert lexicon.accepts.size < sum(map(len, words)) / 2  # suffixes are shared


def test_empty_lexicon(merges):
    lexicon = bpe.Lexicon.over(bpe.Lexicon.compiled({}).packed())
    assert lexicon.find([b"a", b""]).tolist() == [-1, -1]


def test_bytes_that_are_no_text_become_replacement_characters(merges, reference):
    import numpy as np

    ids = [merges.single[0xE6], merges.single[0x41], 50256]
    assert bpe.Decoder(merges).decoded(np.array(ids), np.array([3])).to_pylist() == [reference.decode(ids, skip_special_tokens=False)]


def test_operators_keep_rows_and_clashing_columns(spark, reference):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, IDS string")
    codec = bpe.Codec(spark, registry.tokenizer_file(), bpe.frequent_words(df, least=1))
    coded = bpe.decode(bpe.encode(df, codec), codec)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in coded.collect()}
    assert got == {i: (reference.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.where("false"), codec).count() == 0


def test_frequent_words_come_whole_counts_at_a_time(spark):
    df = spark.createDataFrame([("a a a a b b b b c",), (None,), ("",)], "text string")
    assert sorted(bpe.frequent_words(df, most=2)) == ["a", "b"] and bpe.frequent_words(df, most=1) == []
    assert df.select(F.col("text")).count() == 3


def test_the_query_equals_the_library(spark, reference, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS + random_texts(200) + ["word " * 200_000 + "日本語" * 50_000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r[1:]) for r in registry.op1_bpe(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))), t
