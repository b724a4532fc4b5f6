import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import tokens as T

public = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "\n\n  a", "a  ", "I'll've don't 's 'S ''s x''s 'llama", "<|endoftext|> x", "Ünïcödé 漢字 🎉 е́", "a" * 5000, "    \t\r\n x", "iVBORw0KGgo+v5L5Te97AOb9X", "\u0000\u001b[0m", "don’t", "１２ ½ ²x"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_public_tokenizer(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "y"), (3, TEXTS[3], "z")], "doc_id long, text string, ids string")
    rows = T.token_ids(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.ids == reference("a" if r.doc_id is None else TEXTS[r.doc_id]), r
    assert T.token_ids(df.limit(0)).count() == 0


def test_random_texts_and_round_trip(reference):
    e = T.CorpusEncoder(T.vocabulary_path())
    rng = random.Random(0)
    alphabet = "abc'stlverdm   \n\t12é漢ß<|endoftext|>🎉ABCxyz/+"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, at = e.encode_texts(texts)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == reference(t), t
        assert e.encoder.decode(own).decode() == t


def merged_by_rank(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_backtracking_equals_merging_by_rank():
    ranks = T.load_ranks(T.vocabulary_path())
    e = T.BacktrackingEncoder(ranks)
    rng = random.Random(0)
    for alphabet in (b"abcdef", b"=-", b"etaoin shrdlu", bytes(range(256))):
        for _ in range(300):
            piece = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            assert e.encode(piece) == merged_by_rank(ranks, piece)


def test_pre_tokens_that_share_a_hash(reference):
    """Two Thue-Morse words of 1,024 letters: polynomial hashes modulo 2^64 can't tell them apart."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    texts = [word, other, f"{other} x {word}", "", other]
    ids, at = T.CorpusEncoder(T.vocabulary_path()).encode_texts(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == reference(t)


def test_decode(spark):
    df = T.token_ids(spark.createDataFrame(list(enumerate(TEXTS[1:])), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in T.decoded(df).collect()} == dict(enumerate(TEXTS[1:]))
    assert T.decoded(df.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))).where("text IS NOT NULL").isEmpty()
