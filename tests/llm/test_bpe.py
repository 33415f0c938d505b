import random
from pathlib import Path

import pytest

from worldfold.llm import bpe
from worldfold.llm.queries import RANKS

from .helpers import with_extras

pytestmark = pytest.mark.skipif(not Path(RANKS).exists(), reason="no rank file")


def test_parts_join_to_the_whole_and_change_no_token():
    encoding, rng = bpe.load(RANKS), random.Random(4)
    bits = ["the", " of", "  ", "\n\n", "é", "123", "'s", "!!", " \t", "日本", "word", " ", "a1b2", " ", "🙂"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(200)))
        for size in (1, 3, 17):
            assert "".join(bpe.parts(text, size)) == text
            assert bpe.encode(text, encoding, size) == encoding.encode_ordinary(text)


def test_documents_round_trip(spark):
    rows = [(1, "Hello wörld"), (2, ""), (3, None), (4, "<|endoftext|> is text"), (5, "long words " * 30_000), (None, "x"), (1, "Hello wörld"), (6, "a" * 5000)]
    out = bpe.encode_documents(with_extras(spark.createDataFrame(rows, "doc_id long, text string")), RANKS)
    got = out.collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got if r["n_bytes"] is not None)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["tokens"] is None and by[2]["tokens"] == [] and by[5]["n_bytes"] == 330_000
    back = {r["doc_id"]: r for r in bpe.decode_documents(out, RANKS).collect()}
    assert back[1]["text"] == "Hello wörld" and back[3]["raw"] is None and back[2]["text"] == ""
    assert bpe.encode_documents(out.selectExpr("doc_id", "'' as text").limit(0), RANKS).count() == 0


def test_raw_bytes_of_a_split_character(spark):
    encoding = bpe.load(RANKS)
    tokens = encoding.encode_ordinary("🙂")
    assert len(tokens) > 1
    cut = spark.createDataFrame([(1, tokens[:1]), (2, tokens)], "doc_id long, tokens array<int>")
    back = {r["doc_id"]: r for r in bpe.decode_documents(cut, RANKS).collect()}
    assert back[1]["text"] is None and bytes(back[1]["raw"]) == encoding.decode_bytes(tokens[:1]) and back[2]["text"] == "🙂"
