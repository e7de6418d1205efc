"""Remembered pieces give the ids that the tokenizer gives for whole texts."""

import random

import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

from panelspark.llm import encode, queries

PARTS = ["la", "de", "É", "ç", "ß", "x", "  ", " ", "\n", "\n\n", ".", ",", "'", "'s", "…", "日本", "́", "1", "_", "***", "<|endoftext|>", "İ", "ª", "\t", "\r\n", "😀", "Dž", "’s", " a", " bc", " La", ".\nDe"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 500)  # so that pieces are set aside and found again
    encoder = encode.Encoder(queries.tokenizer(name))
    draw = random.Random(3)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(14))) for _ in range(6000)] + ["word " * 3000, "x" * 5000, "", " ", "\n"]
    found = [ids.tolist() for low in range(0, len(texts), 700) for ids in encoder(texts[low : low + 700])]
    assert found == encoder.encode(texts)
    sliced = pa.array(["before", *texts[:50]]).slice(1)
    assert [ids.tolist() for ids in encoder(sliced)] == found[:50]
    assert encoder([]) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_the_library(name):
    plain = Tokenizer.from_file(queries.tokenizer(name))
    draw = random.Random(11)
    parts = [*PARTS, "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "<|end", "oftext|>", "<|endoftext|><|endoftext|>"]
    texts = ["a b<|endoftext|> c", "<|endoftext|>", " <|endoftext|> "] + ["".join(draw.choices(parts, k=draw.randrange(14))) for _ in range(4000)]
    found = [ids.tolist() for ids in encode.Encoder(queries.tokenizer(name))(texts)]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert plain.token_to_id("<|endoftext|>") in found[0]


def test_added_tokens_found_in_another_way(tmp_path):
    plain = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    plain.add_tokens([AddedToken("<mask>", lstrip=True), AddedToken("word", single_word=True)])
    plain.save(str(tmp_path / "more.json"))
    texts = ["a  <mask> b", "a word b", "swordfish", "", "two\n<mask>"]
    assert [ids.tolist() for ids in encode.Encoder(str(tmp_path / "more.json"))(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
