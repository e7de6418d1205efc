"""Grammar files: many pairs that share slots, and several blocks in a part."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelspark.llm import grammar

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


@pytest.mark.parametrize("spread", [40, 700, 40_000])
def test_documents_come_back_whole_and_one_by_one(spread):
    rng = np.random.default_rng(spread)
    flat = (rng.zipf(1.2, 300_000) % spread).astype(np.uint32)
    docs = np.split(flat, np.sort(rng.choice(np.arange(1, len(flat)), 500, replace=False)))
    file = grammar.GrammarFile(grammar.to_file(list(range(len(docs))), docs, 50_000))
    assert len(file.rules) > 100
    assert (file.expand(file.symbols) == flat).all()
    for k in range(0, len(docs), 7):
        assert (file.document(k) == docs[k]).all()
    # no rule spans more than it says, and every rule is used by what comes after it
    for k in range(0, len(file.rules), 50):
        assert len(file.expand(np.array([50_000 + k]))) == file.token_length(50_000 + k)


def test_the_most_frequent_pair_goes_first():
    flat = np.array([1, 2, 3] * 50 + [2, 3] * 50, np.uint32)
    file = grammar.GrammarFile(grammar.to_file([0], [flat], 10))
    assert file.rules[0].tolist() == [2, 3]
    assert (file.document(0) == flat).all()


def test_several_blocks_in_a_part(spark):
    texts = [f"one two {k} three, four\nfive " * (k % 9) for k in range(120)] + [None, "", "<|endoftext|> a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = grammar.write_grammars(docs, TOKENIZER, block_ids=50)
    assert files.filter("block > 2").count() > 0
    found = {r["doc_id"]: r for r in grammar.read_grammars(files).collect()}
    library, start = Tokenizer.from_file(TOKENIZER), 0
    for k, text in enumerate(texts):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [grammar.END_ID], "<u4")
        assert (found[k]["start"], found[k]["n_tokens"], found[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(texts)
