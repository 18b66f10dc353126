"""Token ids of extreme texts are those of the library."""

import random

import numpy as np
import pytest

from curbflow.llm import packing

MB = 1_000_000


LONG = {
    "10 MB of blanks": lambda draw: " " * (10 * MB),
    "10 MB without blanks": lambda draw: "".join(draw.choice("abcdefghij日本é") for _ in range(MB)) * 8,
    "mixed blanks": lambda draw: "".join(draw.choice(" \n\t　\x85") for _ in range(2 * MB)) + "word",
    "words and runs": lambda draw: "ab 'll " + " " * (2 * MB) + "12 x\n" + "\n" * (2 * MB) + "<|endoftext|>" + "\t" * (2 * MB) + "<|endoftext|>y " + " " * 20_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts(name):
    tokenizers = pytest.importorskip("tokenizers")
    coder, text = tokenizers.Tokenizer.from_file(packing.vocabulary()), LONG[name](random.Random(5))
    assert packing.tokens(packing.vocabulary()).ids(text).tolist() == coder.encode(text, add_special_tokens=False).ids


def test_careful_path_agrees(monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 3)
    tokens, draw = packing.tokens(packing.vocabulary()), random.Random(2)
    marks = [" ", "  ", "    ", "\n", "\n\n\n\n", "\t", "a", "Bc", "é", "日", "!", "12", "'s", "<|endoftext|>", "\0", "\x1c", "　", "\x85", "\r\n"]
    for _ in range(3000):
        text = "".join(draw.choice(marks) for _ in range(draw.randint(0, 20)))
        assert np.concatenate(list(tokens.parts(text))).tolist() == tokens.coder.encode_to_numpy(text, allowed_special="all").tolist()


def test_extreme_rows_are_packed(spark):
    docs = spark.createDataFrame([(1, " " * (3 * MB)), (2, "x" * MB), (3, None)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and max(r.length for r in rows) <= packing.CAPACITY
