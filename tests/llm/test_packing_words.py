"""The table of words that packing encodes from."""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from searchloom.llm import packing
from searchloom.llm._text import utf8


def test_words_are_found_in_an_open_table_and_encoded_once(monkeypatch):
    """Before, each word of a slice was looked up by itself, and the tokenizer's threads of all tasks took turns."""
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "UNITS", 40)  # begins anew again and again
    model, library, asked = packing.WordEncoder(path), Tokenizer.from_file(path), []
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    learn = model._learn
    monkeypatch.setattr(model, "_learn", lambda keys, strings: asked.extend(strings) or learn(keys, strings))
    for step in range(6):
        texts = [" ".join(f"Word{(7 * i + step) % 60}, x{i % 5}" for i in range(n)) for n in (0, 1, 9, 30)] + ["été. naïve!", "<s> a<b", None]
        asked.clear()
        ids, bounds = model.encode(*utf8(pa.array(texts)))
        assert len(asked) == len(set(asked)) and model.n <= len(model.begin)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
        asked.clear()
        model.encode(*utf8(pa.array(texts)))
        assert not asked


def test_keys_that_want_one_place_are_all_found():
    model = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    model.clear(100)
    last = len(model.keys) - 1
    keys = np.array([last + (n << 32) for n in range(40)] + [0, 1, 2], np.uint64)  # around the end of the table
    model._learn(keys, [f"w{n}" for n in range(len(keys))])
    assert model._found(keys).tolist() == list(range(len(keys)))
    assert (model._found(np.array([5, 1 << 40, last], np.uint64)) == [-1, -1, 0]).all()
