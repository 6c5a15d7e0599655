"""Distinct pretokens by a hash table, as sorting would give them; ids of the tokenizer's fast form."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sitegrain.llm import packing


def test_distinct_as_by_sorting():
    random = np.random.default_rng(0)
    for n in (1, 2, 50, 5000):
        keys = random.integers(0, 300, n).astype(np.uint64)
        for got, want in zip(packing.distinct(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert np.array_equal(got, want)


def test_ids_of_the_fast_form():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "plain words, plain words 123", "It's  naïve\n\n\tß 12½", "日本語 and 🙂 more", "a\u0085b <|endoftext|>"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = packing.Encoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    plain = Tokenizer.from_file(path)
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
