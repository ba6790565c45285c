"""Splitting and lower-casing as the tokenizers library does, whatever Unicode versions the tables at hand have."""

import random
import struct
import unicodedata

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from barloom.llm import bpe


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_letters_and_numbers_are_the_library_s(name):
    path = public_tokenizers.path(name)
    own, lib = bpe.Tokenizer(open(path, "rb").read()), Tokenizer.from_file(path)
    lib.no_truncation()
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, codes))
    letters = {ord(c) for c in regex.findall(r"[\p{L}\p{N}]", text)}
    disputed = letters ^ {c for c in codes if unicodedata.category(chr(c))[0] in "LN"}
    assert len(disputed) > 10_000  # the tables do differ
    around = {c + d for c in disputed for d in (-1, 1)} & set(codes)
    rng = random.Random(1)
    texts = [f"a{chr(c)}b {chr(c)}1" for c in sorted(disputed | around | set(rng.sample(codes, 20_000)))]
    texts += ["".join(chr(rng.choice(codes)) for _ in range(30)) for _ in range(2000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert own.run(t)[0] == struct.pack(f"<{len(e.ids)}I", *e.ids), ascii(t)
