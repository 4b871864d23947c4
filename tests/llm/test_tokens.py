"""Texts that a fast tokenizer gives up on are encoded all the same."""

import numpy as np
from tokenizers import Tokenizer

from salonlake.llm import tokens


def test_a_million_blanks():
    path = tokens.default_path()
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    for text in (" " * 1_000_000 + "x", "\n" * 1_000_000, "a " + "\t" * 1_000_000 + "b"):
        got = np.frombuffer(tokens.coder(path, True).encode(text), "<u4")
        assert got.tolist() == exact.encode(text, add_special_tokens=False).ids
