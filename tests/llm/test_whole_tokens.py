"""Letters that have a composed form in lower case only get the ids of the whole text."""

import numpy as np
from tokenizers import Tokenizer

from rastrel.llm import wavelet


def test_words_are_composed_before_they_are_lowered():
    path = wavelet.tokenizer_file()
    whole = Tokenizer.from_file(path)
    marks = ["H̱", "T̈", "J̌", "W̊", "Y̊"]
    texts = ["H̱allo", *marks, *("Ab." + m + "cD, Plain X" + m + "Y" for m in marks), "ÉT̈ ÉA ÄRGER", "PLAIN Words"]
    with open(path) as f:
        ids, sizes = wavelet.Encoder(f.read(), 1, True).encode([t.encode() for t in texts])
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
