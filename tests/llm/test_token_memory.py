"""What one worker holds while it encodes and writes shards."""

import tracemalloc

import numpy as np
import pytest

from rastrel.llm import wavelet


@pytest.fixture(scope="module")
def model():
    with open(wavelet.tokenizer_file(), encoding="utf-8") as f:
        return f.read()


def _name(i: int) -> str:
    """A word of letters for each number."""
    return "q" + "".join(chr(97 + int(d)) for d in str(i))


def test_used_words_stay_and_the_others_go(model, monkeypatch):
    """Words that come again outlive a full store; ids are those of whole texts all the while."""
    monkeypatch.setattr(wavelet, "CACHED_WORDS", 400)
    coder = wavelet.Encoder(model, 1, True)
    learned, learn = [], coder._learn
    monkeypatch.setattr(coder, "_learn", lambda words: (learned.extend(words), learn(words)))
    common = ["the", "of", "and", "don't", "é", "naïve", "x1"]
    for k in range(6):
        texts = [" ".join(w for i in range(100) for w in (_name(300 * k + 100 * t + i), common[i % len(common)])) for t in range(3)] + [""]
        ids, sizes = coder.encode([t.encode() for t in texts])
        want = [x + [1] for x in coder._raw(texts)]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
        assert len(coder.number) == len(coder.sizes) and list(coder.number.values()) == list(range(len(coder.number)))
        assert len(coder.number) <= 400 + 320
    assert [learned.count(w) for w in (b"the", b"of", b"and")] == [1, 1, 1]
    assert _name(0).encode() in learned and _name(0).encode() not in coder.number


@pytest.mark.parametrize("n,alphabet,most", [(1 << 21, 40_000, 10), (600_000, 100_000, 20)])
def test_a_shard_is_built_in_steps(n, alphabet, most):
    """The temporaries of a shard are those of a step, not of all its tokens; the file holds the same tokens."""
    ids = np.random.default_rng(5).integers(0, alphabet, n, dtype=np.int32)
    wavelet.build(ids[:1000], [0], np.array([1000]))
    tracemalloc.start()
    raw = wavelet.build(ids, [0, None], np.array([n - 3, 3]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (wavelet.WaveletFile(raw).decode() == ids).all()
    assert peak < most * n, peak / n
