"""Alignment of two tokenizers against whole texts encoded one by one."""

import hashlib
import json
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rastrel.llm import queries
from rastrel.llm.alignment import align_tokenizers, byte_alphabet, cuts_at_spaces
from rastrel.llm.wavelet import tokenizer_file

from ..conftest import DATA

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(docs):
    a, b = Tokenizer.from_file(tokenizer_file(A)), SentencePieceProcessor(model_file=tokenizer_file(B))
    a.encode_special_tokens = True
    letters, spell = byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    told = []
    for _, text in docs:
        ids, pieces = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in spell[i]) for i in ids]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        whole = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(bytes_a) == whole == b"".join(bytes_b):
            ends = [{sum(map(len, side[: k + 1])) for k in range(len(side))} for side in (bytes_a, bytes_b)]
            x = y = 0
            for end in sorted(ends[0] & ends[1]):
                ours, theirs = [], []
                while x < len(ids) and sum(map(len, bytes_a[: x + 1])) <= end:
                    ours, x = [*ours, ids[x]], x + 1
                while y < len(pieces) and sum(map(len, bytes_b[: y + 1])) <= end:
                    theirs, y = [*theirs, pieces[y]], y + 1
                groups.append((ours, theirs))
        told.append(groups)
    links = [Counter((s, t) for ours, theirs in g for s in ours for t in theirs) for g in told]
    count = Counter(p for own in links for p in own)
    best = {}
    for (s, _), n in count.items():
        best[s] = max(best.get(s, 0), n)
    out = []
    for (i, _), groups, own in zip(docs, told, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), text))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in align_tokenizers(df, tokenizer_file(A), tokenizer_file(B), **how).collect()), key=repr)


def odd():
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "  two  spaces \n\n  x \n y\t z", "日本語 テキスト 。。", "a　b\xa0c 　 d", "<|endoftext|> <s> </s> <0x0A>", "x▁y and more", "don't  stop   ", "é é", "🙂 🙂🙂", "a\x00b \x1c c \x1d", "same text", "same text", "same text", "d" * 400 + " " + "e" * 3]
    texts += ["".join(rng.choice(" \n\t ab1.,é日🙂' ") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    return [(None if k == 14 else k % 100, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("most", [1 << 19, 20])
def test_odd_texts(spark, most):
    docs = odd()
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, pair int, key string").repartition(3)
    assert got(df, most_pairs=most) == brute(docs)
    assert got(df.where("doc_id < -1"), most_pairs=most) == []


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 3000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df, digest=True) == sorted(((*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in brute(docs)), key=repr)
    frame = queries.QUERIES["op12_tokenizer_alignment"](spark, f"{DATA}/sf0.001")
    assert frame.count() == 200 and frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_vocabularies():
    assert cuts_at_spaces(["▁", "▁▁", "▁a", "a"]) and not cuts_at_spaces(["a▁b"])
    with open(tokenizer_file(A)) as f:
        assert set("".join(json.load(f)["model"]["vocab"]).removeprefix("<|endoftext|>")) <= set(byte_alphabet())
