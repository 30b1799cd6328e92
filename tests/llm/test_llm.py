"""The corpus operators against plain Python, on whole small tables and on odd ones."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from rastrel.llm import decontaminate, line_runs, mixing, ngram_join, queries, textops, toxicity, url_filter, wavelet
from rastrel.llm.licenses import PHRASES, license_scan
from rastrel.llm.quality import MOST_COVERED, MOST_LINES, keep_quality, quality_metrics
from rastrel.llm.secrets import secret_spans

from ..conftest import DATA, rows
from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, sig long, hit_id long, kept_id string, items int, `Text ` string"
PASSAGE = " ".join(f"pass{k % 37}x{k}" for k in range(60))
LONG = " ".join(f"w{k * k % 9973}" for k in range(30_000))


def _odd_rows():
    base = " ".join(f"n{k}" for k in range(40))
    near = base.replace("n7 ", "x7 ")
    texts = [
        (0, None), (1, ""), (2, " \n\t \x0b"), (3, "one"), (3, "one"), (4, "One  two three"), (5, "one two THREE"), (6, base), (7, near), (8, base.upper()), (9, near + " tail"),
        (10, LONG), (11, LONG + " end"), (12, PASSAGE), (13, "start line here\n" + PASSAGE + "\nlast"), (14, "a\nb\n\na\nb\n" + PASSAGE), (None, base), (15, "ünï côdé — 日本語 " * 9),
        (16, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" AKIA' + "B7" * 9 + " tail secret=token: abcdef"), (17, "Released under the MIT License. CC BY-NC 4.0; apache license, version 2.0"), (18, "same same same " * 30), (19, "<|endoftext|> The end, isn't it?! don't..."),
    ]
    return [(i, t, None if k % 3 else "en", None if k % 4 == 0 else "s" + str(k % 2), None, 1, 2, 3, "k", 4, "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in _odd_rows()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    return table, [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, duck):
    got, want = queries.QUERIES[name](spark, f"{DATA}/sf0.01").toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert rows(got) == rows(want)


# ---------------------------------------------------------------- kernels


def test_words_and_hashes_do_not_depend_on_blocks():
    texts = ["", "a bb", "ccc", " d ", "ccc bb", "é è"]
    for limit in (1, 5, 1 << 20):
        out = []
        for _, _, raw, at in textops.blocks(pa.array(texts), limit):
            s, e = textops.spans(raw, at, textops.SPACES)
            out += zip([bytes(raw[a:b]).decode() for a, b in zip(s, e)], textops.hashes(raw, s, e).tolist())
        assert [w for w, _ in out] == " ".join(texts).split()
        assert len(set(out)) == len({w for w, _ in out})


# ---------------------------------------------------------------- 1: join


def _components(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None)


def _wanted(pairs):
    got = brute.components([p for p in pairs if p[0] is not None])
    return sorted((i, *got[i]) for i, _ in pairs if i is not None)


def test_join_on_odd_rows(odd, pairs, empty):
    assert _components(ngram_join.ngram_jaccard_components(odd)) == _wanted(pairs)
    assert ngram_join.ngram_jaccard_components(empty).count() == 0


def _random_family(seed):
    rng, out = random.Random(seed), []
    common = [f"c{k}" for k in range(30)]
    for family in range(6):
        words = [rng.choice(common) if rng.random() < 0.3 else f"f{family}w{k}" for k in range(rng.randint(20, 90))]
        for _ in range(12):
            copy = [w if rng.random() > 0.02 else rng.choice(common) for w in words]
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("classes", [None, (4096, 65536), (2, 4), (1,)])
def test_token_combinations_lose_no_link(spark, classes):
    family = _random_family(3)
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert _components(ngram_join.ngram_jaccard_components(df, classes=classes)) == _wanted(family)


def test_signatures_of_linking_sets_meet():
    rng = np.random.default_rng(5)
    for n in (4, 21, 60, 250):
        for _ in range(12):
            x = rng.integers(0, 1 << 48, n).astype(np.uint64)
            y = x.copy()
            change = rng.permutation(n)[: n // 8]
            y[change] = rng.integers(0, 1 << 48, len(change)).astype(np.uint64)
            df = {int(t): int(rng.integers(2, 9)) for t in np.concatenate([x, y])}
            both = len(set(x.tolist()) & set(y.tolist()))
            if 4 * both < 3 * (2 * n - both):
                continue
            sig = [ngram_join.signatures(np.sort(s), np.array([df[int(t)] for t in np.sort(s)], np.uint32), n, 3, 4, [2, 4])[0] for s in (x, y)]
            assert len(np.intersect1d(*sig))


def test_representatives_keep_columns(odd, pairs):
    kept = ngram_join.keep_representatives(odd)
    assert kept.columns == odd.columns
    stay = {i for i, _, c in _wanted(pairs) if i == c}  # rows equal in id and text are one document
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.where("doc_id is not null").collect()) == sorted({(i, t or "") for i, t in pairs if i in stay})


# ---------------------------------------------------------------- 2: tokens


def test_tokens_round_trip(odd, pairs, empty, spark):
    path = wavelet.tokenizer_file()
    got = wavelet.read_tokens(*wavelet.write_tokens(odd, path, shard_tokens=500))
    named = [(i, t) for i, t in pairs if i is not None]
    lead = brute.token_rows([(-1, t) for i, t in pairs if i is None], path)
    shift = sum(r[2] for r in lead)
    want = [(None, *r[1:]) for r in lead] + [(i, s + shift, n, c) for i, s, n, c in brute.token_rows(named, path)]
    key = lambda r: (r[1], r[2])
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert got.select("shard").distinct().count() > 3
    assert wavelet.read_tokens(*wavelet.write_tokens(empty, path)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 70_000])
def test_wavelet_file(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 700).astype(np.int32)
    f = wavelet.WaveletFile(wavelet.build(ids, [None, 5], np.array([n, 0])))
    assert (f.decode() == ids).all() and f.documents()[0] == [None, 5]
    for i in range(0, n, max(1, n // 7)):
        assert f.access(i) == ids[i]
    for t in [*set(ids[:5].tolist()), 100_000]:
        at = np.flatnonzero(ids == t)
        assert f.count(t) == len(at) and f.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [f.locate(t, k) for k in (0, len(at) // 2, len(at))] == ([int(at[0]), int(at[len(at) // 2]), None] if len(at) else [None] * 3)


def test_word_cache_equals_whole_texts(small):
    coder = wavelet.Encoder(open(wavelet.tokenizer_file()).read(), 1, True)
    texts = [*(t for _, t in small[1]), "it's IT'S don't “quoted” e\u0301, ＡＢ１２ İstanbul ΣΑΣ a.b,c... ,— x_1 <|startoftext|> z", "tab\tvt\x0bnbsp\u00a0\u2003wide", "1234 a1b2 ñandú,ñ!!?!a"]
    ids, n = coder.encode([t.encode() for t in texts])
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# ---------------------------------------------------------------- 3: URLs


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Example.ORG/es/1?q=/", "https://sub.example.org/en/12#x", "https://example.org/en/2", "ftp://notexample.org", "x://com/fr/", "x://a.com/de/b", "x://acom/de/b", "x://h/wp-admin/x", "x://casino.org?x", "x://h/a.jpeg", "a://b://c.org/", "x://é.org/ü?", "x://" + "a" * 5000 + ".com/fr/" + "b" * 5000]
    got = url_filter.url_verdicts(spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")).collect()
    for r in got:
        host, path, rule, verdict = brute.url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or verdict == r["verdict"])
    assert {r["page_id"]: r["verdict"] for r in got}[10] == "block"
    nameless = spark.createDataFrame([(None, "x://a.com/de/" + "b" * 60_000), (None, None), (3, "x://h"), (3, "x://h")], "page_id long, url string")
    assert sorted((r["rule"] or "", len(r["path"])) for r in url_filter.url_verdicts(nameless).collect()) == [("", 0), ("", 0), ("", 0), ("com/de/", 60_004)]
    assert url_filter.url_verdicts(nameless.limit(0)).count() == 0


def test_globs_match_as_fnmatch():
    import fnmatch

    rng = random.Random(7)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(200)]
    fits = url_filter.Automaton([url_filter.Glob(g.encode()) for g in globs]).run(words)
    assert fits.tolist() == [[fnmatch.fnmatchcase(w.decode(), g) for g in globs] for w in words]


# ---------------------------------------------------------------- 4: lines


def test_line_runs(odd, small, empty):
    for df, pairs in ((odd.where("doc_id is not null").dropDuplicates(["doc_id"]), sorted({(r[0], r[1]) for r in _odd_rows() if r[0] is not None})), small):
        for words, lines in ((50, 8), (3, 3), (1000, 5)):
            want = brute.cut_lines(pairs, words, lines)
            got = line_runs.dedup_lines(df, least_words=words, least_lines=lines).collect()
            assert {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"], r["longest_run"]) for r in got} == want
    assert line_runs.dedup_lines(empty).count() == 0 and line_runs.dedup_lines(odd).count() == odd.count()


# ---------------------------------------------------------------- 5: secrets


def test_secrets(odd, pairs, small, empty):
    for df, source in ((odd, pairs), small):
        want = sorted((repr(i), brute.base_secrets(t)) for i, t in source)
        got = sorted((repr(r["doc_id"]), [tuple(s) for s in r["spans"] if s["rank"] < 3]) for r in secret_spans(df).collect())
        assert got == [(i, [(a, k, n, b) for a, k, n, b in s]) for i, s in want]
    assert secret_spans(empty).count() == 0


def test_entropy_windows(spark):
    def highest(s):
        return max(-sum(c / 20 * math.log2(c / 20) for c in (s[i : i + 20].count(x) for x in set(s[i : i + 20]))) for i in range(len(s) - 19))

    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["k " + "".join(rng.choice(alphabet[: rng.choice([4, 12, 64])]) for _ in range(rng.randint(20, 60))) + "7a !" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"] if s["rank"] >= 3] for r in secret_spans(df, allow=[]).collect()}
    for k, t in enumerate(texts):
        word = t.split()[1]
        bits = 3.0 if all(c in "0123456789abcdefABCDEF" for c in word) else 3.8
        assert bool(got[k]) == (highest(word) >= bits - 1e-9)
    text = "x 550e8400-e29b-41d4-a716-446655440000 qT7zP0xW9mK2vB5nJ8sL4dG6hQ1 example-qT7zP0xW9mK2vB5nJ8"
    (r,) = secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [text[s["first"] : s["last"]] for s in r["spans"]] == ["qT7zP0xW9mK2vB5nJ8sL4dG6hQ1"]


# ---------------------------------------------------------------- 6: mixing


def test_mixing(spark, odd, empty):
    docs = spark.createDataFrame([(k, "w " * (5 + k % 7), "big" if k < 3000 else f"s{k % 5}") for k in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, target_entropy=0.95, most_repeats=None).toPandas()
    used = (got.n_tokens * got.copies).groupby(got.source).sum()
    total, share = got.n_tokens.sum(), used / used.sum()
    assert abs(used.sum() - total) < 0.01 * total
    assert abs(-(share * np.log(share)).sum() / math.log(len(share)) - 0.95) < 0.01
    limited = mixing.mix_sources(docs, most_repeats=1.5, budget_share=None).toPandas()
    reads = (limited.n_tokens * limited.copies).groupby(limited.source).sum() / limited.groupby("source").n_tokens.sum()
    assert limited.copies.min() >= 1 and abs(reads.max() - 1.5) < 0.02 and reads["big"] == 1
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(odd).count() == odd.count()
    again = mixing.realise(docs, most_repeats=1.5, budget_share=None)
    assert again.columns == docs.columns and again.count() == limited.copies.sum()


# ---------------------------------------------------------------- 7: decontamination


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_contamination(spark, odd, pairs, room):
    items = [(1, PASSAGE[:200]), (2, "Seven, n6 n7 n8 n9 n10 n11 n12 n13 n14 n15 n16"), (10, "same same"), (3, ""), (4, None), (5, "n6 n7 n8 n9 n10 n11 n12 n13 n14 n15")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, row int")
    got = decontaminate.contamination(odd, bench, broadcast_bytes=room).collect()
    want = brute.contaminated(pairs, items)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got) == sorted((repr(w[0]), *w[1:5]) for w in want)
    assert all(sum(s["last"] - s["first"] for s in r["spans"]) == r["n_hit"] for r in got)
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not w[5] for w in want)


def test_spans_are_cut_and_the_rest_stays(spark):
    text = "Keep This,  " + " ".join(f"Bad{k}" for k in range(12)) + "! and that."
    docs = spark.createDataFrame([(1, text), (2, "clean Text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"bad{k}" for k in range(12)))], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got == {1: "Keep This,  " + " " * 11 + "! and that.", 2: "clean Text", 3: None}


def test_empty_benchmark(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0


# ---------------------------------------------------------------- 8: toxicity


def test_toxicity_on_held_out_rows(spark):
    d = f"{DATA}/sf0.1"
    got = queries.op8_toxicity(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    assert all(brute.held_out(i) == h for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    rank, y = held.score.rank(), held.toxic
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.97 and held[held.predicted == 1].toxic.mean() > 0.9 and held[held.toxic == 1].predicted.mean() > 0.7


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all()
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    flat = toxicity.toxicity_scores(odd, labels.where("toxic = 0")).toPandas()
    assert flat.score.nunique() == 1


# ---------------------------------------------------------------- 9: licences


def test_licenses(odd, pairs, small, empty):
    for df, source in ((odd, pairs), small):
        got = license_scan(df).collect()
        assert sorted((repr(r["doc_id"]), r["n_words"], r["n_base"], repr(r["first_word"]), repr(r["last_word"]), r["base_labels"]) for r in got) == sorted((repr(i), n, b, repr(f), repr(w), s) for i, t in source for n, b, f, w, s in [brute.base_licenses(t, PHRASES)])
        assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"] for r in got)
        assert all(0 <= r["score"] <= 1 for r in got)
    assert license_scan(empty).count() == 0


def test_template_needs_its_key_phrase(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "the GNU project and a general licence for the public", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["gpl-3", "", "mit"]


# ---------------------------------------------------------------- 10: quality


def test_quality(odd, pairs, empty):
    got = quality_metrics(odd).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((repr(r["doc_id"]), *(r[f] for f in fields)) for r in got) == sorted((repr(i), *brute.quality(t, MOST_COVERED, MOST_LINES)) for i, t in pairs)
    kept = keep_quality(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_metrics(empty).count() == 0 and keep_quality(empty).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    d = f"{DATA}/sf0.001"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    bench = pd.read_parquet(f"{d}/benchmark.parquet")
    docs = docs[[brute.quality(t, MOST_COVERED, MOST_LINES)[6] for t in docs.text]]
    comp = brute.components(list(zip(docs.doc_id, docs.text)))
    docs = docs[[comp[i][1] == i for i in docs.doc_id]]
    bad = {r[0] for r in brute.contaminated(list(zip(docs.doc_id, docs.text)), list(zip(bench.item_id, bench.text))) if r[5]}
    docs = docs[~docs.doc_id.isin(bad)]
    table = spark.createDataFrame(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(table, most_repeats=corpus_pipeline.MOST_REPEATS, budget_share=None).collect()}
    assert min(copies.values()) == 1
    want = brute.token_rows([(i, t) for i, t in zip(docs.doc_id, docs.text) for _ in range(copies[i])], wavelet.tokenizer_file())
    got = corpus_pipeline.run(spark, d)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == sorted(want)
