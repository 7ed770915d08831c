"""Tokenizer alignment, the lexicon codec and whitening against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from capsight.llm import alignment, lexicon_bpe, whitening
from capsight.llm.packing import _byte_letters
from capsight.llm.queries import QUERIES
from capsight.llm.text import slices

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = ["", None, " ", "  two  spaces", "tab\t\nline", "▁", "a▁b", "<|endoftext|>", "x<|endoftext|>'s <0x41><s>", "日本語テキスト",
       "naïve café", "é ﬁ ½ ²", "😀😀 👩‍👩‍👧", "'s don't we'll I'VE 'tis", " nbsp em", "\x00\x01", "a" * 5000, " " * 3000,
       "don't" * 400, "٣٤ ⅷ", "﻿bom", LONG, "tab\t\nline"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- alignment

def brute_alignment(rows):
    spec = vocabulary("byte_bpe_50k.json")
    a_model = Tokenizer.from_file(spec)
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    letters = _byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a_model.id_to_token(i))

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            x, y = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                i = j = at = bt = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at <= bt and i < len(a):
                        left.append(a[i])
                        at += len(x[i])
                        i += 1
                    else:
                        right.append(b[j])
                        bt += len(y[j])
                        j += 1
                    if at == bt:
                        groups.append((left, right))
                        left, right = [], []
        found.append((doc_id, groups))
    links = [collections.Counter() for _ in found]
    for c, (_, groups) in zip(links, found, strict=True):
        for left, right in groups:
            for p, np_ in collections.Counter(left).items():
                for q, nq in collections.Counter(right).items():
                    c[p, q] += np_ * nq
    count = collections.Counter(pair for c in links for pair in c)
    best = collections.Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for c, (doc_id, groups) in zip(links, found, strict=True):
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_tokenizer_alignment"](spark, MIDDLE)
    assert got.columns[0] == "doc_id" and rows_of(got) == brute_alignment(rows)


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_of_odd_texts(spark, hot):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(ODD)] + [(7, "tab\t\nline"), (7, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rid", F.lit("x"))
    assert rows_of(alignment.report(df.repartition(5), hot_pairs=hot)) == brute_alignment(rows)


def test_alignment_of_long_groups(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_WHOLE_GROUP", 2)
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        aligner = alignment.Aligner(spec, f.read())
    texts = [t or "" for t in ODD]
    few = aligner.align(texts)
    monkeypatch.setattr(alignment, "_WHOLE_GROUP", 1 << 30)
    many = aligner.align(texts)
    for key in few:
        for x, y in zip(few[key], many[key], strict=True):
            assert np.array_equal(x, y)


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.report(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(alignment.report(blank)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# --- encoding and decoding

def brute_codec(rows):
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids
        back = model.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_codec_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_lexicon_bpe"](spark, MIDDLE)) == brute_codec(rows)


@pytest.mark.parametrize("words", [0, 5, lexicon_bpe.WORDS])
def test_codec_of_odd_texts(spark, words):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(4)
    assert rows_of(lexicon_bpe.report(df, words=words)) == brute_codec(rows)
    assert lexicon_bpe.report(df.limit(0), words=words).count() == 0


def test_codec_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lexicon = lexicon_bpe.prepare(docs)
    back = lexicon_bpe.decode(lexicon_bpe.encode(docs, lexicon), lexicon)
    assert rows_of(back) == rows_of(docs.select("doc_id", "text"))
    broken = spark.createDataFrame([(1, [50256, 187]), (2, None), (3, [])], "doc_id long, ids array<int>")
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert rows_of(lexicon_bpe.decode(broken, lexicon)) == [
        (1, model.decode([50256, 187], skip_special_tokens=False)), (2, ""), (3, "")]


def test_codec_of_random_strings(tmp_path):
    """Words are cut and merged as the tokenizer does, whatever characters meet."""
    rng = random.Random(3)
    common = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\r", "1", "²", "é", "<|endoftext|>", "<|end",
              "　", "​", "'S", "!", "\x85", "\x1c", " don't", " the", "日", "😀", "ſ", "٣", "_"]
    rare = [chr(rng.randrange(0x20, 0xD7FF)) for _ in range(300)] + [chr(rng.randrange(0xE000, 0x2FFFF)) for _ in range(150)]
    texts = ["".join(rng.choice(rare if rng.random() < .15 else common) for _ in range(rng.randrange(40))) for _ in range(8000)]
    texts += ["ab" * 3000, "'s" * 1000, "a" * 99, "a" * 100, "a" * 101, "ab c" * 40]
    name = vocabulary("byte_bpe_50k.json")
    with open(name, encoding="utf-8") as f:
        spec = f.read()
    words = [b" the", b"the", b"th", b"", b" don", b"'t", b"'s", b"ll", b" ", b"  "]
    file = tmp_path / "lexicon"
    file.write_bytes(lexicon_bpe.compile_lexicon(spec, [w for w in words if w]))
    codec = lexicon_bpe.Codec(spec, str(file))
    got = []
    for _, _, buf, off in slices(pa.array(texts, pa.string()), 1 << 14):
        ids, cut = codec.encode(buf, off)
        got += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert got == [e.ids for e in Tokenizer.from_file(name).encode_batch(texts, add_special_tokens=False)]


def test_automaton():
    """Every word has its place, no other word any, and equal endings are shared."""
    rng = random.Random(5)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) for _ in range(600)})
    auto = lexicon_bpe.build_automaton(words)
    auto["longest"] = np.array([6])
    tried = [*words, b"", b"abcabca", *(bytes(rng.choices(b"abcd", k=rng.randrange(1, 8))) for _ in range(500))]
    length = np.array([len(w) for w in tried])
    buf = np.frombuffer(b"".join(tried), np.uint8)
    number = lexicon_bpe.walk(auto, buf, np.cumsum(length) - length, length)
    place = {w: i for i, w in enumerate(words)}
    assert number.tolist() == [place.get(w, -1) for w in tried]
    ends = [a + b for a in (b"x", b"y", b"z", b"xx") for b in (b"ing", b"ed", b"s")]
    # the root, behind x, behind y or z or xx, behind i, in and e, and the end (a trie has 29)
    assert len(lexicon_bpe.build_automaton(sorted(ends))["final"]) == 7


def test_other_tokenizers_are_refused():
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        lexicon_bpe.check_spec(f.read())


# --- whitening

def brute_whitening(rows, components=32):
    ids = [r[0] for r in rows]
    x = np.array([[int(np.floor(64 * c)) + 1000000 for c in r[1]] for r in rows], object)
    n, s = len(rows), x.sum(axis=0)
    moved = n * x - s
    centred = (moved / n).astype(float)
    v = centred.T @ centred / n
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    return ids, n, (moved * moved).sum(axis=1), centred @ vector / np.sqrt(value), value / np.trace(v)


def check_whitening(got, rows):
    ids, n, deviation, white, share = brute_whitening(rows)
    k = white.shape[1]
    by_id = {i: r for r, i in enumerate(ids)}
    assert len(got) == n * k and {(r["vec_id"], r["component"]) for r in got} == {(i, c) for i in ids for c in range(1, k + 1)}
    y = np.zeros((n, k))
    for r in got:
        at, c = by_id[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[at] and abs(r["explained"] / share[c] - 1) < 1e-9
        assert r["identity_error"] < 1e-9
        y[at, c] = r["whitened"]
    sign = np.sign((y * white).sum(axis=0))
    assert np.abs(y * sign - white).max() < 1e-6
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-9


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(QUERIES["op13_block_whitening"](spark, MIDDLE).collect(), rows)


def test_whitening_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 5 * 9)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(403, 5)) @ rng.normal(size=(5, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    check_whitening(whitening.report(df).collect(), rows)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 4), float(i * i % 7), 1.0]) for i in range(12)] + [(3, [0.5, 2.0, 1.0]), (None, [0.25, 1.0, 1.0])]
    bad = [(50, None), (51, []), (52, [nan, 1.0, 1.0]), (53, [inf, 1.0, 1.0]), (54, [None, 1.0, 1.0]), (55, [1.0, 2.0]), (56, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("index", "n", "x", "component", "rid")})
    got = whitening.report(df).collect()
    assert len(got) == 14 * 3 and {r["n"] for r in got} == {14}
    # the third dimension is constant: no direction to whiten
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got) and abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-9
    assert whitening.report(df.limit(0)).count() == 0
    one = whitening.report(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, 0.0), (2, 0, None, 0.0)]
    huge = [(1, [1e14, 0.0]), (2, [-1e14, 1.0]), (3, [0.0, 2.0])]
    out = whitening.report(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 6 and {r["vec_id"] for r in out if r["deviation"] is None} == {1, 2}
