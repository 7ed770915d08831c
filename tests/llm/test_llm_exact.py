"""The corpus operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from capsight.llm import (chunk_dedup, html_blocks, minhash_forest, nn_descent, packing, quality_knn, suffix_dedup,
                          text as tx)
from capsight.llm.queries import ORACLES, QUERIES
from capsight.llm.suffix_dedup import suffix_array
from oracle_check import compare, duck

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    ok, detail = compare(QUERIES[key](spark, SMALL), duck(SMALL), ORACLES[key], types=True)
    assert ok, detail


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, k, num, den):
    """Smallest reachable doc_id of each (doc_id, text)."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    share = collections.Counter()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            share.update((j, i) for j in holders[g])
            holders[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in share.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def edited(rng, base, edits):
    w = base[:]
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_groups_with_one_large_group(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(160)]
    shared = [rng.choice(vocab) for _ in range(70)]
    rows = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(500)]
    rows += [(500 + i, " ".join(shared + [rng.choice(vocab) for _ in range(70)])) for i in range(300)]
    rows += [(800 + i, edited(rng, rows[500 + 7 * i][1].split(), 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_groups(rows, 3, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_groups(df).collect()}
    assert got == want


def test_near_groups_linked_through_one_document(spark):
    """Thousands of versions of one text, each near to the text and to no other
    version: regions hold more than can be compared at once, and only the last
    document links them. Texts further off stay alone."""
    rng = random.Random(12)
    base = [f"v{i}" for i in range(160)]

    def version(edits):
        w = base[:]
        for at in rng.sample(range(40), edits):
            w[4 * at + 1] = f"z{rng.randrange(10**9)}"
        return " ".join(w)

    rows = [(i, version(4)) for i in range(6000)] + [(6000 + i, version(12)) for i in range(100)] + [(6100, " ".join(base))]
    sets = [shingle_set(t, 3) for _, t in rows]

    def near(x, y):
        return 100 * len(x & y) >= 85 * len(x | y)

    assert all(near(s, sets[-1]) for s in sets[:6000])
    assert not any(near(sets[i], s) for i in range(6000, 6100) for j, s in enumerate(sets) if i != j)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_groups(df).collect()}
    assert got == {i: i if 6000 <= i < 6100 else 0 for i, _ in rows}


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                cover[max(i, end):i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        spans = sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))
        left = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, hot):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(300)]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 80))) for _ in range(12)]
    texts = []
    for _ in range(120):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 3)):
            k, p = rng.randint(0, len(t)), rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t = t[:k] + p[a:a + rng.randint(100, 400)] + t[k:]
        texts.append(t)
    texts += ["a" * 1000, "ab" * 300 + "x", None, "", "é" * 150, "a" * 199, "a" * 200, "q" * 200, texts[3],
              "xyz" * 67, "0123456789" * 25, "zz" + "0123456789" * 25]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup_report(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 200)


def test_suffix_dedup_tells_texts_of_one_hash_apart(spark):
    """Two texts with the same xxhash64 of the text are no copies."""
    p1, p2, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1

    def lane(x):  # the first lane of xxhash64 with Spark's seed after one word
        v = (42 + p1 + p2 + x * p2) & full
        return ((v << 31 | v >> 33) * p1) & full

    rng = random.Random(3)
    fixed = bytes(rng.sample(range(33, 127), 64))
    x, y = (int.from_bytes(fixed[i:i + 8], "little") for i in (0, 32))
    while True:
        other = int.from_bytes(bytes(rng.choices(range(33, 127), k=8)), "little")
        match = (y + (lane(x) - lane(other)) * pow(p2, -1, 1 << 64)) & full
        if not match & 0x8080808080808080:
            break
    second = other.to_bytes(8, "little") + fixed[8:32] + match.to_bytes(8, "little") + fixed[40:]
    df = spark.createDataFrame([(1, fixed.decode()), (2, second.decode())], "doc_id long, text string")
    assert df.selectExpr("xxhash64(text) AS h").distinct().count() == 1
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup_report(df).collect()} == {1: 0, 2: 0}


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def some_pieces(seed):
    rng = random.Random(seed)
    made = [bytes(rng.choices(b"abcd ", k=rng.randint(200, 368))) for _ in range(12)]
    for _ in range(8):
        a, b = rng.choice(made), rng.choice(made)
        cut = rng.randint(150, len(a))
        made.append((a[:cut] + b[-rng.randint(190, 260):])[:368])
    return [*dict.fromkeys(p for p in [*made, b"a" * 300, b"xyz" * 90] if len(p) >= 200)]


def test_repeated_windows_come_from_the_suffix_order(monkeypatch):
    found, lost = 0, 0
    for seed in range(30):
        pieces = some_pieces(seed)
        weight = np.ones(len(pieces), np.int64)
        count = collections.Counter(p[i:i + 200] for p in pieces for i in range(len(p) - 199))
        want = {(k, i) for k, p in enumerate(pieces) for i in range(len(p) - 199) if count[p[i:i + 200]] > 1}
        got = suffix_dedup.repeated_windows(pieces, weight, 200)
        assert {*zip(*(x.tolist() for x in got), strict=True)} == want
        with monkeypatch.context() as m:  # places left as they stand in the text
            m.setattr(suffix_dedup, "suffix_array", lambda s: list(range(len(s))))
            got = suffix_dedup.repeated_windows(pieces, weight, 200)
        found, lost = found + len(want), lost + len(want) - len({*zip(*(x.tolist() for x in got), strict=True)})
    assert lost > found / 2 > 0


def test_windows_of_one_key_are_told_apart_by_their_bytes():
    rng = random.Random(5)
    buf = np.frombuffer((bytes(rng.choices(b"ab", k=300)) * 3 + b"b" * 250) * 2, np.uint8)
    s = np.array(sorted(rng.sample(range(len(buf) - 40), 700)))
    for key in (np.zeros(len(s), np.uint64), (s % 7).astype(np.uint64) * 0 + (buf[s] > 97), np.arange(len(s)) % 5):
        which = suffix_dedup._same_bytes(buf, s, np.asarray(key, np.uint64), 40)
        for i, j in zip(rng.choices(range(len(s)), k=4000), rng.choices(range(len(s)), k=4000), strict=True):
            same = key[i] == key[j] and bytes(buf[s[i]:s[i] + 40]) == bytes(buf[s[j]:s[j] + 40])
            assert (which[i] == which[j]) == same


def test_suffix_query(spark):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").collect()
    got = {r[0]: tuple(r)[1:] for r in entry.queries()["op4_suffix_dedup"](spark, MIDDLE).collect()}
    assert [got[r["doc_id"]] for r in rows] == brute_removed([r["text"] for r in rows], 200)


def brute_chunks(rows):
    """Kept text of each (doc_id, text), doc_ids different."""
    first, pieces = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        at = chunk_dedup.cuts(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        pieces[i] = [(int(s), int(e)) for s, e in zip(at, [*at[1:], len(b)], strict=True)]
        for s, e in pieces[i]:
            first.setdefault(b[s:e], (i, s))
    out = {}
    for i, t in rows:
        b, runs = (t or "").encode(), []
        for s, e in pieces[i]:
            if first[b[s:e]] != (i, s):
                if runs and runs[-1][1] == s:
                    runs[-1][1] = e
                else:
                    runs.append([s, e])
        keep, at = b"", 0
        for s, e in runs:
            if e - s >= chunk_dedup.MIN_RUN:
                keep, at = keep + b[at:s], e
        out[i] = (keep + b[at:]).decode()
    return out


def test_chunk_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    got = {r["doc_id"]: r["text"] for r in entry.queries()["op3_chunk_dedup"](spark, MIDDLE).collect()}
    assert got == brute_chunks(rows)


def test_chunks_find_shifted_passages(spark):
    rng = random.Random(2)

    def some(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))

    passage = some(55)
    rows = [(i, f"{some(rng.randint(5, 60))} {passage} {some(30)}") for i in range(40)] + [(99, some(300))]
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[i]["n_removed"] > 0 for i in range(1, 40))
    assert caught >= 38 and got[0]["n_removed"] == got[99]["n_removed"] == 0
    mean = np.mean([got[i]["n_removed"] for i in range(1, 40)])
    assert 0.6 * len(passage) < mean <= len(passage) + 2


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows |= {10**6: "a<|endoftext|>b", 10**6 + 1: "naïve ☃   text\r\n"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    out = packing.pack(df).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(rows)
    for i, text in rows.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 and {r["window"] for r in s} == {at}
    steps = collections.defaultdict(set)
    for r in out:
        steps[r["step_id"]].add((r["sequence_id"], r["window"]))
    assert all(len({w for _, w in s}) == 1 and sum(w for _, w in s) <= packing.STEP_TOKENS for s in steps.values())


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((2000, 16)), rng.standard_normal(16) + 0.01 * rng.standard_normal((600, 16)),
                        np.repeat(rng.standard_normal((1, 16)), 50, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nn_descent.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s.round(9)))[:20]
        hits += len(set(best) & {v for v, _ in got[q]})
        assert len(got[q]) == 20 and np.allclose([c for _, c in got[q]], s[[v for v, _ in got[q]]], atol=1e-9)
    assert hits >= 0.97 * 20 * len(got) and len(got) == len(range(0, len(x), 20))


def test_nearest_neighbours_with_very_long_and_short_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    x[7] *= 1e9
    x[20] *= 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nn_descent.search(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert len(got) == 75 and all(len(v) == 20 for v in got.values()) and hits >= 0.97 * 1500


def test_nodes_alone_in_their_blocks_are_asked_and_found(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 12))
    lone = [20, 33, 40]
    real = nn_descent._block_job

    def job(batches):
        for b in real(batches):
            rows = b.to_pylist()
            keep = [r for r in rows if r["node"] not in lone]
            for r in keep:  # nor does a block name one as a neighbour
                i, s = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["scores"], np.float32)
                ok = ~np.isin(i, lone)
                r["ids"], r["scores"] = i[ok].tobytes(), s[ok].tobytes()
            yield pa.RecordBatch.from_pylist(keep, schema=b.schema)

    monkeypatch.setattr(nn_descent, "_block_job", job)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nn_descent.search(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits, of_lone = 0, [0, 0]
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:20].tolist())
        hits += len(best & got[q])
        of_lone[0] += len(best & got[q] & set(lone))
        of_lone[1] += len(best & set(lone))
    assert len(got) == 45 and all(len(v) == 20 for v in got.values())
    assert hits >= 0.97 * 900 and of_lone[0] >= 0.8 * of_lone[1] > 0


@pytest.mark.parametrize("key, label, least", [("op8_toxicity_cnn", "toxic", 0.9), ("op10_quality_knn", "quality", 0.97)])
def test_held_out_accuracy(spark, key, label, least):
    out = {r["doc_id"]: r for r in entry.queries()[key](spark, MIDDLE).collect()}
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= (0.7 if label == "toxic" else 0.5))
    labels = [r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    right = [out[r["doc_id"]]["predicted"] == r[label] for r in labels]
    assert np.mean(right) >= least


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies and so on and on and on.</div><script>var x = "</p><article>";</script>
<article><h1>Head&nbsp;line</h1><p>First
   <b>para</b>graph &lt;1&gt; &#x263A;<br>more<p>One.<!-- gone --><aside>Not this</aside><p>Last &amp;amp; end.</article>
<div class="comments"><article><p>A reader writes a long comment about the text that one should not see here.</p></article></div>
<form><label>Mail</label><button>Send</button></form><footer>&copy; us</footer></body></html>"""


def test_html_blocks():
    tree = html_blocks.train_tree(html_blocks._LABELLED)
    assert html_blocks.main_text(PAGE, tree) == "Head line\nFirst paragraph <1> ☺ more\nOne.\nLast &amp; end."
    wrong = [r for r in html_blocks._LABELLED if html_blocks.decide(tree, r[:-1]) != r[-1]]
    assert not wrong
    flat = "<div>" + "words in a row here " * 12 + "</div><ul><li><a href=x>go</a></li></ul><div>" + "and so on then " * 12 + "</div>"
    assert html_blocks.main_text(flat, tree).count("\n") == 1


ARTICLE = "".join(f"<p>{'plain words of the main text in a row ' * 3}{i}</p>" for i in range(4))
WANTED = "\n".join(f"{'plain words of the main text in a row ' * 3}{i}" for i in range(4))


@pytest.mark.parametrize("page", [
    '<div class="content has-sidebar"><article>%s</article></div>',
    '<div id="page" class="right-sidebar hfeed"><main><article>%s</article></main></div>',
    '<form id="aspnetForm" action="x"><article>%s</article></form>',
    '<div class="post comments-closed">%s</div>',
    '<div id="page" class="right-sidebar hfeed"><div id="content">%s</div><div class="widget">a b</div></div>',
    '<div class="comments-open"><main>%s</main></div>',
    '<nav><a href="/">home</a></nav><div class="newsletter-layout">%s</div>',
    '<article>%s</article><div class="related"><article><p>Another page about something else is here.</p></article></div>',
    '<div class="social-wrap"><article>%s<div class="share">Tell your friends</div></article></div>',
    '<article>%s</article><section id="comments" class="comments-area"><ol class="comment-list"><li><article><p>'
    + "A reader says a lot. " * 60 + "</p></article></li></ol></section>",
    '<article>%s</article><div class="comments"><p>' + "A reader says a lot. " * 60 + "</p></div>",
    '<article>%s</article><form><p>Your name and address please</p><button>Send</button></form>',
    '<div class="cookie-notice">We use cookies and so on</div><div class="sidebar">Short words here</div><main>%s</main>'])
def test_names_on_wrappers(page):
    assert html_blocks.main_text(page % ARTICLE, html_blocks.train_tree(html_blocks._LABELLED)) == WANTED


def test_odd_quotes():
    tree = html_blocks.train_tree(html_blocks._LABELLED)
    long = "some plain words that make up a line of the article " * 3

    def text(page):
        return html_blocks.main_text(f"<article><p>{long}</p>{page}", tree).split("\n")[1:]

    assert text('<p title="x>') == []  # the value never ends
    assert text(f'<p title="x>{long}</p><p class="y">{long}z') == [f"{long}z"]  # as a browser: the value ends at y
    assert text(f"<p it's fine>{long}a<p x=\"1\" '>{long}b<p a=b'c>{long}c") == [f"{long}{c}" for c in "abc"]
    assert text(f"<p data-x='a>b' y=\"c>d\">{long}a < b <3 </p title='>'>") == [f"{long}a < b <3"]
    assert text(f"<p>{long}a<p unfinished") == [f"{long}a"]
    assert text(f"<!--><p>{long}a<script>x</script foo><p>{long}b") == [f"{long}a", f"{long}b"]


@pytest.mark.parametrize("piece", ["<p x=\"1\" '", "<p title=\"x>", "<p x='", "<div>", "</p>", "<div></p>", "<a b", "<!--", "<![CDATA[",
                                   "<span class=ad>", "<article><div class=ad>", "< <", "&amp", "<p =", "<script ", "<a href=x>y"])
def test_a_megabyte_of_anything_is_read_in_linear_time(piece):
    import time
    began = time.process_time()
    html_blocks.main_text(piece * (1_000_000 // len(piece)), html_blocks.train_tree(html_blocks._LABELLED))
    assert time.process_time() - began < 5


def test_html_query(spark):
    """The pages hold one article each; its blocks, read another way."""
    import html
    got = {r["page_id"]: r["text"] for r in entry.queries()["op5_html_blocks"](spark, MIDDLE).collect()}
    for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|li|ul|table|tr|td|div)\b[^>]*>", inner.replace("<br>", " "))
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_pipeline_against_brute_force(spark):
    """Every stage recomputed in plain Python from the stage before."""
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality_knn.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {}
    for i, r in rows.items():
        (_, _, buf, off), = tx.slices(pa.array([r["text"]]), 1 << 30)
        f = quality_knn.features(buf, off)
        v = f @ model.basis
        sim = (v / max(np.linalg.norm(v), 1e-9)) @ model.vectors
        near = np.argsort(-sim[0])[:quality_knn.K]
        w = np.maximum(sim[0][near], 0) ** quality_knn.POWER
        if not np.linalg.norm(v) or not w.sum() or (w * model.y[near]).sum() / w.sum() >= 0.5 - 1e-4:
            good[i] = r["text"]
    near = brute_groups(list(good.items()), 5, 80, 100)
    one = {i: t for i, t in good.items() if near[i] == i}
    cut = {i: t for i, t in brute_chunks(list(one.items())).items() if t}
    size = {i: len(words(t)) for i, t in cut.items()}
    source = {i: rows[i]["source"] for i in cut}
    total = collections.Counter()
    for i in cut:
        total[source[i]] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    capped = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(
            weight[s] for s in total if s not in capped)
        over = {s for s in total if s not in capped and weight[s] * level > 2 * total[s]}
        if not over:
            break
        capped |= over
    copies = collections.Counter()
    for i in cut:
        s = source[i]
        rate = 2.0 if s in capped else weight[s] * level / total[s]
        draw = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        copies[i] = int(rate) + (draw < rate - int(rate))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (n, len(tok.encode(cut[i], add_special_tokens=False).ids) + 1) for i, n in copies.items() if n}
    out = pipeline.run(spark, SMALL).collect()
    got = collections.Counter(r["doc_id"] for r in out if r["start"] == 0)
    assert got == {i: n for i, (n, _) in want.items()}
    assert all(r["doc_tokens"] == want[r["doc_id"]][1] for r in out)
    assert sum(r["length"] for r in out) == sum(n * t for n, t in want.values())


@pytest.mark.parametrize("block", [10**6, 7])
def test_components(spark, block):
    from capsight.llm.common import components, merge_components
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)]
    edges += [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(110)]
    more = [(60, 1005), (120, 5000), (6000, 6001)]

    def brute(pairs):
        root = {}
        for a, b in pairs:
            a, b = root.get(a, a), root.get(b, b)
            low = min(a, b)
            root |= {x: low for x in [a, b, *(k for k, r in root.items() if r in (a, b))]}
        return {x: r for x, r in root.items() if x != r}

    def frame(pairs):
        return spark.createDataFrame(pairs, "a long, b long").repartition(5)

    comp = components(frame(edges), block=block)
    assert {r["node"]: r["root"] for r in comp.collect()} == brute(edges)
    assert {r["node"]: r["root"] for r in merge_components(comp, frame(more)).collect()} == brute(edges + more)


def test_toxicity_scores_against_plain_convolution(spark):
    """op8's scores worked out word by word: embeddings of a word and its first
    bytes summed, every filter at every place, maxima, logistic layer."""
    import re

    from capsight.llm import text as tx
    from capsight.llm import toxicity_cnn as cnn

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, "en"), (-2, "", None), (-3, "  \n\t", "de"), (-4, "one", "fr"), (-5, "!!! ??. (x) a.b, 'Tis \"\"", "en"),
           (-6, "ÄÖ é b " + "LONGER words, here! " * 500, "es")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = cnn.fit(docs, labels)

    def bucket(word):
        b = np.frombuffer(word, np.uint8)
        return int(tx.span_hash(b, np.array([0]), np.array([len(b)]))[0])

    def vector(word):
        word = re.sub(rb"[A-Z]", lambda m: m.group().lower(), word)
        for _ in range(4):
            for end in (0, -1):
                if len(word) > 1 and cnn._PUNCT[word[end]]:
                    word = word[1:] if end == 0 else word[:-1]
        v = model.emb[bucket(word) % cnn.BUCKETS].astype(float)
        for k in cnn.PREFIXES:
            if len(word) >= k:
                v = v + model.emb[(bucket(word[:k]) + k) % cnn.BUCKETS]
        return v

    known: dict = {}

    def score(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        for w in set(words) - set(known):
            known[w] = vector(w)
        x = [known[w] for w in words]
        pooled = []
        for w in cnn.WIDTHS:
            best = np.zeros(cnn.FILTERS)
            for i in range(len(x)):
                z = model.bias[w].astype(float)
                for j in range(min(w, len(x) - i)):
                    z = z + x[i + j] @ model.conv[w][j]
                best = np.maximum(best, z)
            pooled.extend(best)
        return 1 / (1 + np.exp(-(np.array(pooled) @ model.out + model.shift)))

    got = {r["doc_id"]: r for r in cnn.classify(docs, labels).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.trained
    for r in rows:
        want, out = score(r["text"]), got[r["doc_id"]]
        assert out["score"] == pytest.approx(want, abs=1e-4), r["doc_id"]
        if abs(want - cnn.TOXIC_AT) > 1e-3:
            assert out["predicted"] == int(want >= cnn.TOXIC_AT)
