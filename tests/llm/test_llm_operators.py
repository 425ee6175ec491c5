"""Operators on small shards, buckets and blocks, and their parts by themselves."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitepulse.llm import bpe, components, decontam, exact, langid, lexical, lines, lm, pretokens, secrets, simhash, tokencount
from sitepulse.llm import toxicity, trie, warc
from sitepulse.llm.queries import BPE_FILE
from sitepulse.llm.storage import Scratch


def docs(spark, tables):
    return spark.read.parquet(f"{tables['dir']}/documents.parquet")


def key(row):
    return tuple((x is None, str(x)) for x in row)


# exact dedup


@pytest.mark.parametrize("bucket_keys,max_depth", [(1, 3), (4, 6), (1000, 16)])
def test_exact_small_buckets(spark, edge, bucket_keys, max_depth):
    got = exact.exact_groups(docs(spark, edge), bucket_keys=bucket_keys, max_depth=max_depth).drop("bucket").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.op1(edge), key=key)


def test_directory_covers_all_addresses_and_splits_overfull_buckets(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("h"))
    rows = exact.directory(keys, bucket_keys=20, max_depth=8).orderBy("lo").collect()
    assert [r.lo for r in rows[1:]] == [r.hi for r in rows[:-1]] and rows[0].lo == 0 and rows[-1].hi == 256
    assert sum(r["keys"] for r in rows) == 500
    assert all(r["keys"] <= 20 and r.hi - r.lo == 1 << (8 - r.depth) for r in rows)
    assert exact.directory(keys.limit(0)).count() == 0
    one = exact.directory(keys, bucket_keys=500).collect()
    assert [(r.depth, r.lo, r.hi) for r in one] == [(0, 0, 65536)]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_hot_chains_are_reduced_before_they_travel(spark, edge, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(exact, "HOT_ROWS", 3)
    monkeypatch.setattr(exact, "HOT_SHARE", 10**6)
    monkeypatch.setattr(exact, "BROADCAST_BYTES", broadcast_bytes)
    got = exact.exact_groups(docs(spark, edge)).drop("bucket").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.op1(edge), key=key)
    kept = [r.text or "" for r in exact.keep_one(docs(spark, edge)).collect()]
    assert sorted(kept) == sorted({x or "" for _, x in edge["documents"]})


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_chains_are_told_apart_by_their_bytes(spark, edge, monkeypatch, hot_rows):
    """All texts share three hash values."""
    monkeypatch.setattr(exact, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(exact.F, "xxhash64", lambda c: F.length(F.col(c)).cast("long") % 3 - 1)
    got = exact.exact_groups(docs(spark, edge)).drop("bucket").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.op1(edge), key=key)
    kept = exact.keep_one(docs(spark, edge)).collect()
    assert sorted(r.text or "" for r in kept) == sorted({x or "" for _, x in edge["documents"]})
    want = {r[1] for r in brute.op1(edge)}
    assert {r.doc_id for r in kept} == want


def test_exact_is_native(spark, edge):
    plan = exact.exact_groups(docs(spark, edge))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keep_one(spark, edge):
    d = docs(spark, edge)
    got = exact.keep_one(d)
    assert got.columns == d.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({x or "" for _, x in edge["documents"]})


# simhash


@pytest.mark.parametrize("group", [1, 2, 64])
def test_simhash_crowded_keys(spark, edge, group):
    got = simhash.near_groups(docs(spark, edge), group=group).collect()
    assert sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got), key=key) == sorted(brute.op2(edge), key=key)


@pytest.mark.parametrize("group", [2, 64])
def test_links_lose_nothing(spark, tmp_path, group):
    rnd = random.Random(1)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    fps = {0, 2**64 - 1, 1, 3, 7}
    for s in seeds:  # crowds that share most bits
        for _ in range(60):
            x = s
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.choice(range(0, 64, 5))
            fps.add(x)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    scratch = Scratch(spark, "test")
    got = components.components(simhash.links(nodes, scratch, group=group), scratch).collect()
    root = {r.u: r.v for r in got}
    want = brute.groups({s for (s,) in signed}, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    by = {}
    for (s,) in signed:
        by.setdefault(want[s], set()).add(root.get(s, s))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({root.get(s, s) for (s,) in signed})


def test_pivot_difference_is_a_lower_bound():
    rnd = random.Random(2)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for _ in range(rnd.randint(0, 9)):
            b ^= 1 << rnd.randrange(64)
        apart = max(abs((a ^ p % 2**64).bit_count() - (b ^ p % 2**64).bit_count()) for p in map(simhash._pivot, range(simhash.PIVOTS)))
        assert apart <= (a ^ b).bit_count()


def test_keep_first(spark, edge):
    d = docs(spark, edge)
    got = simhash.keep_first(d)
    assert got.columns == d.columns
    fps = [(i, brute.fingerprint(x)) for i, x in edge["documents"]]
    root = brute.groups({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        least.setdefault(root[f], []).append(i)
    want = [min([i for i in ids if i is not None], default=None) for ids in least.values()]
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(want, key=str)


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    loops = path.unionByName(path).unionByName(spark.range(3).select(F.col("id").alias("u"), F.col("id").alias("v")))
    got = components.components(loops, Scratch(spark, "test")).collect()
    assert {(r.u, r.v) for r in got} == {(i, 0) for i in range(1, 301)}
    assert components.components(path.limit(0), Scratch(spark, "test")).count() == 0


# WARC


@pytest.mark.parametrize("file_records", [1, 3, 1000])
def test_histories_are_globally_ordered(spark, edge, file_records):
    pages = spark.read.parquet(f"{edge['dir']}/pages.parquet")
    path = f"{Scratch(spark, 'test').path}/archives"
    warc.write_archives(warc.records(pages), path, file_records)
    runs = warc.index_runs(spark, path)
    got = [tuple(r) for r in warc.merged_index(runs, runs.count(), merge_rows=10).collect()]
    assert got == sorted(got, key=warc.order) and len(got) == len(edge["pages"])
    assert len({r[0] for r in got}) >= len(got) // file_records / 2


def test_a_long_page_leaves_the_other_files_alone(spark, edge, monkeypatch):
    """Files are cut by the length of common pages; the long ones go beside them."""
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "HEAD_BYTES", 400)
    pages = spark.read.parquet(f"{edge['dir']}/pages.parquet").coalesce(1)
    want = sorted(brute.op3(edge), key=key)
    n_files = {}
    for limit in (1 << 20, 5000):
        monkeypatch.setattr(warc, "LONG_PAGE", limit)
        got = warc.capture_histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "run").collect()
        assert sorted((tuple(r)[:5] for r in got), key=key) == want
        n_files[limit] = len({r.run for r in got})
    assert n_files[5000] < 12 and n_files[1 << 20] > 60


def test_rows_equal_in_url_time_and_page_spread(spark):
    """A third of all rows repeated: run and offset split them over ranges, each still in order."""
    rows = [(1, "http://a.example/", "x")] * 300 + [(i, f"http://h{i}.example/", "y") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = warc.capture_histories(pages)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert got.count() == 900 and max(r["count"] for r in sizes) < 300


def test_damaged_archives_are_told():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[3] for x in warc.parse(good * 2)] == [b"abc", b"abc"]
    for bad in (good[:-1], good + b"x", good.replace(b"3", b"2")):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_url_keys():
    assert warc.url_key("http://www.A.example.com:80/X?q=1#f") == "com,example,a)/x?q=1"
    assert warc.url_key("https://u:p@b.org:8443") == "org,b:8443)/"
    assert warc.url_key("") == ")/"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs])) == sorted(x for r in runs for x in r)


# secrets


def test_checksums_decide():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = body + secrets.crc_suffix(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc-_1"
    text = f"ghp_{good} ghp_{bad} npm_{good} é {jwt} eyJhbGciOiJ.eyJx.z"
    found = secrets.scan(text, secrets.automaton())
    assert [(text[a:b], k) for a, b, k in found] == [(f"ghp_{good}", "github"), (f"npm_{good}", "npm"), (jwt, "jwt")]


JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="eyJ.a-é ", max_size=60), st.sampled_from(["", "eyJa.eyJb.c", "eyJeyJa.eyJ.eyJb.eyJc."]))
def test_tokens_equal_the_pattern(text, head):
    text = head + text + head
    mine = secrets._Jwt()
    for at in range(len(text)):
        a, b = mine.match(text, at), JWT.match(text, at)
        assert (a and [a[i] for i in range(4)] + [a.end()]) == (b and [b[i] for i in range(4)] + [b.end()])


def test_hostile_texts_take_linear_time():
    keywords = secrets.automaton()
    nested = base64.urlsafe_b64encode(b'{"alg":' * 100_000).decode().rstrip("=")
    deep = f"{nested}.{nested}.x"
    for text in (deep, "eyJ" * 350_000, ("eyJ" * 300_000) + ".eyJ" + "eyJ" * 50_000 + ".", "eyJa." * 200_000, "token=" * 170_000):
        began = time.perf_counter()
        assert [k for _, _, k in secrets.scan(text, keywords) if k == "jwt"] == []
        assert time.perf_counter() - began < 2


def test_base58_checksum():
    raw = bytes.fromhex("0488ADE4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, good = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        good = secrets._BASE58[r] + good
    bad = good[:-1] + ("1" if good[-1] != "1" else "2")
    text = f"{bad} {good} {good}1 xprv"
    assert [(a, b, k) for a, b, k in secrets.scan(text, secrets.automaton()) if k == "xprv"] == [(112, 223, "xprv")]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aAfF09ptokenOKENsecr =:'\"AKIZpi_ykwKſé-", max_size=80), st.sampled_from(["", "token=", "AKIA", "secret: '", "0" * 15]))
def test_scan_equals_plain_search(text, head):
    text = text + head + text
    got = [(a, secrets.KINDS.index(k), b) for a, b, k in secrets.scan(text, secrets.automaton()) if k in ("assign", "access", "hex")]
    assert got == brute.base_spans(text)


def test_redact(spark):
    d = spark.createDataFrame([(1, "x token=abcdefghijklmnop y"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r.text for r in secrets.redact(d).orderBy("doc_id").collect()] == ["x [secret] y", None, "clean"]


# language model


def test_lm_small_blocks_and_shards(spark, small):
    d = docs(spark, small)
    cols = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    a = {r.doc_id: r for r in lm.score_documents(d).select(*cols).collect()}
    b = {r.doc_id: r for r in lm.score_documents(d.repartition(5), block_tokens=700, shard_hashes=900).select(*cols).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][:4] == b[i][:4] and a[i][4:] == pytest.approx(b[i][4:], rel=1e-9)


def test_lm_asks_that_climb_in_steps(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cols = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    a = {r.doc_id: r for r in lm.score_documents(d).select(*cols).collect()}
    total = sum(r.n_tokens for r in a.values())
    cut = {"block_tokens": total // 12, "shard_hashes": total // 8}
    assert lm.steps(3, 1) == [1, 2, 3]
    b = {r.doc_id: r for r in lm.score_documents(d, **cut, fan_bits=1).select(*cols).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][:4] == b[i][:4] and a[i][4:] == pytest.approx(b[i][4:], rel=1e-9)


def test_lm_rows_of_the_exchange_follow_the_tokens():
    for shard_bits in range(0, 30):
        cuts = lm.steps(shard_bits)
        assert cuts[-1] == shard_bits and max(np.diff([0, *cuts])) <= lm.FAN_BITS
        assert len(cuts) == max(1, -(-shard_bits // lm.FAN_BITS))
    # a group of fewer bits joins whole groups of more bits
    for block in (0, 1, 5 << 32, (7 << 32) + 3):
        assert lm.group_of(block, 5) == lm.group_of(block, 9) & 31 and lm.group_of(block, 0) == 0


def test_lm_beats_unigrams_on_held_out_rows(spark):
    got = [r for r in lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.9


def test_packing():
    a = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm._unpack_sorted(lm._pack_sorted(a)) == a).all()
    assert len(lm._unpack_sorted(lm._pack_sorted(a[:0]))) == 0


def test_em_finds_the_better_source():
    level = int(lm._level(np.array([0.5]))[0])
    low = int(lm._level(np.array([0.001]))[0])
    pair = (3 * lm._LEVELS + level) * lm._LEVELS + low
    word = (4 * lm._LEVELS + low) * lm._LEVELS + level
    w = lm.fit_weights(np.array([pair, word]), np.array([100.0, 100.0]), 1000)
    assert w[3, 0] > 0.9 and w[4, 1] > 0.9 and w[0, 0] == 0 and np.allclose(w.sum(axis=1), 1)


# decontamination


@pytest.mark.parametrize("block_words,piece_words", [(200_000, 4096), (20, 4096)])
def test_contamination_blocks(spark, edge, block_words, piece_words):
    bench = spark.read.parquet(f"{edge['dir']}/benchmark.parquet")
    got = decontam.contamination(docs(spark, edge), bench, block_words=block_words).collect()
    want = brute.op6(edge)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for r in got), key=key) == sorted(want, key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
def test_automaton_equals_brute_force(items, doc, window):
    sam = decontam.SuffixAutomaton(window).build([(str(i), [w.encode() for w in it], True) for i, it in enumerate(items)])
    spans, found = sam.spans([w.encode() for w in doc])
    hit, names = set(), set()
    for i, it in enumerate(items):
        n = min(window, len(it))
        for a in range(len(it) - n + 1) if n else ():
            for b in range(len(doc) - n + 1):
                if doc[b : b + n] == it[a : a + n]:
                    hit.update(range(b, b + n))
                    names.add(str(i))
    assert {x for lo, hi in spans for x in range(lo, hi)} == hit and found == names
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_long_items_in_pieces(spark):
    words = [f"w{i}" for i in range(57)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    scratch = Scratch(spark, "test")
    (blob,) = list(decontam.automata(bench, scratch, piece_words=8)[1])
    sam, ids = decontam._load(blob)
    spans, pieces = sam.spans([w.encode() for w in words])
    assert spans == [(0, 57)] and {i for p in pieces for i in ids[p]} == {"1"}


def test_copies_of_one_item_are_one_piece(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(i, item) for i in range(500)] + [(None, item)], "item_id long, text string")
    names, blobs = decontam.automata(bench, Scratch(spark, "test"), block_words=700)
    assert len(names) == 1
    sam, ids = decontam._load(next(blobs))
    assert [len(x) for x in ids] == [500] and len(sam.length) < 100


@pytest.mark.parametrize("max_span, max_coverage", [(0, 0.3), (12, 0.3), (0, 0.9), (12, 0.9)])
def test_limits_hold_for_all_blocks_together(spark, edge, max_span, max_coverage):
    """Passages of several items in one document: one automaton and many give one result."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(14)) for w in ("one", "two", "three"))
    plain = " ".join(f"p{i}" for i in range(60))
    split = a.split()
    rows = [(1, f"{plain} {a} {plain}"), (2, f"{plain} {a} x {b}"), (3, f"{a} {b} {c} {plain}"), (4, plain), (5, None), (6, "")]
    rows += [(7, f"{plain} {' '.join(split[:7])} {b} {' '.join(split[7:])} {plain}"), (8, a), (8, a)]
    d = spark.createDataFrame(rows, "__r long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate((a, b, c))], "item_id long, text string")
    limits = {"max_span": max_span, "max_coverage": max_coverage}
    one, many = (
        sorted((tuple(r) for r in decontam.decontaminate(d, bench, block_words=n, **limits).collect()), key=key) for n in (10**9, 5)
    )
    assert one == many and {r[0] for r in one} >= {4, 5, 6}
    if max_coverage == 0.3:
        assert {1, 7} <= {r[0] for r in one} and not {2, 3, 8} & {r[0] for r in one}


@pytest.mark.parametrize("block_words", [200_000, 10])
def test_items_without_an_id_hit(spark, block_words):
    # as the registered SQL: count(DISTINCT item_id) and string_agg pass over nulls, the words count
    item, other = (" ".join(f"{w}{i}" for i in range(12)) for w in ("bench", "other"))
    rows = [(1, f"x {item} y"), (2, "the short one here"), (3, f"clean {item[:20]}"), (4, f"{other} z"), (5, None)]
    items = [(None, item), (None, "short one"), (7, other), (None, other), (None, None)]
    d, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(d, bench, block_words=block_words).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == {1: (12, []), 2: (2, []), 3: (0, []), 4: (12, ["7"]), 5: (0, [])}
    assert sorted(r.doc_id for r in decontam.decontaminate(d, bench, block_words=block_words).collect()) == [3, 5]


def test_decontaminate(spark, edge):
    d, bench = docs(spark, edge), spark.read.parquet(f"{edge['dir']}/benchmark.parquet")
    dirty = [r[0] for r in brute.op6(edge) if r[5]]
    got = decontam.decontaminate(d, bench)
    assert got.columns == d.columns
    blocks = decontam.decontaminate(d, bench, block_words=20)
    assert sorted(r.text or "" for r in blocks.collect()) == sorted(r.text or "" for r in got.collect())
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((i for i, _ in edge["documents"] if i not in dirty), key=str)
    cut = decontam.decontaminate(d, bench, max_coverage=0.9).collect()
    again = decontam.contamination(decontam.decontaminate(d, bench, max_coverage=0.9), bench).filter("n_hit > 0").count()
    assert again == 0 and 13 in {r.doc_id for r in cut}
    text = next(r.text for r in cut if r.doc_id == 13)
    assert text.startswith("before ") and "bench" not in text and "after" in text


# toxicity


def test_machine_learns_pairs_that_linear_weights_miss():
    rnd = random.Random(3)

    def text():
        ws = [rnd.choice("alpha beta gamma delta epsi zeta etaa theta iota kapp".split()) for _ in range(12)]
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        ws += ["qqinsult"] * a + ["zzgroup"] * b
        return " ".join(ws), float(a == b)

    rows = [text() for _ in range(2000)]
    x, y = [toxicity.terms(t) for t, _ in rows], np.array([v for _, v in rows])
    model = toxicity.fit_calibrated(x[:1600], y[:1600])
    assert ((model.scores(x[1600:]) >= 0.5) == y[1600:]).mean() > 0.95


def test_terms_of_few_toxic_rows_get_weights():
    rnd = random.Random(4)
    clean = [" ".join(rnd.choice("alpha beta gamma delta epsi zeta".split()) for _ in range(6)) for _ in range(8000)]
    x = [toxicity.terms(t) for t in clean + [f"{t} qqinsult" for t in clean[:16]]]
    y = np.array([0.0] * 8000 + [1.0] * 16)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in x]))).astype(np.int64)
    model = toxicity.fit(np.concatenate(x), starts, y, epochs=2)
    scores = model.scores(x)
    assert model.w[toxicity.terms("qqinsult")].min() > 0
    assert scores[8000:].min() > scores[:8000].max()


def test_sample_keeps_the_rarer_class(spark):
    assert toxicity.places(10, 5, 100) == (10, 5) and toxicity.places(90, 30, 40) == (20, 20)
    assert toxicity.places(1000, 7, 40) == (33, 7) and toxicity.places(7, 1000, 40) == (7, 33)
    rows = spark.range(400).selectExpr("id doc_id", "'some text' text", "cast(id % 50 = 0 as int) y")
    _, starts, y, stand = toxicity.labelled_terms(rows.drop("y"), rows.drop("text"), 40)
    assert len(starts) == 41 and y.sum() == 8 and stand == (392 / 32, 1.0)


def test_calibration_makes_up_for_the_sample():
    rnd = random.Random(6)

    def text(toxic):
        mark = "qqinsult" if rnd.random() < (0.7 if toxic else 0.1) else "zzgroup"
        return toxicity.terms(" ".join([mark] + rnd.choices("alpha beta gamma delta".split(), k=5)))

    y = np.array([0.0, 1.0] * 600)
    x = [text(v) for v in y]
    even, rare = (toxicity.fit_calibrated(x, y, stand) for stand in ((1.0, 1.0), (20.0, 1.0)))
    both = [toxicity.terms("qqinsult alpha")]
    assert even.scores(both)[0] > 0.75 and rare.scores(both)[0] < 0.5


def test_toxicity_equals_brute_force(spark, small):
    """The query against plain loops: the labelled rows, the terms, and every pair of a text's terms."""
    import zlib

    def terms(text):
        ws = {w.encode() for w in brute.terms(text)}
        return sorted({zlib.crc32(w) % toxicity.BUCKETS for w in ws} | {zlib.crc32(w[:n], n) % toxicity.BUCKETS for w in ws for n in toxicity.STEMS if len(w) > n})

    texts = dict(small["documents"])
    known = {d: y for d, _, y in small["labels"] if d is not None and y is not None and d in texts and brute.crc(d) % 5}
    rows = sorted((float(y), np.array(terms(texts[d]), dtype=np.int32).tobytes()) for d, y in known.items())
    model = toxicity.fit_calibrated([np.frombuffer(b, dtype=np.int32) for _, b in rows], np.array([y for y, _ in rows]), least_rows=2)

    def score(text):
        at = terms(text)
        z = model.w0 + sum(model.w[i] for i in at)
        z += sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(at) for b in at[:k])
        return 1 / (1 + math.exp(-(model.scale * z + model.shift)))

    d = spark.read.parquet(f"{small['dir']}/documents.parquet")
    got = toxicity.score_toxicity(d, spark.read.parquet(f"{small['dir']}/labels.parquet"), least_rows=2).collect()
    short = [r for r in got if len(texts[r.doc_id] or "") < 3000]
    assert len(short) > 100 and len(got) == len(texts)
    for r in short:
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-4)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (brute.crc(r.doc_id) % 5 == 0)


def test_the_labelled_sample_is_bounded_in_rows(spark):
    """One id repeated many times is one row of the sample."""
    rows = spark.createDataFrame([(1, f"word{i}") for i in range(3000)] + [(i, f"text {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, y int")
    _, starts, y, _ = toxicity.labelled_terms(rows, labels, 50)
    assert len(y) <= 50 and len(starts) == len(y) + 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    hits = [r for r in rows if r.predicted]
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert sum(r.toxic for r in hits) / len(hits) > 0.9


# line dedup


@pytest.mark.parametrize("keys_per_shard", [4, 1 << 18])
def test_lines_in_small_shards(spark, edge, keys_per_shard):
    got = lines.drop_common_lines(docs(spark, edge).repartition(5), keys_per_shard=keys_per_shard).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept_text)) for r in got), key=key) == sorted(brute.op8(edge), key=key)


@pytest.mark.parametrize("hot_docs", [1, 30, 10**9])
def test_drops_do_not_depend_on_the_hot_list(spark, edge, hot_docs):
    """With the list off every drop is decided by the perfect hash; shards follow the pairs."""
    got = lines.drop_common_lines(docs(spark, edge), hot_docs=hot_docs, pairs_per_shard=9)
    rows = [(r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept_text)) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(brute.op8(edge), key=key)
    assert sum(r[2] for r in rows) > 50


def test_perfect_hash_is_minimal_and_rejects():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for part in (keys, keys[:1], keys[:0]):
        mph, arrays = lines.PerfectHash.load(lines.PerfectHash(part).dump(x=np.arange(3)))
        assert sorted(mph.index(part)) == list(range(len(part))) and list(arrays["x"]) == [0, 1, 2]
        assert (mph.index(keys) < max(1, len(part))).all()


def test_keys_equal_in_the_first_half_are_told_apart():
    import pyarrow as pa

    table = pa.table({"k": [5, 5, 9], "f": [1, 2, 3], "docs": [20, 3, 30], "shard": [0, 0, 0]})
    mph, arrays = lines.PerfectHash.load(lines._build(table)["blob"][0].as_py())
    batch = pa.RecordBatch.from_pydict(
        {"shard": pa.array([0] * 5, pa.int64()), "doc_id": [0, 1, 2, 3, 4], "t": [0] * 5, "line": [-1, 0, 1, 2, 3],
         "k": pa.array([None, 5, 5, 9, 9], pa.int64()), "f": pa.array([None, 1, 2, 3, 4], pa.int64()),
         "blob": pa.array([lines._build(table)["blob"][0].as_py()] + [None] * 4, pa.binary())}
    )
    out = [i for b in lines._probe(10)(iter([batch])) for i in b.column("doc_id").to_pylist()]
    assert out == [1, 3]


# language identification


def test_language_held_out(spark):
    import public_tokenizers

    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(d, public_tokenizers.path(BPE_FILE)).filter("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_forward_sums_all_segmentations():
    pieces = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3}
    prob = np.array([[0.4, 0.1], [0.3, 0.2], [0.2, 0.3], [0.1, 0.4]])

    def total(w, k):
        return 1.0 if not w else sum(prob[i, k] * total(w[len(p) :], k) for p, i in pieces.items() if w.startswith(p))

    words = [b"a", b"abab", b"abaaba", b"bb"]
    lattice = langid.Lattice(words, langid.Trie(list(pieces)))
    assert np.allclose(np.exp(lattice.log_prob(prob)), [[total(w, k) for k in (0, 1)] for w in words])
    counts = np.array([[1.0, 0], [2, 1], [0, 3], [1, 1]])
    used = lattice.expected(prob, counts)
    assert np.allclose((used * np.array([1, 1, 2, 3])[:, None]).sum(axis=0), (counts * np.array([1, 4, 6, 2])[:, None]).sum(axis=0))


def test_memory_does_not_change_predictions(monkeypatch):
    counts = [("x", b"aa", 5), ("x", b"ab", 3), ("y", b"bb", 5), ("y", b"ba", 2)]
    model = langid.fit(counts, [b"a", b"b", b"aa", b"bb", b" ", b" a", b" b"])
    texts = ["aa ab", "bb ba bb", None, "", "12", "ab ba aa", "é" * 100] * 3
    before = model.predict(texts)
    monkeypatch.setattr(langid, "MEMORY", 3)
    fresh = langid.Model(model.langs, model.pieces, model.prob)
    assert [a for a, _ in fresh.predict(texts)] == [a for a, _ in before]
    assert [a for a, _ in before[:5]] == ["x", "y", "und", "und", "und"]


def test_long_words_are_scored_whole():
    """Against a plain recursion over the whole word, above 32 and above 200 bytes, in mixed scripts and any portion."""
    rnd = random.Random(8)
    pieces = langid.with_bytes([b"ab", b"aba", "中".encode(), "中文".encode(), " 中文字".encode(), b"b" * 40, "é".encode()])
    prob = np.random.default_rng(1).random((len(pieces), 3)) ** 4 + 1e-6
    prob /= prob.sum(axis=0)
    trie, log = langid.Trie(pieces), np.log(prob)
    of = {p: i for i, p in enumerate(pieces)}

    def plain(word):
        a = [np.zeros(3)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            x = [a[s] + log[of[word[s:e]]] for s in range(max(0, e - 40), e) if word[s:e] in of]
            a[e] = np.logaddexp.reduce(x, axis=0)
        return a[-1]

    words = ["".join(rnd.choice("ab中文字é") for _ in range(n)).encode() for n in (1, 9, 31, 33, 70, 230, 900)] + [b"b" * 300]
    model = langid.Model(["x", "y", "z"], pieces, prob)
    model.learn_words(set(words))
    for w in words:
        assert np.allclose(model.known[model.memory[w]], plain(b" " + w), rtol=1e-9)
    for portion in (7, 64, 4096):
        assert np.allclose(langid.long_log_prob(words, trie, log, portion), [plain(w) for w in words], rtol=1e-9)


def test_long_and_short_words_are_fitted_alike():
    pieces = langid.with_bytes([b"ab", b"ba", b"aba", b" a"])
    prob = np.random.default_rng(2).random((len(pieces), 2)) + 0.1
    prob /= prob.sum(axis=0)
    words = [b" abab", b" ba", b"abaabaab"]
    counts = np.array([[1.0, 2], [3, 1], [1, 1]])
    lattice = langid.Lattice(words, langid.Trie(pieces))
    assert np.allclose(lattice.log_expected(np.log(prob), counts), lattice.expected(prob, counts))


def test_identify_equals_brute_force(spark, tmp_path):
    """The whole query on a small vocabulary: every segmentation enumerated, the fit included."""
    own = [b"a", b"b", b"ab", b" a", b"ba", "é".encode()]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(own)))
    texts = {"x": ["ab ab aab", "a ab é"], "y": ["ba bb", "bba b! Ba"]}
    rows = [(i * 7 + j, t, a) for i, (a, ts) in enumerate(texts.items()) for j, t in enumerate(ts * 3)]
    rows += [(1000, "ab", None), (1001, "bb ba", None), (1002, "12 -", None), (1003, None, "x"), (1004, "ab" * 20 + " b", None)]
    pieces = own + [bytes([b]) for b in range(256) if bytes([b]) not in own]
    of = {p: i for i, p in enumerate(pieces)}

    def ways(w):
        return [[]] if not w else [[of[w[:n]], *r] for n in range(1, min(2, len(w)) + 1) if w[:n] in of for r in ways(w[n:])]

    train = [r for r in rows if r[2] and r[1] and brute.crc(r[0]) % 5]
    prob = np.ones((len(pieces), 2)) / len(pieces)
    base = np.array([[0.5 if len(p) == 1 else 0.01] * 2 for p in pieces])
    for _ in range(4):
        used = base.copy()
        for _, text, a in train:
            k = "xy".index(a)
            for w in brute.terms(text):
                cuts = ways(b" " + w.encode())
                weight = np.array([prob[c, k].prod() for c in cuts])
                for c, v in zip(cuts, weight / weight.sum()):
                    np.add.at(used[:, k], c, v)
        prob = used / used.sum(axis=0)

    def score(text):
        logs = np.zeros(2)
        for w in brute.terms(text):
            a = [np.zeros(2)]
            raw = b" " + w.encode()
            for e in range(1, len(raw) + 1):
                a.append(np.logaddexp.reduce([a[s] + np.log(prob[of[raw[s:e]]]) for s in (e - 1, e - 2) if s >= 0 and raw[s:e] in of], axis=0))
            logs += a[-1]
        return "xy"[logs.argmax()], 1 / np.exp(logs - logs.max()).sum()

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(d, str(path)).collect()}
    for i, text, _ in rows:
        lang, value = score(text) if text and any(map(str.isalpha, text)) else ("und", 0.0)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(value, rel=1e-6)
        assert got[i].held_out == (brute.crc(i) % 5 == 0)


def test_the_fits_rows_are_bounded(spark, monkeypatch):
    """One id and one text repeated, a dirty language column: at most ``sample`` rows are counted."""
    import public_tokenizers

    counted = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda counts, pieces, **kw: counted.extend(counts) or fit(counts, pieces, **kw))
    rows = [(1, "the same text", "en")] * 900 + [(1, f"one id {i}", "en") for i in range(900)] + [(i, f"w{i}", f"l{i}") for i in range(2, 300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d, public_tokenizers.path(BPE_FILE), sample=40, max_langs=8)
    assert len(model.langs) == 8 and sum(n for _, w, n in counted if w in (b"id", b"same")) <= 5
    assert max(Counter(a for a, _, _ in counted).values()) <= 3 * 5


def test_keep_identified(spark, edge):
    import public_tokenizers

    d = docs(spark, edge)
    got = langid.keep_identified(d, public_tokenizers.path(BPE_FILE))
    assert got.columns == d.columns
    want = [i for i, x in edge["documents"] if x and any(c.isalpha() for c in x)]
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(want, key=str)


def test_keep_identified_without_languages(spark, edge):
    import public_tokenizers

    path = public_tokenizers.path(BPE_FILE)
    d = docs(spark, edge).withColumn("lang", F.lit(None).cast("string"))
    want = [i for i, x in edge["documents"] if x and any(c.isalpha() for c in x)]
    assert sorted((r.doc_id for r in langid.keep_identified(d, path).collect()), key=str) == sorted(want, key=str)
    for kw in ({"wanted": {"en"}}, {"least_score": 0.5}):
        with pytest.raises(ValueError):
            langid.keep_identified(d, path, **kw)


# byte-level BPE


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path(BPE_FILE))
    return bpe.load(bpe.tokenizer_json(ranks, P.PATTERN))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_tiktoken(coder, text):
    encoder, pieces = coder
    ids = next(encoder([text]))
    assert (0, len(ids), brute.sha(",".join(map(str, ids)))) == brute.op10({"documents": [(0, text)]})[0][:3]
    assert bpe.decode_ids(pieces, ids) == text.encode()
    spans = bpe.offsets(pieces, ids)
    assert all(0 <= a < b <= len(text) for a, b in spans) and (not text or spans[-1][1] == len(text))


def test_portions_keep_tokens(coder):
    encoder, _ = coder
    text = "ab  cd é " * 400 + "\n x" * 100 + "y" * 500
    whole = next(encoder([text]))
    for size in (1, 7, 100):
        parts = bpe.portions(text, size)
        assert "".join(parts) == text and len(parts) > 3
        assert [i for p in parts for i in next(encoder([p]))] == whole


def test_split_characters(coder):
    encoder, pieces = coder
    text = "👩‍👩‍👧 ꙮ 𐍈 é"
    ids = next(encoder([text]))
    stream = bpe.StreamDecoder(pieces)
    assert "".join(stream.feed([i]) for i in ids) + stream.feed([], True) == text
    assert any(len(bpe.decode_ids(pieces, [i])) < len(c.encode()) for i, c in zip(ids, text))


def test_encode_then_decode(spark, edge, coder):
    import public_tokenizers as P

    d = docs(spark, edge)
    plain = bpe.encode(d, P.path(BPE_FILE), P.PATTERN)
    assert sorted(plain.columns) == sorted(set(d.columns) - {"text"} | {"ids"})  # ``ids`` replaced, ``__text`` kept
    twice = bpe.decode(plain.withColumn("decoded", F.lit(1)), P.path(BPE_FILE), P.PATTERN)
    assert twice.columns.count("decoded") == 1 and twice.schema["decoded"].dataType.simpleString() == "binary"
    coded = bpe.encode(d.drop("ids"), P.path(BPE_FILE), P.PATTERN, with_offsets=True)
    assert set(coded.columns) == set(d.columns) - {"text"} | {"offsets"}
    back = bpe.decode(coded, P.path(BPE_FILE), P.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(x or "" for _, x in edge["documents"])
    assert all(len(r.offsets) == 2 * len(r.ids) for r in back)




# -------------------------------------------------------------- token counts


def test_counts_do_not_depend_on_the_table(spark, edge):
    import public_tokenizers as P

    path = P.path("word_bpe_49k.json")
    want = sorted(brute.op11(edge), key=key)
    for sample, entries in ((1, 1), (10**9, 3), (10**9, 10**6)):
        got = tokencount.count_tokens(docs(spark, edge), path, sample=sample, entries=entries).collect()
        assert sorted((tuple(r) for r in got), key=key) == want


def test_length_table():
    words = {f"w{i}": i % 9 + 1 for i in range(5000)} | {"é": 2, "": 1}
    table = tokencount.LengthTable(words)
    assert all(table.get(w) == n for w, n in words.items())
    assert table.get("w5000") is None and tokencount.LengthTable({}).get("x") is None
    assert len(table.slots) >= 2 * len(words)


def test_memo_starts_over():
    asked = []
    memo = pretokens.Memo(lambda ws: asked.append(len(ws)) or [len(w) for w in ws], limit=5)
    assert list(memo.answer([["a", "bb", "a"], ["cc"]])) == [[1, 2, 1], [2]]
    assert list(memo.answer([["dd", "ee", "f", "a", "y" * 100]])) == [[2, 2, 1, 1, 100]]
    assert asked == [3, 5] and "y" * 100 not in memo


def test_settled_characters_have_the_librarys_classes():
    import public_tokenizers as P
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    library = Split(Regex(P.PATTERN), "isolated")
    inside = regex.compile(f"[{pretokens.SETTLED}]")
    chars = [c for c in map(chr, range(0xD800)) if inside.match(c)]
    assert len(chars) > 30_000
    find = regex.compile(P.PATTERN).findall
    for c in chars:
        text = f"a{c}1 {c}  {c}{c}"
        assert find(text) == [w for w, _ in library.pre_tokenize_str(text)], hex(ord(c))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBéÉ́İΣς \n\x1c\x85 'sSlL1٣中<|endoftext>😀‍֊꟎ſK한", max_size=40))
def test_counts_equal_the_library(text):
    counts, _ = tokencount.load(word_tokenizer())
    n, words = counts.parts(text)
    assert n + sum(counts.lengths(words)) == brute.op11({"documents": [(0, text)]})[0][2]


def word_tokenizer() -> str:
    import public_tokenizers as P

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


# ------------------------------------------------------------ lexical search


@pytest.mark.parametrize("rows, window, short, blocks", [(7, 3, 2, 10), (50, 16, 10**9, 10**6), (10**6, 8, 1, 10**6)])
def test_search_in_small_rows(spark, edge, monkeypatch, rows, window, short, blocks):
    monkeypatch.setattr(lexical, "ROW_DOCS", rows)
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical.search, "__defaults__", (window,))
    items = spark.read.parquet(f"{edge['dir']}/benchmark.parquet")
    for k in (1, 5, 20):
        got = lexical.rank_documents(docs(spark, edge), items, k=k, block_terms=blocks).collect()
        assert sorted((tuple(r) for r in got), key=key) == sorted(brute.op12(edge, k), key=key)


def test_skipping_loses_nothing():
    """Few best documents, long lists, many windows: the passive lists are only probed."""
    import numpy as np

    rnd = np.random.default_rng(4)
    n_docs, words = 3000, 40
    lens = rnd.integers(5, 400, n_docs)
    doc, term = np.nonzero(rnd.random((n_docs, words)) < np.linspace(0.001, 0.9, words))
    tf = rnd.integers(1, 9, len(doc))
    part = (np.array(range(n_docs), object), lens, doc, term, tf)
    row = lexical.pack([part], n_docs, int(lens.sum())).to_pylist()[0]
    lists = lexical.Lists([row], n_docs, int(lens.sum()))
    weights = np.linspace(8000, 3, words).astype(np.int64)
    m = 75 + 25 * lens * n_docs // lens.sum()
    gain = 10**9 * tf // (1000 * tf + 12 * m[doc])
    for terms in ([0, 5, 39], range(words), [38, 39], [1]):
        terms = np.array(terms)
        scores = np.zeros(n_docs, np.int64)
        used = np.isin(term, terms)
        np.add.at(scores, doc[used], (weights[term] * gain)[used])
        want = sorted((-s, d) for d, s in enumerate(scores.tolist()) if s > 0)[:20]
        best = lexical.Best(20)
        lexical.search(lists, terms, weights[terms], best, window=64)
        assert [(-s, d) for s, d in best.rows] == want


# --------------------------------------------------------------- prefix trie


def test_trie_with_a_conversation_in_many_parts(spark, edge, monkeypatch):
    """One conversation over many range partitions, end lists of several rows."""
    monkeypatch.setattr(trie, "PACKED", 3)
    talks = spark.read.parquet(f"{edge['dir']}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [tuple(r) for r in trie.prefix_trie(talks).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sorted(got, key=key) == sorted(brute.op13(edge), key=key)


# ------------------------------------------------------------------- storage


def test_writes_at_a_time_put_the_setting_back(spark):
    from concurrent.futures import ThreadPoolExecutor

    from sitepulse.llm.storage import CLEANUP

    before = spark.conf.get(CLEANUP, None)
    scratch = Scratch(spark, "threads")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: scratch.table(spark.range(i, i + 50), f"t{i}").count(), range(8)))
    assert done == [50] * 8 and spark.conf.get(CLEANUP, None) == before
