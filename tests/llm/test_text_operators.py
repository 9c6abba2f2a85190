"""Each text operator against a brute-force version, with odd inputs: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from ropewalk.llm import bpe, chat, ctw, exact_dedup, graph_search, langid, mixing, quality, repeats, simhash
from ropewalk.llm.common import attach, held_out
from ropewalk.operators.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = "der die das und the of and Los que Él ñ une été le 12 x.".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[0].upper().translate(LOW), texts[1] + " tail", None, "", " \t\n", "ÄÖÜ", "äöü", "12 34 --", "a" * 5000, ("Long text, again. " * 900), texts[2], texts[2]]
    out = [(i * 3, t, None if i % 9 == 0 else "de" if i % 2 else "en", None if i % 7 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts)]
    return out + [out[-1], (None, "no id", "de", "s1", None), (None, None, None, None, None), (10**12, texts[3], "en", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["keep_id", "kept", "score", "salt", "digest", "content", "id", "size", "h", "fp", "mark", "block", "kind", "root", "ids"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    out, stayed = [], set()
    for i, t, *_ in rows:
        norm = (t or "").translate(LOW)
        ids = [x for x in groups[norm] if x is not None]
        top = max(ids) if ids else None
        kept = i == top and norm not in stayed
        stayed |= {norm} if kept else set()
        out.append((i, top, len(groups[norm]), kept, sha(norm)))
    return Counter(out)


@pytest.mark.parametrize("digest", [lambda s: s, lambda s: F.lit(b"x")], ids=["sha", "all-collide"])
def test_exact_dedup(docs, rows, digest):
    found = exact_dedup.exact_dedup(docs, digest=digest)
    assert Counter(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute_exact(rows)


def test_exact_dedup_rows(docs, rows):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, _, _, k, _), n in brute_exact(rows).items() for _ in range(n) if k)


def brute_mix(rows):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += count(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while True:  # the excess over three times a size is shared again and again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return sizes, target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)


def test_mixing(docs, rows):
    sizes, target = brute_mix(rows)
    found = mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert len(found) >= len(rows) - 2
    own = mixing.mix(docs.withColumn("doc_id", F.struct("doc_id", "source", F.rand(3)).cast("string"))).collect()
    taken, largest = Counter(), Counter()
    for r in own:
        s = re.match(r"\{(.*?), (.*?), ", r.doc_id)[2]
        s = None if s == "null" else s
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-9


@pytest.mark.parametrize(
    ("ids", "texts"),
    [(lambda k: None, lambda k: "a b c"), (lambda k: None, lambda k: "w " * (k % 7)), (lambda k: 5, lambda k: f"{k % 2} x" if k % 5 else None), (lambda k: k % 3, lambda k: "w " * (k % 7)), (lambda k: k, lambda k: "a b c")],
)
def test_mixing_on_repeated_ids(spark, ids, texts):
    own = [(ids(k), texts(k), "de", "a" if k % 10 < 6 else "b", k) for k in range(500)]
    own += [(ids(k), texts(k), "en", None if k % 2 else "c", k) for k in range(40)]
    df = spark.createDataFrame(own, SCHEMA)
    sizes, target = brute_mix(own)
    largest = max(len((t or "").split()) for _, t, *_ in own)
    made, taken = mixing.mixed_rows(df.repartition(4)).collect(), Counter()
    for r in made:
        taken[r.source] += len((r.text or "").split())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest / 2 + 1e-9, (s, taken, target)
    assert max(Counter(map(tuple, made)).values()) <= 3  # n_chars tells the rows apart
    again = [Counter(map(tuple, mixing.mix(df.repartition(n)).collect())) for n in (1, 3)]
    assert again[0] == again[1] and sum(r[-1] * n for r, n in again[0].items()) == sum(taken.values())


def test_mixing_reruns_and_rows(docs):
    a, b = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))
    made = mixing.mixed_rows(docs)
    assert made.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in made.collect())
    assert words == sum(r.taken for r in a)


def test_attach_beyond_the_broadcast_bound(docs, spark):
    table = spark.createDataFrame([("s1", 1), (None, 2)], "source string, x int")
    few, many = (attach(docs.select("doc_id", "source"), table, ["source"], most_rows=n).collect() for n in (100, 1))
    assert Counter(map(tuple, few)) == Counter(map(tuple, many)) and any(r.source is None and r.x == 2 for r in many)


TURNS = [(1, 0, "system", "Be \\ <kind> [x]"), (1, 1, "user", "a</s>"), (1, 2, "user", "<|end|>\n<|start|>"), (1, 3, "assistant", "ok [/INST] \\\\<\\"), (1, 4, "assistant", None), (2, 5, "assistant", "öä"), (2, 5, "assistant", "öä"), (2, None, None, "?"), (None, 1, "user", ""), (3, 0, "tool|<x>", "z")]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)).repartition(3)
    made = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        r = made[conv]
        assert [(t.role, t.text) for t in r.turns] == [(w[2], w[3]) for w in want]
        assert list(r.learned) == [w[3] for w in want if w[2] == "assistant"]
        inner = r.formatted.replace("<|start|>", "").replace("<|text|>", "").replace("<|next|>", "").replace("<|end|>\n", "")
        assert not any(c in inner for c in ("<|", "</s>", "[INST]", "[/INST]", "<s>"))
        assert r.formatted.count("<|start|>") == sum(1 for k, w in enumerate(want) if k == 0 or want[k - 1][2] != w[2])
    assert chat.format_chats(turns.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5000])
def test_long_chats(spark, n):
    rng = random.Random(n)
    own = [(1, k, rng.choice(["user", "assistant", "assistant"]), rng.choice(["", "ö[", "some words", "x" * 70])) for k in range(n)] + [(2, 0, "assistant", "a" * 200_000)]
    made = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(own, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert made[2].learned == ["a" * 200_000] and len(made) == 1 + (n > 0)
    if n:
        assert [(t.role, t.text) for t in made[1].turns] == [x[2:] for x in own[:n]]
        assert made[1].learned == [t for _, _, r, t in own[:n] if r == "assistant"]
        at = 0
        for s in made[1].loss_spans:
            assert s.start >= at and "<|" not in made[1].formatted[s.start : s.start + s.length]
            at = s.start + s.length


def test_bpe_equals_the_library(docs, rows, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    found = bpe.decode(bpe.encode(docs, ranks, pattern, block=3000), ranks)
    want = Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found.collect()) == want
    both = bpe.encode(docs, ranks, pattern, decoded=True)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both.collect()) == want
    assert bpe.encode(nothing, ranks, pattern).count() == 0


def test_pre_tokens_on_odd_characters():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut, piece, rng = bpe.pre_tokenizer(public_tokenizers.PATTERN), bpe._coder(ranks).piece, random.Random(2)
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF, 0x1F600, 0x661, 0x2160]]
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 10)))
        assert [i for w in cut.findall(t) for i in piece(w.encode())] == enc.encode_ordinary(t)


def brute_print(t, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOW).encode())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, nothing):
    prints = [brute_print(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), 10**18), r[0])
    want = Counter((r[0], prints[i], least.get(root(i))) for i, r in enumerate(rows))
    found = simhash.near_components(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == want
    assert simhash.near_components(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {x[2] for x in want}
    assert simhash.fingerprint(b"a b c d e") == brute_print("a b c d e")


def test_one_document_of_each_component(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(9)]
    ids = [None, None, None, 5, 5, 5, 4, None, 3]
    own = list(zip(ids, texts, strict=True)) + [(5, texts[0]), (None, texts[3]), (9, texts[6]), (None, texts[1]), (3, texts[8]), (2, texts[4])]
    kept = simhash.keep_one(spark.createDataFrame(own, "doc_id bigint, text string").repartition(3)).collect()
    want = {t: min((i for i, x in own if x == t), key=lambda i: (i is None, i or 0)) for t in texts}
    assert Counter(map(tuple, kept)) == Counter((i, t) for t, i in want.items())


@pytest.mark.parametrize("trial", range(8))
def test_gray_index(trial):
    rng = np.random.default_rng(trial)
    base = rng.integers(0, 2**64, size=60, dtype=np.uint64)
    x = base[rng.integers(0, 60, 600)]
    for _ in range(trial):
        x = x ^ np.where(rng.random(600) < 0.5, np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64), np.uint64(0))
    x = np.unique(x)
    group = (x % np.uint64(3)).astype(int) if trial % 2 else np.zeros(len(x), int)
    index = simhash.GrayIndex(group, x)
    own = group[index.order]
    u, v = np.nonzero((np.bitwise_count(index.fps[:, None] ^ index.fps[None]) <= 4) & (own[:, None] == own[None]))
    assert (simhash._merge(np.arange(len(x)), u, v) == index.components()).all()


def test_crowded_shards_are_cut_again(spark):
    rng = random.Random(12)
    own = {rng.getrandbits(64) for _ in range(200)} | {(0xABCDE << 44) | rng.getrandbits(18) for _ in range(300)}  # many that agree on most bits
    for x in list(own)[:150]:
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        own.add(x)
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in own], "fp bigint")
    dealt = simhash.shards(fps, most=20)
    assert dealt.groupBy("m", "k").agg(F.count_distinct("fp").alias("n")).agg(F.max("n")).first()[0] <= 20  # a shard may come by two ways
    meet = {}
    for r in dealt.collect():
        meet.setdefault((r.m, r.k), []).append(r.fp % (1 << 64))
    met = {frozenset((a, b)) for g in meet.values() for a in g for b in g if (a ^ b).bit_count() <= 4}
    assert met == {frozenset((a, b)) for a in own for b in own if (a ^ b).bit_count() <= 4}
    few, many = (sorted(map(tuple, components(simhash.near_edges(fps, most=n)).collect())) for n in (20, simhash.MOST))
    root = lambda edges: {u: v % (1 << 64) for u, v in edges}
    assert root(few) == root(many)


@pytest.mark.parametrize("rows_", [10, 1 << 26, 1 << 34])
def test_any_two_near_prints_share_a_table(rows_):
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in simhash.tables(rows_))


def test_language(docs, rows, spark, nothing):
    train = [(i, ("der die und ein schön " if i % 2 else "the and of which one ") * 6, "de" if i % 2 else "en") for i in range(200)]
    net = langid.train_on(spark.createDataFrame(train, "doc_id bigint, text string, lang string"), F.lit(True))
    assert net.classes == ["de", "en"]
    found = langid.identify(docs, net).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    test = spark.createDataFrame([("und die schön der ein",), ("which one of the and",), ("der die und ein schön " * 3000,)], "text string")
    assert [r.lang_pred for r in langid.identify(test, net).collect()] == ["de", "en", "de"]
    assert langid.train_on(nothing, F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(nothing, net).count() == 0


def test_language_learns_from_whole_and_short_texts(spark, monkeypatch):
    own = [(k, "ja das ist gut", "de") for k in range(50)] + [(100 + k, f"yes this is good and number {k} of a line of english text", "en") for k in range(50)]
    net = langid.train_on(spark.createDataFrame(own, "doc_id bigint, text string, lang string"), F.lit(True))
    test = spark.createDataFrame([("ja das ist gut",), ("yes this is good",)], "text string")
    assert [r.lang_pred for r in langid.identify(test, net).collect()] == ["de", "en"]
    monkeypatch.setattr(langid, "_BATCH", 4)
    monkeypatch.setattr(langid, "_PART", 8)
    seen = []
    monkeypatch.setattr(langid, "train", lambda parts, classes, total, epochs: seen.extend([list(parts()), list(parts()), classes, total.tolist()]))
    texts = ["é" * 1000 + "end", "b" * 128, "c", "", None]
    langid.train_on(spark.createDataFrame([(k, t, "xy"[k % 2]) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string"), F.lit(True))
    first, second, classes, total = seen
    assert classes == ["x", "y"] and total == [2004.0, 128.0]
    for epoch in (first, second):  # every window of every text, short ones too
        got = Counter((bytes(x[i, : n[i]]), int(y[i])) for x, y, n in epoch for i in range(len(x)))
        assert got == Counter((t.encode()[i : i + 128], k % 2) for k, t in enumerate(texts) if t for i in range(0, len(t.encode()), 128))


def test_byte_network_against_loops():
    rng = np.random.default_rng(4)
    params = langid.initial(3, rng)
    embed, *conv, bias, out, out_bias = params
    bias += rng.normal(size=bias.shape)
    net = langid.ByteNet(["a", "b", "c"], [np.stack([embed @ c[j] for j in range(len(c))]) for c in conv], bias, out, out_bias)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    for i, row in enumerate(x):
        want = []
        for c in conv:
            for f in range(langid.FILTERS):
                want.append(max(sum(embed[row[at + j]] @ c[j, :, f] for j in range(len(c))) for at in range(langid.WINDOW - len(c) + 1)))
        h = np.maximum(0, np.array(want) + bias)
        z = h @ out + out_bias
        assert np.allclose(net.features(x)[i], h, atol=1e-5)
        assert np.allclose(net.log_probs(x)[i], z - np.log(np.exp(z).sum()), atol=1e-4)
    y, weight = np.array([0, 1, 2, 1, 0]), rng.random(5) + 0.1
    _, grads = langid.gradients(params, x, y, weight)
    for par, grad in zip(params, grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in par.shape) for _ in range(6)] + [np.unravel_index(np.abs(grad).argmax(), par.shape)]:
            keep, values = par[at], []
            for step in (1e-6, -1e-6):
                par[at] = keep + step
                values.append(langid.gradients(params, x, y, weight)[0])
            par[at] = keep
            assert abs((values[0] - values[1]) / 2e-6 - grad[at]) < 1e-5


def test_rare_language_stays_a_class(spark):
    own = [(i, f"some text number {i} in a common language", "de" if i % 2 else "en", i) for i in range(3000)] + [(5000, "one of its own kind, and the only one there is", "xx", 0), (5001, "another", None, 0)]
    rows = spark.createDataFrame(own, "doc_id bigint, text string, lang string, h bigint")
    net = langid.train_on(rows, F.lit(True), sample=100)
    assert net.classes == ["de", "en", "xx"]
    few = Counter(r.lang for r in langid.lang_sample(rows.filter("lang is not null").withColumn("h", F.xxhash64("doc_id")), 100).collect())
    assert few["xx"] == 1 and few["de"] + few["en"] < 250


def test_held_out(docs):
    for r in docs.select("doc_id", held_out("doc_id", 4, 2).alias("x")).collect():
        assert r.x == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)


def test_quality(docs, rows, spark, nothing):
    texts = [(i, "a fine sentence of many different words indeed" if i % 2 else "junk junk junk $$$ $$$ %%%") for i in range(200)]
    own = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (5000, 1, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    voters = quality.learn_quality(own, labels, ~held_out("doc_id", 3, 1))
    found = quality.score_quality(own, voters).collect()
    assert all(r.predicted == r.doc_id % 2 and (r.score >= 0.5) == (r.predicted == 1) for r in found)
    odd = quality.score_quality(docs, voters).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    none = quality.learn_quality(own, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score_quality(own, none).collect()} == {0.5}
    assert quality.score_quality(nothing, voters).count() == 0


def test_quality_votes_are_exact():
    rng = np.random.default_rng(0)
    x = rng.random((50, quality.TERMS + 2)).astype(np.float32)
    y = rng.integers(0, 2, 50)
    v = quality.fit(x, y)
    lat = v.latent(x)
    for i in range(5):
        s = lat @ lat[i]
        top = np.argsort(-s)[: quality.NEIGHBOURS]
        w = np.exp(quality.SHARPNESS * (s[top].astype(float) - 1))
        assert abs(v.score(x[i : i + 1])[0] - (w * y[top]).sum() / w.sum()) < 1e-5


def test_quality_against_its_own_analysis():
    """Scores by a plain version: counted terms, an eigenvector at a time, and a sorted vote."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "über", "x!!"][: 2 + k % 4]) for _ in range(rng.randint(1, 30))) for k in range(60)] + ["", "   "]
    labels = [k % 2 for k in range(40)]

    def plain(t):
        out, words, data = np.zeros(quality.TERMS + 2), t.encode().split(), t.encode()
        half = quality.TERMS // 2
        for w in words:
            out[xxhash.xxh32(w).intdigest() % half] += 1 / len(words)
        for a, b in zip(data, data[1:], strict=False):
            out[half + (a * 61 + b * 7919) // 2 % half] += 1 / len(data)
        if words:
            out[-2] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
            out[-1] = 1 - len(set(words)) / len(words)
        return np.sqrt(out)

    x = np.array([plain(t) for t in texts])
    assert np.allclose(x, [quality.terms(t.encode()) for t in texts], atol=1e-6)
    learn = x[:40]
    rarity = np.log(41 / (1 + (learn[:, :-2] > 0).sum(axis=0))) + 0.2

    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n > 1e-9 else v

    full = [unit(np.concatenate([unit(v[:-2] * rarity), v[-2:]])) for v in x]
    gram = sum(np.outer(v, v) for v in full[:40])
    values, vectors = np.linalg.eigh(gram)
    axes = vectors[:, np.argsort(-values)[: quality.DIMS]]
    latent = [unit(v @ axes) for v in full]
    want = []
    for v, raw in zip(latent, x, strict=True):
        near = sorted(((float(v @ latent[j]), j) for j in range(40)), reverse=True)
        weights = [(math.exp(quality.SHARPNESS * (c - 1)), labels[j]) for c, j in near]
        cut = near[quality.NEIGHBOURS - 1][0]
        sure = [(w, y) for (c, _), (w, y) in zip(near, weights, strict=True) if c > cut + 1e-6]
        tied = [(w, y) for (c, _), (w, y) in zip(near, weights, strict=True) if abs(c - cut) <= 1e-6]
        rest, ones = quality.NEIGHBOURS - len(sure), sum(y for _, y in tied)
        low, high = max(0, rest - (len(tied) - ones)), min(rest, ones)  # any of those that tie may vote
        total = sum(w for w, _ in sure) + rest * tied[0][0]
        sums = [(sum(w * y for w, y in sure) + k * tied[0][0]) / total for k in (low, high)]
        want.append((0.5, 0.5) if not raw.any() else sums)
    got = quality.fit(np.array([quality.terms(t.encode()) for t in texts[:40]]), np.array(labels)).score(np.array([quality.terms(t.encode()) for t in texts]))
    for g, (low, high) in zip(got, want, strict=True):
        assert low - 1e-3 <= g <= high + 1e-3


@pytest.mark.parametrize("hot", [repeats.HOT, 1, 5])
def test_repeated_strings(spark, docs, rows, nothing, hot):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcde fgh") for _ in range(300))
    more = [(2000 + i, passage[i * 7 : i * 7 + 180] + f" {i} " + passage[: 90 + i], None, None, None) for i in range(20)]
    extra = spark.createDataFrame(more, SCHEMA)
    found = {r.doc_id: r for r in repeats.remove_repeats(docs.select("doc_id", "text").filter("doc_id != 153").unionByName(extra.select("doc_id", "text")).repartition(4), hot=hot).filter("doc_id is not null").collect()}
    seen = set()
    for i, t in sorted((r[0], (r[1] or "").encode()) for r in rows + more if r[0] is not None and r[0] != 153):
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        assert bytes(found[i].kept) == bytes(c for c, g in zip(t, gone, strict=True) if not g), i
        assert found[i].n_bytes == len(t)
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))]
        assert [(x.start, x.length) for x in found[i].removed] == spans
    assert repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
@pytest.mark.parametrize("ids", [[40, 30, 20, 10], [None, 7, None, 3], [5, 5, 2, 9]])
def test_repeats_in_a_block_out_of_order(spark, ids, hot):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcde fgh") for _ in range(240))
    own = [(i, f"{k}{'xyzw'[k] * 130} {passage} {'pqrs'[k] * 120}{k}" + passage * (k % 2)) for k, i in enumerate(ids)]
    found = {bytes(r.kept)[:1]: r for r in repeats.remove_repeats(spark.createDataFrame(own, "doc_id bigint, text string").coalesce(1), hot=hot).collect()}
    seen = set()
    for _, _, k in sorted((i is None, i or 0, k) for k, i in enumerate(ids)):
        t, gone = own[k][1].encode(), bytearray(len(own[k][1]))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        assert bytes(found[t[:1]].kept) == bytes(c for c, g in zip(t, gone, strict=True) if not g), (ids, k)


@pytest.mark.parametrize("length", [3, 12])
def test_interval_expansion(length):
    rng = random.Random(length)
    for _ in range(25):
        texts = [bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 70))) for _ in range(rng.randint(1, 9))] + [b"a" * 30]
        seen, want = set(), []
        for i, t in enumerate(texts):
            for s in range(len(t) - length + 1):
                if t[s : s + length] in seen:
                    want.append((i, s))
                seen.add(t[s : s + length])
        of, start = repeats.repeated_windows(texts, np.arange(len(texts)), length)
        assert sorted(zip(of.tolist(), start.tolist(), strict=True)) == sorted(want)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    shared = bytes(rng.choice(b"abcdefgh ") for _ in range(400))
    texts = [bytes(rng.choice(b"xyz ") for _ in range(rng.randint(0, 90))) + shared + bytes(rng.choice(b"uvw") for _ in range(50)) for _ in range(6)]
    h, of, start, n = repeats.contexts(texts)
    by = {}
    for a, t, s, k in zip(h.tolist(), of.tolist(), start.tolist(), n.tolist(), strict=True):
        for w in range(s, s + k):
            by.setdefault(texts[t][w : w + 100], set()).add(a)
    assert sum(len(t) - 99 for t in texts) == int(n.sum())
    assert all(len(a) == 1 for a in by.values())


def brute_ctw(train, text, depth):
    """log10 probability by direct recursion over context trees kept in dictionaries."""
    counts = {}
    for t in train:
        data = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            for k in range(8):
                bit, bits = data[i] >> (7 - k) & 1, (k, data[i] >> (8 - k))
                for d in range(depth + 1):
                    counts.setdefault((bits, data[i - d : i]), [0, 0])[bit] += 1
    children = {}
    for bits, c in counts:
        if c:
            children.setdefault((bits, c[1:]), []).append((bits, c))
    memo = {}

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[1]) == depth else math.log(0.5) + own + math.log1p(math.exp(min(700, sum(map(weighted, children[node])) - own)))
        return memo[node]

    def one(bits, context):
        out, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            node = (bits, context[depth - d :])
            if node not in counts:
                break
            z, o = counts[node]
            last = (o + 0.5) / (z + o + 1)
            share = 1.0 if d == depth else math.exp(math.log(0.5) + kt(z, o) - weighted(node))
            out += left * share * last
            left *= 1 - share
        return out + left * last

    total, data = 0.0, b"\xff" * depth + text + b"\xff"
    for i in range(depth, len(data)):
        for k in range(8):
            p = one((k, data[i] >> (8 - k)), data[i - depth : i])
            total += math.log10(p if data[i] >> (7 - k) & 1 else 1 - p)
    return total


def test_context_tree_weighting(docs, rows, nothing):
    some = [r for r in rows if r[1] is None or len(r[1]) < 400]
    small = docs.filter("text is null or length(text) < 400")
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    train = [(t or "").translate(LOW).encode() for i, t, *_ in some if i is not None and i % 2 == 0]
    count = Counter(w for t in train for w in [*t.split(), None])
    total, distinct = sum(count.values()), len(count)
    found = ctw.score_texts(small, learn).collect()
    assert len(found) == len(some)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in some:
        if i is None:
            continue
        low = (t or "").translate(LOW).encode()
        words, r = [*low.split(), None], by[i][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learned) == (len(words), sum(count[w] > 0 for w in words), total, i % 2 == 0)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)) < 1e-8
    for i, t, *_ in some[1:42:8]:
        want = brute_ctw(train, (t or "").translate(LOW).encode(), ctw.DEPTH)
        assert abs(by[i][0].score - want) < 1e-3 * max(1, abs(want)) * 0.01 + 1e-4
    assert ctw.score_texts(nothing, F.lit(True)).count() == 0
    blank = ctw.score_texts(small, F.lit(False)).filter("doc_id = 0").first()
    assert blank.train_tokens == 0 and abs(blank.score - 8 * math.log10(0.5) * (len(some[0][1].encode()) + 1)) < 1e-3


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(1000 + i, x[7].tolist()) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [None] + [1.0] * 15), (2004, [math.inf] * 16), (2010, [1.0, 2.0]), (2020, [2.0, 4.1]), (None, x[3].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("query_id", F.lit(1)).repartition(4)
    ok = {i: np.array(v) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    found = graph_search.nearest(df, F.col("vec_id") % 10 == 0, shard=300).collect()
    hits = total = 0
    for q in (i for i in ok if i % 10 == 0):
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        cos = sorted((-float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
        assert [r for r, _, _ in own] == list(range(1, len(cos) + 1))
        assert all(a[2] >= b[2] - 1e-15 for a, b in zip(own, own[1:], strict=False))
        for _, i, s in own:
            assert i != q and abs(s - float(ok[i] @ ok[q] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[q]))) < 1e-12
        hits += len({i for _, i, _ in own} & {i for _, i in cos})
        total += len(cos)
    assert hits >= 0.9 * total
    assert graph_search.nearest(df.limit(0), F.lit(True)).count() == 0


def test_exact_scores_of_all_that_a_beam_finds():
    rng = np.random.default_rng(5)
    q = np.eye(32)[0]
    side = rng.normal(size=(400, 32)) * (1 - q)
    x = q + side / np.linalg.norm(side, axis=1)[:, None] * (1 + 1e-9 * rng.permutation(400)[:, None])  # nearer than a float tells
    shard = graph_search._Shard({v.tobytes(): [i] for i, v in enumerate(x)})
    score = x[:, 0] / np.linalg.norm(x, axis=1)
    found = shard.ask([1000], [q.tobytes()], 5)
    assert (np.array(found.column("score")) >= np.sort(score)[-5:][::-1] - 1e-8).all()
    equal = np.sign(side) / 4  # 400 directions at one angle, more than a beam holds
    equal[:, 0] = 1
    _, at = np.unique(equal, axis=0, return_index=True)
    shard = graph_search._Shard({equal[i].tobytes(): [int(i)] for i in at})
    assert shard.ask([1000], [q.tobytes()], 5).column("vec_id").to_pylist() == sorted(at.tolist())[:5]


def brute_nearest(ok, q):
    cos = {i: float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])) for i, v in ok.items() if i != q}
    return sorted(cos.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("how", ["by two", "by three", "equal", "jitter", "tiny"])
def test_neighbours_of_one_direction(spark, how):
    rng = np.random.default_rng(6)
    x = {i: v for i, v in enumerate(rng.normal(size=(300, 16)))}
    one = rng.normal(size=16)
    scale = {"by two": lambda k: one * 2.0 ** (k % 40 - 20), "by three": lambda k: one * 3.0 ** (k % 9), "equal": lambda k: one, "jitter": lambda k: one * (1 + 1e-9 * rng.normal(size=16)), "tiny": lambda k: one * 2.0**-450 * (k + 1)}[how]
    x |= {1000 + k: scale(k) for k in range(400 if how == "equal" else 60)}
    x |= {2000 + k: one + 0.1 * rng.normal(size=16) for k in range(5)}  # queries near them
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id bigint, embedding array<double>").repartition(3)
    for exact in (False, True):
        found = graph_search.nearest(df, F.col("vec_id") % 1000 < 5, shard=100, exact=exact).collect()
        for q in [0, 1, 1000, 1001, 2000, 2001]:
            own = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
            want = brute_nearest(x, q)
            assert [s for _, s in own] == pytest.approx([s for _, s in want[:5]], abs=1e-13), (how, exact, q)
            if how in ("by two", "equal"):  # ties that rounding does not break
                assert [i for i, _ in own] == sorted((i for i, _ in own), key=lambda i: (-dict(own)[i], i))
                if q >= 2000:
                    assert [i for i, _ in own] == [i for i, _ in want[:5]]


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4096, 64))
    x[::7] = x[0] * rng.uniform(1, 9, (len(x[::7]), 1))  # and a third as many of one direction
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found, true = (graph_search.nearest(df, F.col("vec_id") % 50 == 1, exact=e) for e in (False, True))
    want = {q: brute_nearest(dict(enumerate(x)), q)[:5] for q in (1, 51, 1051)}  # none of that direction
    rows = true.collect()
    for q, own in want.items():
        assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == [i for i, _ in own]
    assert graph_search.recall(found, true) >= 0.9
    assert graph_search.recall(found.limit(0), true.limit(0)) == 1.0


def test_decoding_joins_the_table_it_is_given(spark):
    encoded = spark.createDataFrame([(1, [1, 0, 1]), (2, []), (3, None), (4, [2])], "doc_id bigint, ids array<int>")
    for second in (b"\xbe", b"B"):  # tables that come and go in a reused worker
        ranks = {b"A": 0, second: 1, b"\n": 2}
        got = {r.doc_id: None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(encoded, ranks).collect()}
        assert got == {1: second + b"A" + second, 2: b"", 3: None, 4: b"\n"}
    for ids in ([3], [1]):
        with pytest.raises(Exception, match="token|out of bounds"):
            bpe.decode(spark.createDataFrame([(ids,)], "ids array<int>"), {b"A": 0, b"C": 2}).collect()
