"""Every opN query on the smallest tables: names, types and values, against SQL or a plain version."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from ropewalk.llm import bpe, entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(map(tuple, spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()))


def result(spark, name):
    df = entry.QUERIES[name](spark, FOLDER)
    return dict(df.dtypes), df.collect()


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    types, rows = result(spark, name)
    found = duck.execute(f"SELECT {', '.join(types)} FROM ({entry.SQL[name]})").fetchall()
    tidy = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(map(tidy, rows)) == Counter(map(tidy, found)) and len(rows) > 20


def test_op1(spark, docs):
    types, rows = result(spark, "op1_langid")
    assert types == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    by, langs = {r.doc_id: r for r in rows}, {d[2] for d in docs}
    for i, t, _ in docs:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= by[i].score <= 1
        assert by[i].lang_pred in ({"und"} if not any(c.isalpha() for c in t or "") else langs)
    assert sum(by[i].lang_pred == lang for i, _, lang in docs if by[i].held_out) >= 0.9 * sum(r.held_out for r in rows)


def test_op2(spark, docs):
    types, rows = result(spark, "op2_ctw")
    assert [types[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in docs}
    tokens = {i: [*WORD.findall(lower(t or "")), None] for i, t, _ in docs}
    count = Counter(w for i, own in tokens.items() if not out[i] for w in own)
    total = sum(count.values())
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(count[w] > 0 for w in own), total)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own)) < 1e-6
        assert r.score < 0
    assert len(rows) == len(docs)


def test_op6(spark, docs):
    types, rows = result(spark, "op6_bpe")
    assert types == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = {i: enc.encode_ordinary(t or "") for i, t, _ in docs}
    assert Counter(map(tuple, rows)) == Counter((i, len(ids[i]), sha(" ".join(map(str, ids[i]))), sha(t or "")) for i, t, _ in docs)


def test_op7(spark, docs):
    types, rows = result(spark, "op7_quality")
    assert types == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    own = [r for r in rows if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in own) >= 0.9 * len(own)


def test_op8(spark, docs):
    types, rows = result(spark, "op8_repeats")
    assert types == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    seen, want = set(), []
    for i, t, _ in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        want.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(data, gone, strict=True) if not g))))
    assert Counter(map(tuple, rows)) == Counter(want) and sum(w[2] for w in want) > 0


def test_op9(spark, docs):
    types, rows = result(spark, "op9_simhash")
    assert types == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    prints = []
    for _, t, _ in docs:
        words = [w.encode() for w in WORD.findall(lower(t or ""))]
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    component = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and component[a] != component[b]:
                low, high = sorted((component[a], component[b]))
                component = [low if c == high else c for c in component]
    assert Counter(map(tuple, rows)) == Counter((docs[k][0], f"{prints[k]:016x}", docs[component[k]][0]) for k in range(len(docs)))


def test_op10(spark):
    types, rows = result(spark, "op10_neighbours")
    assert types == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    own = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ok = {r.vec_id: np.array(r.embedding, float) for r in own if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    hits = total = 0
    for q in (i for i in ok if i % 50 == 0):
        cos = sorted((-float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])), i) for i, v in ok.items() if i != q)[:5]
        found = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - float(ok[i] @ ok[q] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[q]))) < 1e-12 for _, i, s in found)
        hits, total = hits + len({i for _, i, _ in found} & {i for _, i in cos}), total + 5
    assert hits >= 0.9 * total
