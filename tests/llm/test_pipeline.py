"""run() of the corpus pipeline against the same steps in plain Python, and its stages on odd input."""

import hashlib
import os
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from ropewalk.llm import bpe, langid, simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, net):
    """rows: (doc_id, text, source). The network is given; what it says of each text is computed one by one."""
    known = []
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            p = net.predict([r[1].encode()])[0]
            if p.max() >= corpus_pipeline.LEAST_SCORE:
                known.append(r)
    last = {}
    for r in known:
        last[lower(r[1])] = max(last.get(lower(r[1]), r), r)
    kept = sorted(last.values())
    prints, component = [simhash.fingerprint(r[1].encode()) for r in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((component[i], component[j]))
                component = [a if c == b else c for c in component]
    kept = [r for i, r in enumerate(kept) if component[i] == i]
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in kept}
    sizes = Counter()
    for r in kept:
        sizes[r[2]] += words[r[0]]
    order = sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]:
        s = min(over, key=lambda s: 3 * sizes[s] / weight[s])
        target[s] = 3.0 * sizes[s]
        left -= target[s]
        free.discard(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = Counter()
    for s in order:
        whole = min(3, int(target[s] // sizes[s]))
        rest, upto = (target[s] - whole * sizes[s]) if whole < 3 else 0.0, 0
        for r in sorted((r for r in kept if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()[:15]):
            before, upto = upto, upto + words[r[0]]
            again = before < rest and (upto < rest or upto - rest < rest - before)
            out[r[0], r[1]] += whole + again
    return +out


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    net = langid.train_on(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for (i, t), n in brute([(r.doc_id, r.text, r.source) for r in docs.collect()], net).items():
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_stages_keep_columns_and_bear_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "de", "src1", 0), (10**9, "", None, None, 0)], docs.schema)
    rows = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, FOLDER)
        assert rows.columns == [*docs.columns, "score"], name
        assert rows.count() > 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), FOLDER).count() == 0
