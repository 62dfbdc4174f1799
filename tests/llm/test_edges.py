import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tsuzuri.llm import ann_forest, compression_quality, merkle, secret_scan, sentencepiece_bpe, soft_mixing, toxicity, warc
from tsuzuri.llm.queries import tokenizer_path

EXTRA = {"is_toxic": "kept", "p_toxic": "kept", "secrets": "kept", "h1": "kept", "rate": "kept", "score": "kept", "p": "kept", "k": "kept"}


def with_extra(df):
    return df.select("*", *[F.lit(v).alias(c) for c, v in EXTRA.items()])


def test_warc_keys_that_repeat_or_lack(spark):
    rows = [(1, "http://x/a%20b", "<p>a"), (1, "http://x/c", "<p>other"), (2, "é\r\n", "<p>a"), (None, "u", "<p>a"), (None, None, "<p>lone"), (-5, " v ", "<p>other"), (7, "w", "x" * 300_000)]
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(with_extra(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()), key=str)
    first = {}
    for k, _, t in rows:
        if k is not None:
            first[t] = min(k, first.get(t, k))
    want = []
    for k, u, t in rows:
        to = first.get(t) if t in first and k != first[t] else None
        want.append((k, u, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)


def test_warc_equals_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", rng.choice(["", "é" * 5, f"<p>{rng.randrange(40)}"])) for i in rng.sample(range(1000), 200)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, t in rows:
        least = min(j for j, _, x in rows if x == t)
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if k == least else ("revisit", least))


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[100:130] = v[100]
    rows = [(i, v[i].tolist()) for i in range(900)] + [(20, (v[20] + 1).tolist()), (40, v[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    v[20] = min(tuple(v[20]), tuple(v[20] + 1))
    got = {}
    for r in ann_forest.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, 900, 20):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -np.inf
        best = sorted(range(900), key=lambda i: (-s[i], i))[:20]
        assert len(got[q]) == 20 and all(abs(s[i] - x) < 1e-9 for i, x in got[q].items())
        hits += len(set(best) & set(got[q]))
    assert len(got) == 45 and hits >= 0.9 * 20 * 45


def test_double_vectors_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-10, 0.5]) for i in range(30)]
    got = [r.vec_id for r in ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).where("query_id = 0").orderBy("rank").collect()]
    assert got == [29, 28, 27]


def test_fingerprints_equal_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(500), 60)] + [(900, None), (901, ""), (902, "long " * 40_000)]
    got = {r.doc_id: r for r in merkle.edit_report(with_extra(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    order = sorted(rows, reverse=True)
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == merkle.fingerprint(t) and r.edited_fingerprint == merkle.fingerprint(edited)
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(following))
    assert merkle.edit_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert merkle.edit_report(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x")], "doc_id long, text string")).count() == 3


def test_base_spans_equal_a_plain_scan(spark):
    import re

    rng = random.Random(5)
    bits = ["password=", "Token : ", "api_key='", "AKIA" + "A1" * 9, "AKIAshort", "deadbeef" * 3, "0" * 23, "é", " ", "\n", "secret", "hunter2", "abcdefg", "=", '"']
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    kinds = [(r"(?:password|passwd|secret|token|api_?key)", "assign")]
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in secret_scan.report(with_extra(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        t = dict(rows)[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and kinds


def test_columns_of_the_caller_stay(spark):
    docs = with_extra(spark.createDataFrame([(1, "password=hunter22 x"), (None, None), (1, "")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 1, 0), (None, 1, 1), (3, 5, 0)], "doc_id long, quality int, toxic int")
    for out in (secret_scan.redact(docs), toxicity.without_toxic(docs, labels.where("false"))):
        assert out.columns == docs.columns and out.where(" and ".join(f"{c} = 'kept'" for c in EXTRA)).count() == 3
    assert toxicity.score(docs, toxicity.fit_chain([])).count() == 3
    assert toxicity.training_rows(docs, labels) == [("", (0, 1))]  # of conflicting labels and repeated texts the smallest
    assert compression_quality.training_rows(docs.withColumn("doc_id", F.col("doc_id") + 1), labels) in ([], [("", 1)])
    assert soft_mixing.report(docs, soft_mixing.fit_domains([]), {"clean": 1.0}).count() == 3
    assert sentencepiece_bpe.encode_documents(docs, tokenizer_path(), digests=True).count() == 3
    none = docs.where("false")
    assert toxicity.report(none, labels).count() == compression_quality.report(none, labels).count() == secret_scan.report(none).count() == soft_mixing.report(none, soft_mixing.fit_domains([]), {"clean": 1.0}).count() == sentencepiece_bpe.encode_documents(none, tokenizer_path()).count() == warc.round_trip(none.selectExpr("doc_id page_id", "'u' url", "text html")).count() == 0


def test_rates_meet_targets_like_brute_force(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet((0.4, 0.3, 0.2), 300)
    n = rng.integers(1, 500, 300)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_tokens long, p_clean double, p_junk double, p_toxic double")
    targets = {"clean": 0.7, "junk": 0.25, "toxic": 0.05}
    got = soft_mixing.rates(members, targets).orderBy("doc_id").toPandas()
    a, goal = (p * n[:, None]).T, np.array([0.7, 0.25, 0.05]) * n.sum()
    scaled, want, x = a / a.sum(1, keepdims=True), goal / a.sum(1), np.ones(300)
    step = 1 / np.linalg.norm(scaled @ scaled.T, 2)
    for _ in range(20_000):  # nonnegative least squares by plain projected gradient
        x = np.maximum(0, x - step * scaled.T @ (scaled @ x - want))
    least = np.abs(a @ x - goal).max() / n.sum()
    mine = np.abs(a @ got.rate.to_numpy() - goal).max() / n.sum()
    assert (got.rate >= 0).all() and mine <= least + 0.005 and abs(got.miss[0] - np.abs(a @ got.rate.to_numpy() / goal - 1).max()) < 1e-6
