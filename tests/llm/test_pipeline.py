import hashlib
import random
import re

import corpus_pipeline
from tsuzuri.llm import ngram_jaccard, queries, secret_scan, sentencepiece_bpe, soft_mixing, toxicity


def tables(folder, spark):
    rng = random.Random(11)
    clean, bad = [f"clean{i}" for i in range(60)], [f"junk{i}" for i in range(30)]
    docs, labels = [], []
    for i in range(260):
        kind = i % 4  # 0 and 1 clean, 2 junk, 3 toxic
        own = [rng.choice(clean) for _ in range(rng.randint(30, 60))]
        if kind == 2:
            own = [rng.choice(bad) + " |" for _ in range(40)]
        if kind == 3:
            own[5:5] = ["idiot", "moron", "hateful"]
        if kind == 0 and i % 8 == 0:
            own += ["password=hunter22"]
        docs.append((i, " ".join(own), "en", "s", 1))
        if i < 200:
            labels.append((i, int(kind != 2), int(kind == 3)))
    docs += [(300 + i, docs[i * 4][1] + " tail", "fr", None, 1) for i in range(20)]  # near copies
    docs += [(330, docs[1][1], "en", "s", 1), (330, docs[1][1], "en", "s", 1), (331, None, None, None, None), (332, "", "en", "s", 0), (None, "no key at all here", "en", "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_equal_plain_versions(spark, tmp_path):
    d = str(tmp_path)
    tables(d, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    at = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{i}")
        docs = spark.read.parquet(f"{d}/{i}")
        at[name] = [r.asDict() for r in docs.collect()]
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = [r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = toxicity.training_rows(spark.read.parquet(f"{d}/documents.parquet"), labels)
    same = lambda x, y: sorted(map(str, (sorted(r.items()) for r in x))) == sorted(map(str, (sorted(r.items()) for r in y)))

    chain = toxicity.fit_chain(rows)
    left = [r for r in first if chain.probabilities(r["text"])[-1] < chain.threshold]
    assert same(at["toxicity"], left) and len(first) - len(left) == 65  # all toxic ones, and no other

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, kept = [shingles(r["text"]) for r in left], []
    root = list(range(len(left)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and left[i]["doc_id"] is not None and left[j]["doc_id"] is not None and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = top(i), top(j)
                a, b = (a, b) if left[a]["doc_id"] <= left[b]["doc_id"] else (b, a)
                root[b] = a
    kept = [r for i, r in enumerate(left) if top(i) == i]
    assert same(at["ngram_jaccard"], kept) and len(left) - len(kept) == 22

    masked = {r["doc_id"]: r for r in at["secrets"]}
    for r in kept:
        want = re.sub(secret_scan.ASSIGN, lambda m: "<secret>" if len(m[2]) >= 6 else m[0], r["text"]) if r["text"] else r["text"]
        assert masked[r["doc_id"]]["text"] == want and masked[r["doc_id"]]["n_chars"] == (len(want) if want is not None else None)
    assert len(masked) == len(kept)

    model = soft_mixing.fit_domains(rows)
    clean = {r["doc_id"] for r in at["secrets"] if model.posterior(r["text"])[0][0] >= 0.5}
    out = {r["doc_id"] for r in at["mixing"]}
    assert clean <= out and all(r in at["secrets"] for r in at["mixing"])

    bpe = sentencepiece_bpe.codec(queries.tokenizer_path())
    assert len(at["sentencepiece"]) == len(at["mixing"])
    texts = {r["doc_id"]: r["text"] for r in at["mixing"]}
    for r in at["sentencepiece"]:
        ids = list(bpe.encode(texts[r["doc_id"]]))
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (texts[r["doc_id"]] or "")
    assert same(at["sentencepiece"], [r.asDict() for r in corpus_pipeline.run(spark, d).collect()])


def test_encoding_query_equals_the_library(spark, tmp_path):
    import sentencepiece

    tables(str(tmp_path), spark)
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    for r in queries.op4_sentencepiece(spark, str(tmp_path)).collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_toxicity_and_quality_on_held_out_rows(spark, tmp_path):
    tables(str(tmp_path), spark)
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, str(tmp_path)).where("is_toxic").collect()}
    assert {i for i in range(200, 260) if i % 4 == 3} == {i for i in toxic if i is not None and 200 <= i < 260}
    said = {r.doc_id: r.predicted for r in queries.op5_quality(spark, str(tmp_path)).where("doc_id between 200 and 259").collect()}
    assert sum(said[i] == int(i % 4 != 2) for i in said) >= 0.95 * len(said)
    assert ngram_jaccard.WORDS == 5
