import corpus_pipeline
from tsuzuri.llm import compression_quality, secret_scan, sentencepiece_bpe
from tsuzuri.llm.queries import tokenizer_path


def test_dictionaries_see_the_end_of_long_texts(monkeypatch):
    seen = []
    monkeypatch.setattr(compression_quality.zstandard, "train_dictionary", lambda size, blocks: seen.extend(blocks) or compression_quality.zstandard.ZstdCompressionDict(b"x" * 64))
    texts = [f"{i} " * 9000 + f"end{i}" for i in range(30)]
    compression_quality._dictionary(texts)
    assert b"".join(seen) == "".join(texts).encode()


def test_keys_with_slashes_are_no_paths(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzKEYabcdefG"
    rows = [(1, f"aws_secret_access_key = {key}"), (2, "usr/local/lib/python3/site-packages/MyModule2/tests"), (3, "src/main/java/FrameReader2/ReadmeFirst/x86_64")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_entropy for r in secret_scan.report(docs).collect()} == {1: 1, 2: 0, 3: 0}
    assert key not in secret_scan.redact(docs).where("doc_id = 1").first().text


def test_last_stage_decodes_its_ids(spark):
    docs = spark.createDataFrame([(1, "Two words, é 日本\nline"), (2, None), (3, "")], "doc_id long, text string")
    bpe = sentencepiece_bpe.codec(tokenizer_path())
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert {k: r.decoded for k, r in got.items()} == {1: "Two words, é 日本\nline", 2: "", 3: ""}
    assert all(r.decoded == bpe.decode(r.ids) and r.n_tokens == len(r.ids) for r in got.values())
