import base64
import hashlib
import io
import random

import numpy as np
import pytest

from tsuzuri.llm import ann_forest, compression_quality, html_template, merkle, ngram_jaccard, sentencepiece_bpe, soft_mixing, toxicity, warc
from tsuzuri.llm.queries import tokenizer_path


def test_encoding_equals_the_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), sentencepiece_bpe.codec(tokenizer_path())
    rng = random.Random(5)
    signs = " \n▁aeitonshrdAB.,!?'0123日本語éèß😀\t#*$-_=/"
    texts = ["", " ", "\n", "<s> </s> <0x0A>", "a" * 5000, "日" * 300, " " * 700 + "x"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    for t in texts:
        ids = own.encode(t)
        assert list(ids) == lib.encode(t) and own.decode(ids) == lib.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(3, 32000) for _ in range(rng.randint(0, 6))]
        assert own.decode(ids) == lib.decode(ids)
    assert len(own.encode(None)) == 0


def test_shingle_sets():
    s = ngram_jaccard.shingle_set
    assert len(s(None)) == len(s(" \t\n")) == 0 and len(s("a b")) == 1 and len(s("a b c d e f")) == 2
    assert (s("A B c D e") == s("a  b\nC d E")).all() and len(s("a b c d e f a b c d e")) == 6
    assert not np.array_equal(s("É b c d e"), s("é b c d e"))  # only A-Z change


def test_lists_lose_no_pair():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(-(1 << 62), 1 << 62, 60))
    sets = [np.unique(np.r_[rng.permutation(base)[: 60 - k], rng.integers(-(1 << 62), 1 << 62, k)]) for k in rng.integers(0, 8, 20)]
    order = ngram_jaccard.Order(base[:30].copy(), np.full(30, 9))
    rows = sorted((int(t), p, len(s), i) for i, s in enumerate(sets) for p, t in enumerate(order.prefix(s)))
    lists = ngram_jaccard._Lists()
    for at in range(0, len(rows), 7):
        t, p, n, e = (np.array(x) for x in zip(*rows[at : at + 7]))
        lists.feed(t, np.zeros(len(t), np.int32), e, n.astype(np.int32), p.astype(np.int32))
    none = np.empty(0, np.int64)
    few = none.astype(np.int32)
    lists.feed(none, few, none, few, few, end=True)
    got = {(int(a), int(b)) for o in lists.out if o[0] == ngram_jaccard.PAIR for a, b in zip(o[1], o[3])}
    for i in range(20):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in got


def test_warc_frames_and_digests():
    good = warc.record(7, "http://x/ü?a=b", b"<p>hi</p>", None) + warc.record(8, None, b"<p>hi</p>", 7) + warc.record(9, "u", b"", None)
    rows = [warc.fields(*warc.parse(m)) for m in warc.members(io.BytesIO(good).read)]
    assert [(r["key"], r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in rows] == [(7, "response", None, 9, "http://x/ü?a=b"), (8, "revisit", 7, 9, None), (9, "response", None, 0, "u")]
    assert rows[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"<p>hi</p>").digest()).decode()
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(good[:-5]).read))
    m = next(iter(warc.members(io.BytesIO(good).read)))
    with pytest.raises(warc.WarcError):
        warc.parse(m.replace(b"hi", b"ho"))


def test_merkle_locates_edits():
    a = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40))
    b = a.replace("w20x7", "changed")
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle.likeness(x, x) == 1 and 0.95 < merkle.likeness(x, y) < 1
    assert len(merkle.branches(x, y)[0]) == 1
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(None)) == 1 and merkle.likeness(merkle.fingerprint(""), x) == 0
    assert merkle.edited("abcdef", "XYZ") == "abcdXY" and merkle.edited("ab", "X") == "ab" and merkle.edited("abcdef", "") == "abcd"


def test_html_regions():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">Accept</div><article><header><h1>A &amp; B</h1></header><p>One<b>two</b>  three<br>four<p>Next<!-- c --> block<ul><li>item<li>more</ul><aside>Side</aside></article>
    <div id="comments"><p>Nice!</p></div><form><input>Send</form><footer>&copy;</footer>"""
    assert html_template.main_text(page, None, None) == "A & B\nOnetwo three four\nNext block\nitem\nmore"
    assert html_template.main_text(None, "/x", []) == "" and html_template.main_text("plain", None, None) == "plain"
    assert len(html_template.main_text("<p a='" + "x" * 100_000, None, None)) == 100_001  # an unclosed quote ends the tag


def test_classifiers_on_degenerate_labels():
    assert compression_quality.fit([]).score("x") == 0.5 and compression_quality.fit([("a", 1)]).score(None) == 1.0
    assert toxicity.fit_chain([]).probabilities("x") == [0.0, 0.0]
    assert soft_mixing.fit_domains([]).posterior(None)[0][0] == 1.0
    rows = [(f"nice words {i} here", (0, 0)) for i in range(30)] + [(f"bad idiot {i} words", (0, 1)) for i in range(30)]
    chain = toxicity.fit_chain(rows)
    assert chain.probabilities("an IDIOT!")[1] > 0.5 > chain.probabilities("nice here")[1]


def test_forest_finds_neighbours():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((800, 12)).astype(np.float32)
    w = ann_forest.widen(v, float(np.linalg.norm(v, axis=1).max()) * 1.00001)
    trees = ann_forest.forest(w, 40, 6)
    n = ann_forest.visits_for(trees, w, 10)
    homes = [t.leaves(w) for t in trees]
    hit = 0
    for q in range(0, 800, 40):
        found = {j for i, leaf in ann_forest.search(trees, np.append(v[q], np.float32(0)), n) for j in np.flatnonzero(homes[i] == leaf)}
        hit += len(found & set(np.argsort(-(v @ v[q]))[:10].tolist()))
    assert hit / 200 >= 0.9
