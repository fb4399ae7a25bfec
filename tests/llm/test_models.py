"""Operators that SQL can't express: against plain versions, other libraries, round trips or held-out rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import ann, bpe, chat_format, exchange, language_id, quality, url_filter
from quillspark.llm import kernel as K

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_documents(documents):
    model = language_id.train(documents.filter("doc_id % 2 = 0"))
    got = language_id.identify(documents.filter("doc_id % 2 = 1"), model).join(documents.select("doc_id", "lang", F.size(F.split("text", r"\s+")).alias("w")), "doc_id").filter("w >= 5").collect()
    kept = [r for r in got if r["kept"]]
    assert len(kept) > 0.95 * len(got)
    assert np.mean([r["language"] == r["lang"] for r in kept]) > 0.97


def test_words_of_mixed_text(documents):
    model = language_id.train(documents.filter("doc_id % 2 = 0"))
    rows = [r for r in documents.filter("doc_id % 2 = 1").collect() if len(r["text"].split()) >= 30]
    right = total = 0
    for a, b in zip(rows[::2], rows[1::2]):
        if a["lang"] == b["lang"]:
            continue
        texts = [" ".join(x["text"].replace(".", " ").split()[:15]) for x in (a, b)]
        sizes = [len(K.words(pa.array([t])).start) for t in texts]
        post = language_id.label_words(model, K.words(pa.array([" ".join(texts)])))
        said = [model.labels[i] for i in post.argmax(axis=1)]
        want = [a["lang"]] * sizes[0] + [b["lang"]] * sizes[1]
        right, total = right + sum(x == y for x, y in zip(said, want)), total + len(want)
    assert total > 500 and right > 0.9 * total


@pytest.mark.parametrize("block", [128, 3, 2, 1])
def test_forward_backward_against_all_paths(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = np.random.default_rng(1)
    e, t, s = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    off = np.array([0, 4, 5, 9])
    post = language_id.forward_backward(e, off, t, s)
    for a, b in zip(off[:-1], off[1:]):
        want = np.zeros((b - a, 3))
        for code in range(3 ** (b - a)):
            path = [code // 3**i % 3 for i in range(b - a)]
            w = math.exp(s[path[0]] + sum(e[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(post[a:b], want / want.sum(axis=1, keepdims=True))


def test_a_hundred_languages_and_a_long_sentence():
    texts = [f"w{i}a w{i}b w{i}c " * 5 for i in range(100)] * 2
    model = language_id.fit(texts, [f"l{i:02}" for i in range(100)] * 2, epochs=1)
    assert len(model.labels) == 101 and model.lexicon_weights.shape == (100, 101)
    words = K.words(pa.array([" ".join(texts[7:8] * 300)]))
    post = language_id.label_words(model, words)
    assert post.shape == (4500, 101) and np.allclose(post.sum(axis=1), 1, atol=1e-4) and list(language_id.sentences(words)) == [0, 4500]


@pytest.fixture(scope="module")
def known_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_bpe_ids_are_the_merge_loops(documents, known_tokenizer):
    rows = bpe.encode(documents).join(documents.select("doc_id", "text"), "doc_id").collect()
    want = known_tokenizer.encode_batch([r["text"] for r in rows], add_special_tokens=False)
    assert all(r["ids"] == w.ids and r["exact"] for r, w in zip(rows, want))


@pytest.fixture(scope="module")
def encoder():
    import regex

    return bpe.Encoder(bpe.read_vocabulary(bpe.VOCABULARY)), regex.compile(bpe.PIECES)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("aeinorst '\n\t0123456789<|>", max_size=200), st.sampled_from(["a", "ab", " the", "é", "\n"]).flatmap(lambda s: st.integers(1, 300).map(lambda n: s * n))))
def test_bpe_on_odd_texts(text, encoder, known_tokenizer):
    own, pieces = encoder
    got = np.frombuffer(b"".join(own[p] for p in pieces.findall(text)), dtype=np.int32).tolist()
    assert got == known_tokenizer.encode(text, add_special_tokens=False).ids


def test_decode_rejects_unknown_ids(spark):
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()


def test_url_scores_against_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.collect()
    import re

    text = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")
    counts = Counter(w for r in rows for w in re.findall("[a-z0-9\x80-\U0010ffff]+", text.sub(" ", r["html"]).lower()))
    total = sum(counts.values())
    for w in url_filter.WORDS:
        counts[w] = max(counts[w], max(1, int(url_filter.FLOOR * total)))

    def split(run):
        """The least cost of each beginning, over all last words."""
        best = [(0.0, [])]
        for j in range(1, len(run) + 1):
            ways = []
            for i in range(j):
                word = run[i:j]
                cost = math.log(total) - math.log(counts[word]) if counts.get(word) else math.log(total) + url_filter.BYTE_COST * len(word)
                ways.append((round(best[i][0] + cost, 9), i, best[i][1] + [word]))
            cost, _, words = min(ways)
            best.append((cost, words))
        return best[-1][1]

    own, examples = {}, []
    for r in rows:
        host = re.match(r"https?://([^/?#:]*)", r["url"])[1].lower()
        runs = list(re.findall(r"[^\W\d_]+", host.rpartition(".")[0] + " " + re.sub(r"https?://[^/?#]*", "", r["url"]).lower()))
        bad = bool(re.search("(^|[.-])(" + "|".join(url_filter.SEEDS) + ")([.-]|$)", host))
        own[r["page_id"]] = (sorted(w for run in runs for w in split(run)), bad)
        examples.append((own[r["page_id"]][0], bad))
    n = {c: Counter(w for ws, b in examples if b == c for w in ws) for c in (True, False)}
    v = len(n[True] | n[False])
    size = {c: sum(n[c].values()) for c in n}
    odds = lambda w: math.log((n[True][w] + 1) / (size[True] + v + 1)) - math.log((n[False][w] + 1) / (size[False] + v + 1))
    prior = math.log((sum(b for _, b in examples) + 1) / (sum(not b for _, b in examples) + 1))
    got = {r["page_id"]: r for r in url_filter.score_urls(pages).collect()}
    assert len(got) == len(rows)
    for page, (ws, bad) in own.items():
        assert got[page]["words"] == ws
        assert abs(got[page]["log_odds"] - (prior + sum(map(odds, ws)))) < 1e-6
        assert got[page]["kept"] == (not bad and got[page]["log_odds"] < 0)


def test_words_of_any_length_are_known(spark):
    word = "pneumonoultramicroscopicsilicovolcanoconiosis"
    rows = [(1, f"http://the{word}casino.example.com/", f"<p>{word} the casino {word}</p> the"), (2, f"http://x.y/{word}é{word}", "<p>é</p>"), (3, f"http://{word[:30]}.net", None)]
    got = {r["page_id"]: r["words"] for r in url_filter.score_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == sorted(["example", "the", word, "casino"]) and got[2] == sorted(["x", word, "é", word]) and got[3] == [word[:30]]


def test_run_together_hosts_are_found(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    more = [(10**6, "http://freecasinobets.example.com/en/1", ""), (10**6 + 1, "https://www.cheappillsonline.example.net/en/2", ""), (10**6 + 2, "http://ththon.example.com/en/3", "")]
    got = {r["page_id"]: r for r in url_filter.score_urls(pages.union(spark.createDataFrame(more, pages.schema))).filter("page_id >= 1000000").collect()}
    assert got[10**6]["words"].count("casino") == 1 and not got[10**6]["kept"]
    assert not got[10**6 + 1]["kept"] and got[10**6 + 2]["kept"]


def test_viterbi_against_all_splits():
    known = [(0, 2, 60), (2, 6, 20), (0, 6, 1), (3, 6, 90), (2, 3, 4)]
    cost = {(i, j): math.log(1000) - math.log(c) for i, j, c in known}

    def best(i):
        return min([(cost.get((i, j), math.log(1000) + url_filter.BYTE_COST * (j - i)) + best(j)[0], j) for j in range(i + 1, 7)], default=(0, 0))

    at, want = 0, []
    while at < 6:
        j = best(at)[1]
        want.append("foobar"[at:j])
        at = j
    assert url_filter.viterbi("foobar", known, 1000) == want


def test_hidden_roles_come_back(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    model = chat_format.fit(rows.filter("conv_id % 2 = 0"))
    true = {r["conv_id"]: r["r"] for r in rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r")).collect()}
    hidden = chat_format.format_chats(rows.filter("conv_id % 2 = 1").withColumn("role", F.lit(None).cast("string")), model).collect()
    assert np.mean([x == y for r in hidden for x, y in zip(r["roles"], true[r["conv_id"]])]) > 0.8
    shown = chat_format.format_chats(rows, model).collect()
    assert all(r["roles"] == true[r["conv_id"]] for r in shown)


def test_blank_lines_and_markers_in_text(spark):
    code = "Here:\n\n```\nx = 1\n\ny = 2\n```\n\nAnswer: 42 is right"
    usual = [(i, t, r, f"say {i}\nAnswer: {i}\n\nmore" if t else "what?") for i in range(30) for t, r in enumerate(("user", "assistant"))]
    rows = [*usual, (100, 0, "user", "how?"), (100, 1, "assistant", code), (101, 0, "assistant", "User: hi"), (102, 0, "assistant", "<|user|> hi"), (103, 0, None, "### User:\nhi\n\nthere\n### Bot\nyes")]
    by = {r["conv_id"]: r["text"] for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by[100] == f"<|user|>\nhow?\n<|end|>\n<|assistant|>\n{code}\n<|end|>"
    assert by[101] == "<|assistant|>\nUser: hi\n<|end|>" and by[102] == "<|user|>\nhi\n<|end|>"
    assert by[103] == "<|user|>\nhi\n\nthere\n<|end|>\n<|assistant|>\nyes\n<|end|>"
    alone = chat_format.format_chats(spark.createDataFrame([(1, 0, None, "Q: why?\nA: so\nand so")], "conv_id long, turn long, role string, text string")).first()
    assert alone["text"] == "<|user|>\nwhy?\n<|end|>\n<|assistant|>\nso\nand so\n<|end|>"


def test_role_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    model = chat_format.Model(rng.normal(size=6), rng.normal(size=(6, 6)), rng.normal(size=(6, chat_format.SHAPES)))
    e, off = rng.normal(size=(8, 6)), np.array([0, 4, 5, 8])
    got = chat_format.viterbi(e, off, model)
    for a, b in zip(off[:-1], off[1:]):
        score = lambda p: model.start[p[0]] + sum(e[a + i, s] for i, s in enumerate(p)) + sum(model.move[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        paths = [[c // 6**i % 6 for i in range(b - a)] for c in range(6 ** (b - a))]
        assert list(got[a:b]) == max(paths, key=score)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    vectors = quality.word_vectors(docs)
    net = quality.train(docs, labels.filter("doc_id % 2 = 0"), vectors)
    rows = quality.classify(docs, net, vectors).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()

    def auc(p, y):
        order = np.argsort(np.argsort(p)) + 1
        y = np.array(y, bool)
        return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())

    print("AUC", auc([r["p_quality"] for r in rows], [r["quality"] for r in rows]), auc([r["p_toxic"] for r in rows], [r["toxic"] for r in rows]))
    print("toxic caught", np.mean([r["p_toxic"] >= 0.5 for r in rows if r["toxic"]]), "clean flagged", np.mean([r["p_toxic"] >= 0.5 for r in rows if not r["toxic"]]), "good kept", np.mean([r["kept"] for r in rows if r["quality"] and not r["toxic"]]))
    assert auc([r["p_quality"] for r in rows], [r["quality"] for r in rows]) > 0.9
    assert auc([r["p_toxic"] for r in rows], [r["toxic"] for r in rows]) > 0.9
    assert np.mean([r["p_toxic"] >= 0.5 for r in rows if r["toxic"]]) > 0.7
    assert np.mean([r["kept"] for r in rows if r["quality"] and not r["toxic"]]) > 0.9
    assert abs(np.mean([r["p_quality"] for r in rows]) - np.mean([r["quality"] for r in rows])) < 0.05


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = ann.neighbours(rows).collect()
    t = rows.orderBy("vec_id").toPandas()
    x, ids = np.stack(t["embedding"]).astype(np.float64), t["vec_id"].to_numpy()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(ids[i], ids[j]) for i in range(len(x)) for j in np.lexsort((ids, -s[i]))[:10]}
    assert len(got) == len(want) and len(want & {(r["vec_id"], r["neighbour_id"]) for r in got}) >= 0.9 * len(want)
    at = {v: i for i, v in enumerate(ids)}
    assert all(abs(s[at[r["vec_id"]], at[r["neighbour_id"]]] - r["score"]) < 1e-5 for r in got)


def test_neighbours_of_the_stated_queries(spark, monkeypatch):
    """op10 in small parts, so that every cell is cut, against brute force."""
    monkeypatch.setattr(ann, "PART_ROWS", 7)
    t = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(t["embedding"]).astype(np.float64), t["vec_id"].to_numpy()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(ids[i], ids[j]) for i in np.flatnonzero(ids % 100 == 0) for j in np.lexsort((ids, -s[i]))[:10]}
    got = {(r["vec_id"], r["neighbour_id"]) for r in ann.op10_ann(spark, SF).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_floors_and_bounds_lose_few_and_open_few():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    codes, ids = ann.Codes(x, x.mean(axis=0), ann.rotation(64)), np.arange(4000)
    q = rng.standard_normal((20, 64))
    s = q @ x.T
    floors = np.sort(s, axis=1)[:, -10]
    a, b, score = ann._best(np.arange(20) + 10_000, q, floors, ids, codes, 10)
    want = {(i + 10_000, j) for i in range(20) for j in np.argsort(-s[i])[:10]}
    assert len(want & set(zip(a, b))) >= 0.9 * len(want)
    estimate, error = codes.estimate(q)
    assert (estimate + error >= floors[:, None]).mean() < 0.25


def test_estimates_keep_to_their_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = ann.Codes(x, x.mean(axis=0), ann.rotation(64))
    estimate, error = codes.estimate(x[:200])
    exact = x[:200] @ x.T
    assert (np.abs(estimate - exact) <= error).mean() > 0.95
    assert abs((estimate - exact).mean()) < 0.01


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=50))
def test_references_survive_packing(refs):
    x = np.sort(np.array(refs, dtype=np.int64))
    assert (exchange.widen(exchange.narrow(x), len(x)) == x).all()


def test_words_are_the_regular_expressions(spark):
    from .brute import words

    texts = ["", None, "Ab1 é-x", "日本 \x00_y", "a\nB", "ÀÉ"]
    w = K.words(pa.array(texts, pa.string()))
    assert list(w.counts) == [len(words(t)) for t in texts]


def test_noise_has_no_language_and_numbers_do_not_count(spark, documents):
    model = language_id.train(documents)
    text = documents.filter("lang = 'en'").first()["text"].split(".")[0]
    rows = [(1, "xkcd qwrtp zzxvb bcdfgh jklmnp qrstvwx zxcvb"), (2, "19 37 4734663219866878"), (3, text + " 19 37 4734663219866878 b64b244a 99")]
    got = {r["doc_id"]: r["language"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}
