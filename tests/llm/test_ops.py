"""Operators of celldag.llm against brute force, exact round trips and held-out labels, with nulls, empties, repeats and long texts."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from celldag.llm import bpe, chat, common, components, decontaminate, fill_middle, html_extract, jaccard_join, langid, licenses, manifest, quality, topk, toxicity, url_filter
from celldag.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, extra string"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i), "s", "x") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


# BPE

def library(text):
    t = Tokenizer.from_file(VOCABULARY)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


ODD = [None, "", "   ", "Hello  World's 123 !!!\n foo_bar <|endoftext|> <|EndOfText|>", "a<|startoftext|>b", "ΣΑΣ İ e\u0301", "naïve café – “x”", "mmmmmm hahahahahahaha zzzzzzzzzzz" * 3, "the" * 2000, "x " * 30000]


def test_bpe_round_trip_equals_the_library(spark, sf_dir):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    found = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts), VOCABULARY).collect()}
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(docs(spark, ODD), VOCABULARY), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        ids, text = library(t)
        r = found[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t
        assert decoded.get(i, text) == text


def test_bpe_exact_merging_all_at_once_and_borders():
    t = bpe.WordBpe.load(VOCABULARY)
    assert t.sound.all() and t.in_order
    rng = random.Random(1)
    words = ["".join(rng.choice("abehinorst") for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    assert t.merge_all(words) == [t.merge(w) for w in words]
    t.learn(words)
    assert all(list(t.known[w]) == t.merge(w) for w in words)


# chat

def test_chat_round_trip_with_control_strings_and_parts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "a[/RO", "<s>\\n", "", "plain"]
    for role, text in itertools.product(["user", "assistant", "tool [/ROLE]", ""], texts):
        made, _, _ = chat.format_turn(role, [{"kind": "text", "text": text}])
        assert chat.parse("<s>" + made) == [(role, text, role == "assistant")]
    made, extra, attached = chat.format_turn("user", [{"kind": "text", "text": "see "}, {"kind": "image", "ref": "i.png", "width": 29, "height": 14}, {"kind": "audio", "ref": "a", "seconds": 0.1}, {"kind": "document", "ref": "d", "pages": 2}])
    assert made == "[ROLE]user[/ROLE][INST]see [IMAGE][AUDIO][DOCUMENT][/INST]"
    assert [(a["ref"], a["at"], a["tokens"]) for a in attached] == [("i.png", 4, 3), ("a", 11, 3), ("d", 18, 512)] and extra == 518


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, 0, None, "[INST]"), (None, 0, "user", "n"), (1, 2, "assistant", "é</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(df.withColumn("parts", chat.text_parts()))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, sha("user\nq\nuser\nq\nassistant\n\nassistant\né</s>\n"), 5, sha("é</s>"))
    assert got[2]["turns_sha256"] == sha("\n[INST]\n") and got[None]["n_turns"] == 1 and set(got) == {1, 2, None}
    assert chat.digests(chat.format_chat(df.limit(0).withColumn("parts", chat.text_parts()))).count() == 0


def test_chat_keeps_large_ids_apart_beside_a_null_one(spark):
    big = 9007199254740992
    rows = [(None, 0, "user", "n", 1), (big, 0, "user", "a", 1), (big + 1, 0, "user", "b", 1), (big + 1, 1, "assistant", "x" * 300000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_chat(df.withColumn("parts", chat.text_parts()))).collect()}
    assert got == {None: 1, big: 1, big + 1: 2}


# language and toxicity

def test_ppm_is_a_code_and_chunks_do_not_matter():
    import pyarrow as pa

    rng = random.Random(0)
    text = "".join(rng.choice("abcab  ") for _ in range(5000)).encode()
    rows = []
    for k in range(3):
        code, n = langid._grams(np.frombuffer(text, np.uint8).astype(np.uint64), k)
        rows += [("l", k, int(c >> np.uint64(8)), int(c & np.uint64(255)), int(m)) for c, m in zip(code, n)]
    m = langid.build_model(pa.Table.from_pylist([dict(zip(("lang", "k", "ctx", "sym", "n"), r)) for r in rows]), 2)
    assert np.allclose((2.0 ** (-m.cost / langid.UNIT)).sum(1), 1, atol=1e-3)
    state, bits = 0, 0
    for b in text:
        bits += int(m.cost[state, b, 0])
        state = int(m.step[state, b])
    assert langid.code_lengths(m, [text, b"", text[:300]])[0, 0] == bits and langid.code_lengths(m, [b""]).tolist() == [[0]]


def test_language_held_out_accuracy_and_edges(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit("x").alias("score"))
    odd = spark.createDataFrame([(-1, None, "en", None, None), (-2, "", None, None, None), (-3, "12 34 !?", "de", None, None), (None, "the and of", None, None, None)], "doc_id long, text string, lang string, source string, score string")
    got = langid.identify(table.unionByName(odd)).collect()
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(truth) + 4 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (-1, -2, -3)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_finds_insults_in_held_out_documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiourstn") for _ in range(5)) for _ in range(300)]
    bad = ["scumword", "trashword", "idiotword"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[7], text[30] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(text), None, None, None))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(rows + [(-1, None, None, None, None), (-2, "", None, None, None)], DOCS)
    got = {r["doc_id"]: r for r in toxicity.classify(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 902 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[i]["predicted"] == (i % 8 == 0) for i in range(900) if got[i]["held_out"]]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.classify(table, empty).collect()} == {0}


# top-k

def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    x[100:160] = x[100]
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(700)] + [(0, [float(np.float32(v)) for v in x[0]]), (9000, None), (9050, [1.0, None]), (9100, [float("nan")] * 8), (9150, [1.0, 2.0]), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.exact_topk(df, F.col("id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 700, 50):
        s = ints @ ints[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    assert set(got) == set(range(0, 700, 50))


def test_topk_takes_large_components_and_reads_less_with_a_bound(spark):
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(300, 16)) * 1e9)
    df = spark.createDataFrame([(i, [float(v) for v in r], "s") for i, r in enumerate(x)], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in topk.exact_topk(df, F.col("id") % 50 == 0, scale=1).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [[int(v) for v in r] for r in x]
    for q in range(0, 300, 50):
        s = [max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(r, whole[q])))) for r in whole]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5])]
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in topk.exact_topk(huge, F.col("id") == 0).orderBy("rank").collect()] == [(1, topk.LONG), (3, 0), (2, -topk.LONG)]
    assert topk.exact_topk(huge.limit(0), F.col("id") == 0).count() == 0
    ids, few = np.arange(2000), np.floor(rng.normal(size=(2000, 8)) * 100)
    plain, bounded = (topk.search_block(ids, few, ids[:40], few[:40], 3, least) for least in (None, np.sort(few @ few[:40].T, axis=0)[-4]))
    assert bounded[3] <= plain[3] < 40 * few.size and [a.tolist() for a in plain[:3]] == [a.tolist() for a in bounded[:3]]


def test_topk_over_several_blocks_of_candidates(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = sorted(map(tuple, topk.exact_topk(table, F.col("id") % 50 == 0).collect()))
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    assert sorted(map(tuple, topk.exact_topk(table, F.col("id") % 50 == 0).collect())) == one


# HTML and URLs

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="post content"><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies to do things for you.</div><article><header><h1>Title</h1></header><p><b>One &eacute;&nbsp; two<br>three <p>To.</p><div class=ad>Buy this great thing now.</div>
<script>var t="</p>";</script><!-- <p>no</p> --><ul><li>item one<li>item <a href=x>two</a></ul><section id=comments><p>Great post, I love it.</p></section></article><aside>Related things here</aside><form><label>Mail</label></form><footer>&copy; me</footer></body>"""


def test_html_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "word " * 50000), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_extract.extract(df).collect()
    assert sum(r["text"] == "Title\n\nOne é two three\n\nTo.\n\nitem one\n\nitem two" for r in got) == 2
    by_id = {r["page_id"]: r for r in got}
    assert by_id[2]["text"] == "" and by_id[3]["n_chars"] == 0 and by_id[4]["n_chars"] == 50000 * 5 - 1


@pytest.mark.parametrize("tag", ["svg", "object", "template", "noscript"])
def test_html_unclosed_and_nested_elements_take_no_article_along(tag):
    tree = html_extract.train()
    of = lambda page: html_extract.main_text(page, tree)
    article = "<article><h1>Title</h1><p>One two three four.</p><p>Five six seven.</p></article>"
    want = of(article)
    assert want == "Title\n\nOne two three four.\n\nFive six seven."
    for before in (f"<{tag}>", f"<div><{tag} width=3></div>", f"<p>x <{tag}><g>", f"<{tag}>label<{tag}>in</{tag}>"):
        assert want in of(before + article), before
    assert of(f"<{tag}>a<{tag}>b</{tag}><p>inside the outer element still</p></{tag}>" + article) == want
    assert of(article.replace("Five", f"<{tag}>no <p>no</p></{tag}>Five")) == want
    assert of(f"<{tag}/>" + article) == want and of(article + f"<{tag}>") == want
    assert of("<script>" + article) == ""


def test_html_tree_needs_counts_and_surroundings():
    table = np.array(html_extract.labelled_blocks(200, seed=5), float)
    x, y = table[:, :-1], table[:, -1] > 0.5
    right = lambda rows, drop: np.mean((html_extract.train([(*r[:-1], r[-1]) for r in rows]).predict(np.where(np.isin(np.arange(x.shape[1]), drop), 0, x)) >= 0.5) == y)
    known = np.array(html_extract.labelled_blocks(600, seed=11), float)

    def without(drop):
        rows = known.copy()
        rows[:, drop] = 0
        return right(rows, drop)

    dealt, around = list(range(html_extract.DEALT)), list(range(html_extract.DEALT, x.shape[1]))
    whole = without([])
    assert whole > 0.97 and whole - without(dealt) > 0.02 and whole - without(around) > 0.05
    assert html_extract.train().feature < html_extract.DEALT


TEXT = "<h1>Title here</h1><p>One two three four five six seven eight nine ten eleven.</p><p>Five six seven.</p><p>Another rather long paragraph with more than ten words stands here now.</p>"


@pytest.mark.parametrize(
    "around",
    [
        "<article class='post category-comment'>%s</article>", "<article class='search-engine-post'>%s</article>", "<div class='page search-results-off'><article>%s</article></div>", "<div class=banner><main>%s</main></div>",
        "<form id=aspnetForm><article>%s</article></form>", "<form id=aspnetForm><nav><a href=x>Menu</a></nav><div class=content>%s</div></form>", "<form id=f>%s</form>",
        "<article>%s</article><section class=comments><article class=c1><p>Great, I like this post so very much, thanks to the author of it.</p></article></section>",
        "<article>%s<form class=newsletter><p>Sign up for our letter and get it each week by mail, free of charge.</p><p>We never share it.</p></form></article>",
        "<article>%s</article><div class='comment-list'><p>Great, I like this post so very much.</p></div><div id=relatedPosts><a href=x>Other</a></div>",
    ],
)
def test_html_names_and_forms_around_the_text_take_nothing_along(around):
    tree = html_extract.train()
    assert html_extract.main_text(around % TEXT, tree) == html_extract.main_text(f"<article>{TEXT}</article>", tree) == "\n\n".join(re.findall(r">([^<]+)</", TEXT))


def test_html_parts_of_the_text_stay():
    of = lambda page: html_extract.main_text(page, html_extract.train())
    assert of("<article>" + TEXT + "<section id=related-work><h2>Related work</h2><p>Others did it.</p></section><p class=legal-history>Old law.</p></article>").endswith("now.\n\nRelated work\n\nOthers did it.\n\nOld law.")
    assert of("<article>" + TEXT + "<p>Let <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math> hold.</p></article>").endswith("\n\nLet x = 1 hold.")
    links = "<ul><li><a href=a>First report</a></li><li><a href=b>Second</a></li><li><a href=c>The third of the reports</a></li></ul>"
    assert of(f"<nav>{links}</nav><article>{TEXT}{links}<p>Then a paragraph that is again of some length, more than ten words.</p></article>").count("First report\n\nSecond\n\nThe third") == 1


def test_html_pages_without_telling_elements_are_decided_by_counts():
    tree, long = html_extract.train(), "<p>Then a paragraph that is again of some length, more than ten words.</p>"
    menu = "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "News", "Sport", "Contact us"))
    page = f"<div><ul>{menu}</ul></div><div>{long}<p>Ok.</p>{long}<p>Read more in <a href=b>the full report of 2019</a></p>{long}</div><div><a href=x>Imprint</a></div>"
    blocks = html_extract.Flattener().run(page)
    x = html_extract.features(blocks)
    alike = (x[:, html_extract.DEALT :] == 0).all(axis=1)  # nothing but counts and densities tells these apart
    assert alike.sum() == 6 and set(tree.predict(x[alike]) >= 0.5) == {True, False}
    got = html_extract.main_text(page, tree)
    assert "words.\n\nOk.\n\nThen" in got and "Read more in the full report of 2019" in got and "Sport" not in got and "Imprint" not in got


@pytest.mark.parametrize("page", ["<div>" * 20000 + "</x>" * 20000, '<a "' * 100000, '<a "' * 20000 + ">", "<b>" * 50000 + "x", "<svg>" * 20000 + "<p>a", "<li>" * 100000, "<" * 500000])
def test_html_odd_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    html_extract.main_text(page, html_extract.train())
    assert time.process_time() - began < 15


def test_html_edges(spark):
    df = spark.createDataFrame([(None, None, "<p>" + "one two three four five six seven eight nine ten eleven. " * 3, 5), (7, "u", "a < b and c > d", 5)], "page_id long, url string, html string, text long")
    got = html_extract.extract(df).collect()
    assert {r["page_id"] for r in got} == {None, 7} and got[0]["n_chars"] == len(got[0]["text"]) and html_extract.extract(df.limit(0)).count() == 0


def test_url_trees_on_hosts_they_have_not_seen():
    model = url_filter.default_model()
    score = lambda urls: model.score(np.array([url_filter.features(u, model.suffixes) for u in urls], float))
    good = ["http://www.blue-river-news.example.org/en/3", "http://my-garden-blog.example.com/de/44.html", "http://city-library.example.org/", "http://thoran.example.com/en/49082/", "https://docs.example.com/2021/05/how-to-sort", "", None]
    bad = ["http://xyzporn.example.net/en/3", "http://best-online-casino.example.org/fr/2", "http://q8z7x1kk4w.example.com/a1/b2/c3?x=19&y=22&z=38&k=4", "http://mycasino.example.com/en/7"]
    assert (score(good) < 0.5).all() and (score(bad) >= 0.5).all()
    urls, blocked = url_filter.labelled_urls(400, seed=31)
    x, y = np.array([url_filter.features(u, model.suffixes) for u in urls], float), np.array(blocked) == 1
    whole = np.mean((model.score(x) >= 0.5) == y)
    used = {url_filter.NAMES[n[0]] for tree in model.trees for n in tree if n[0] >= 0}
    assert whole > 0.96 and used >= {"length", "depth", "digits", "entropy", "parameters", "suffix_rate"}
    shape = [url_filter.NAMES.index(n) for n in ("length", "depth", "path_length", "digits", "entropy", "parameters", "query_length", "odd_pairs", "host_entropy", "host_digits")]
    flat = x.copy()
    flat[:, shape] = np.median(x[~y][:, shape], axis=0)
    assert whole - np.mean((model.score(flat) >= 0.5) == y) > 0.03  # suffixes alone do not decide


def test_url_words_are_whole_words():
    model = url_filter.default_model()
    score = lambda urls: model.score(np.array([url_filter.features(u, model.suffixes) for u in urls], float))
    # Public sites; the names of the first ones begin with letters of words to block.
    good = """https://www.winter-sports.de/ http://seoul.go.kr/main https://hackney.gov.uk/ https://www.winnipeg.ca/parks https://freedom.org/history https://adultlearning.org/ https://www.credit-suisse.com/
    https://en.wikipedia.org/wiki/Betting https://docs.python.org/3/library/re.html https://www.bbc.co.uk/news/world-12345 https://stackoverflow.com/questions/11227809/why https://github.com/apache/spark
    https://www.lemonde.fr/planete/article/2020/01/ https://www.nature.com/articles/s41586""".split()
    bad = "https://casinobonus.com/ http://cheap-viagra-pills.biz/buy http://xxxporn.net/ http://payday-loans24.top/ http://warezkeygen.click/a http://onlinecasino777.com/".split()
    assert (score(good) < 0.5).all() and (score(bad) >= 0.5).all()
    words = {"win", "hack", "casino", "bonus", "sex", "pills", "poker"}
    of = lambda name: url_filter.cover(name, words)
    assert of("casinobonus") == ["casino", "bonus"] and of("winter") == ["winter"] and of("hackney") == ["hackney"] and of("spills") == ["spills"] and of("mypoker") == ["my", "poker"] and of("") == [""]


def test_url_shares_leave_the_own_host_out():
    hosts = [f"{w}-{i}.com" for i in range(4) for w in ("alpha", "omega")] + ["alpha.org"]
    blocked = np.array([1, 0] * 4 + [0], float)
    whole, rest = url_filter.Suffixes.count(hosts, blocked)
    assert whole.words == {"alpha", "omega"} and whole.rate["alpha"] == (4 + 3 * whole.base) / 8 and rest[0].rate["alpha"] == (3 + 3 * whole.base) / 7
    assert rest[8].rate["alpha"] == (4 + 3 * whole.base) / 7 and ".org" not in rest[8].rate and ".org" in whole.rate


def test_url_edges(spark):
    df = spark.createDataFrame([(1, "http://a.test/x", "z"), (1, "http://a.test/x", "z"), (None, None, None)], "page_id long, url string, host string")
    got = url_filter.judge(df).collect()
    assert len(got) == 3 and sum(r["host"] == "a.test" for r in got) == 2 and url_filter.judge(df.limit(0)).count() == 0


def test_url_rules_and_trees(spark):
    urls = ["http://m.Example.COM/en/77?x", "http://com/en/7", "http://a.example.com/en/8", "ftp://x.net/de/9#a", "http://b.example.net/de/81", "http://notexample.net/de/8", "http://x.org/es/", None, "no scheme", "http://cheap-pills.example.com/fr/3", "http://heron.example.com/fr/3", "x://y://z"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1] + rule[2])
        assert got[i]["verdict"] == (rule[0] if rule else "block" if got[i]["score"] >= 0.5 else "allow")
    assert got[0]["verdict"] == "allow" and got[4]["verdict"] == "block" and got[9]["verdict"] == "block" and got[10]["verdict"] == "allow"


def test_guesses_of_many_words_equal_those_of_one():
    import public_tokenizers

    words = bpe.WordBpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    letters = [c for c in words.bytes if c != "\0"]
    some = ["".join(rng.choice("etaoinshr" if rng.random() < 0.5 else letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    some += [n.removesuffix(words.suffix) for n in rng.sample(sorted(words.vocab), 2000)]
    some = [w for w in some if w]
    assert words._guess_all(some) == [words._guess(w) or [] for w in some] and words._guess_all([]) == []


def test_ascii_words_split_like_all_words():
    import regex

    every, plain = regex.compile(bpe.WORD), bpe._ascii_words()
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(chr(rng.randrange(128)) if rng.random() < 0.3 else rng.choice("'strevmld 1a\n") for _ in range(20)).lower()
        assert plain.findall(text) == every.findall(text)


# decontamination

def test_tiles_are_greedy_and_do_not_overlap():
    rng = random.Random(2)
    for _ in range(60):
        a = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 25))])
        b = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 40))])
        found = decontaminate.tiles(a, b, 2)
        ma, mb = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for i, j, n in found:
            assert (a[i : i + n] == b[j : j + n]).all() and not ma[i : i + n].any() and not mb[j : j + n].any()
            ma[i : i + n] = mb[j : j + n] = True
        longest = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if (a[i : i + n] == b[j : j + n]).all() and (b[j : j + n] > 0).all()), default=0)
        assert (found[0][2] if found else 0) == (longest if longest >= 2 else 0)
        assert not any((a[i : i + 2] == b[j : j + 2]).all() and b[j] > 0 and not ma[i : i + 2].any() and not mb[j : j + 2].any() for i in range(len(a) - 1) for j in range(len(b) - 1))


def test_reordered_passages_leak_and_clean_text_stays(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    item = [rng.choice(words) for _ in range(40)]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{noise(50)} {' '.join(item[20:])} {noise(9)} {' '.join(item[:20]).upper()}, {noise(5)}", noise(3000), " ".join(item[:12]), None, "", f"{noise(60000)} {' '.join(item)}", "only three words"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "three words"), (3, None), (4, ""), (1, " ".join(item))], "item_id long, text string")
    table = docs(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(table, bench).collect()}
    assert set(got) == {(0, 1), (5, 1), (6, 2)} and got[0, 1]["coverage"] == 1.0 and len(got[0, 1]["tiles"]) >= 2
    assert {r["doc_id"] for r in decontaminate.clean(table, bench).collect()} == {1, 2, 3, 4}
    assert decontaminate.clean(table, bench).columns == table.columns
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0


def test_long_runs_leak_and_bare_occurrences_of_short_items_do_not(spark):
    words = ["q%d" % i for i in range(200)]
    long, medium = " ".join(words), " ".join("m%d" % i for i in range(59))
    texts = [f"lead in {' '.join(words[50:150])} and out", f"a {' '.join(medium.split()[3:38])} b", " ".join(words[60:85]) + " end", f"x {' '.join(words[9:38])} y {' '.join(words[110:139])}", "we said yes and went home again", "Yes!", "of course yes"]
    bench = spark.createDataFrame([(1, long), (2, medium), (3, "yes"), (4, "of course")], "item_id long, text string")
    table = docs(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()}
    assert got == {(0, 1), (1, 2), (5, 3), (6, 4)}
    assert {r["doc_id"] for r in decontaminate.clean(table, bench).collect()} == {2, 3, 4}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench, min_run=25).collect()} == got | {(2, 1), (3, 1)}


def test_leaks_equal_all_pairs_by_brute_force(spark):
    rng = random.Random(8)

    def brute(a, b, k):  # one longest match at a time
        ma, mb, found = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < k:
                return found
            ma |= set(range(i, i + n))
            mb |= set(range(j, j + n))
            found.append(n)

    word = lambda: "v%d" % rng.randrange(300)
    items = [[word() for _ in range(rng.randint(1, 60))] for _ in range(12)] + [["v7"], ["v8", "v9"], []]
    texts = []
    for _ in range(40):
        text = [word() for _ in range(rng.randint(0, 20))]
        for item in rng.sample(items, 2):
            pieces = [item[i : i + 12] for i in range(0, len(item), 12)]
            rng.shuffle(pieces)
            text += [w for p in pieces[: rng.randint(0, len(pieces))] for w in [*p, word()]]
        texts.append(text)
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            if item and text:
                tiles = brute(item, text, min(5, len(item)))
                covered, longest = sum(tiles), max(tiles, default=0)
                if covered >= 0.6 * (len(item) if len(item) >= 5 else max(len(item), len(text))) or (longest >= 30 and len(item) >= 5):
                    want.add((d, i, covered))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["covered_words"]) for r in decontaminate.leaks(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert got == want and len(want) > 10


# near duplicates

def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_jaccard_components_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", "  \t", "one two", "One  TWO", "a b c d e", "a b c d e f", "É é", "é É"]
    for _ in range(60):  # near copies of one text, some linked only by way of others
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 15
    texts += [f"{passage} {' '.join(rng.choice(words) for _ in range(rng.randint(3, 30)))}" for _ in range(40)]
    texts += [" ".join(rng.choice(words) for _ in range(100)) for _ in range(60)] + ["z " * 5000]
    sizes, roots = brute_components(texts)
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots


def bridged():
    """Three texts, of which the first and last link with the second only."""
    words = ["b%d" % i for i in range(300)]
    first, last = list(words), list(words)
    first[20] = first[60] = first[100] = first[140] = "x"
    last[180] = last[220] = last[260] = last[290] = "y"
    return [" ".join(w) for w in (first, words, last)]


def test_text_without_id_links_documents(spark):
    one, bridge, two = bridged()
    assert brute_components([one, bridge, two])[1] == [0, 0, 0] and brute_components([one, two])[1] == [0, 1]
    table = spark.createDataFrame([(1, one), (None, bridge), (None, bridge), (3, two), (None, "alone here")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(table).collect()), key=str)
    assert got == [(1, 1), (3, 1), (None, 1), (None, 1), (None, None)]


def test_pipeline_near_duplicates_go_by_row(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6)) for _ in range(30)) for _ in range(6)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[4]), (None, texts[1]), (None, texts[5]), (4, texts[5]), (None, None), (None, None), (4, None)]
    table = spark.createDataFrame([(i, t, None, None, "x") for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, table, sf_dir).collect()), key=str)
    assert got == sorted([(1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4]), (4, texts[5]), (None, None), (4, None)], key=str)


def test_a_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for x in [disk.getAllFiles()] for f in map(x.apply, range(x.size())) if f.getName().startswith("shuffle_")}
    before, wide = files(), spark.range(2000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s"))
    kept = common.cut(wide)
    until = time.time() + 20
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, wide.collect())) and spark.conf.get(common.CLEANUP) == "false"


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# licenses

def test_license_edges(spark):
    gpl = dict(licenses.NOTICES)["GPL-3.0"]
    texts = [None, "", "x " * 2000 + gpl.upper().replace(" ", "\n") + " y" * 99, "Released under the MIT License", "released under the", " ".join(gpl.split()[:20])]
    table = docs(spark, texts)
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(table.unionByName(table)).collect()}
    assert got >= {(2, "GPL-3.0"), (3, "MIT")} and {d for d, _ in got} == {2, 3}
    assert licenses.scan(table.limit(0)).count() == 0


def test_license_texts_on_rows_without_id_match_the_sql(spark, tmp_path):
    import duckdb

    mit, gpl = dict(licenses.NOTICES)["MIT"], dict(licenses.NOTICES)["GPL-3.0"]
    rows = [(None, mit), (None, mit), (None, f"x y z {gpl}"), (None, "no notice in this text at all"), (None, None), (1, mit), (2, "plain words of a document")]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = licenses.scan(table)
    assert {r["license_id"] for r in found.where("doc_id is null").collect()} >= {"MIT", "GPL-3.0"}
    assert_same(found, con, licenses.ORACLE)


def test_license_scan_runs_no_python(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# all queries

@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op7_jaccard_join", "op8_language_id", "op2_bpe"}))
def test_each_query_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs_now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 3", "en", "s", 4), (0, docs_now.where("doc_id = 0").first()["text"], "fr", "src0", 1)], docs_now.schema)
    docs_now = docs_now.unionByName(odd)
    before = docs_now
    for name, stage in corpus_pipeline.STAGES:
        after = spark.read.parquet(corpus_pipeline._written(stage(spark, before, sf_dir)))
        if name != "bpe":
            assert after.columns == docs_now.columns
            assert after.exceptAll(before).count() == 0
        if name == "language_id":
            assert {r[0] for r in before.exceptAll(after).select("doc_id").collect()} >= {10**6, 10**6 + 1}
        if name == "ngram_jaccard_join":
            by_id = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(before).collect()}
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(set(by_id.values()))
        before = after
    assert before.count() > 100 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(before.columns)


def test_pipeline_stages_keep_columns_that_clash(spark, sf_dir):
    import corpus_pipeline

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["score", "lang_pred", "bits_per_byte", "foreign", "predicted", "id", "stays", "row", "root", "__row", "found"]
    table = table.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, table, sf_dir)
        assert after.columns == table.columns and after.first()["stays"] == 6
    assert corpus_pipeline.tokens(spark, table, sf_dir).count() == table.count()


def test_toxicity_learns_one_row_of_a_repeated_id(spark):
    rows = [(1, f"fine words number {i}", None, None, None) for i in range(500)] + [(i, f"awful scum {i}", None, None, None) for i in range(2, 60)]
    labels = spark.createDataFrame([(i, 1, int(i > 1)) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == len(rows)


def test_language_learns_a_bounded_number_of_languages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(langid.train(table, max_langs=2).langs) == 2


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 3,
    "Kila mtu ana haki ya kuishi na kuwa huru na kulindwa nafsi yake wala hakuna mtu atakayeteswa", "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler",
    "人人生而自由", "人人生而自由在尊严和权利上一律平等", "Все люди рождаются свободными", "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 9,
]


def test_pipeline_drops_foreign_documents_of_any_length_and_keeps_digits(spark, sf_dir):
    import corpus_pipeline

    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digits = ["of.92@mail6.example.com 5755695738806562 Of the 12 and 0x77 99 31 the.", "the 1234567890 / 1234567890 / 1234567890"]
    texts = dict(enumerate(FOREIGN + digits, 10**6))
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], own.schema)
    kept = {r[0] for r in corpus_pipeline.language_id(spark, own.unionByName(odd), sf_dir).select("doc_id").collect()}
    assert {i for i in texts if i in kept} == set(list(texts)[len(FOREIGN) :])
    assert sum(i in kept for i in range(10**6)) >= 0.99 * own.count()


def test_benchmark_in_several_blocks_gives_the_same(spark, sf_dir, monkeypatch):
    table, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r["doc_id"], r["item_id"], r["covered_words"]) for r in decontaminate.leaks(table, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4000)
    several = {(r["doc_id"], r["item_id"], r["covered_words"]) for r in decontaminate.leaks(table, bench).collect()}
    assert one == several and decontaminate.clean(table, bench).count() == table.count() - len({d for d, _, _ in one})


def test_shuffled_texts_give_the_same_components(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, jaccard_join.near_duplicates(table).collect()))
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "FLUSH", 5000)
    monkeypatch.setattr(jaccard_join, "FRAGMENT", 1000)
    assert sorted(map(tuple, jaccard_join.near_duplicates(table).collect())) == one

# fill in the middle

def brute_fim(doc_id, text, salt="1:"):
    text = text or ""
    n = len(text)
    hx = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hx[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_equals_brute_force_and_restores(spark):
    texts = [None, "", "a", "<", "<P", "P>x<S", "a\r\n b\n\n", "é😀𝄞" * 50, "has <P> in it", "has <M>", "x" * 300_000, "a<" * 500, "S>" * 500, "\\E\\Q$1", "same", "same"]
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts * 6)] + [(None, "no id"), (3, "twice"), (3, "twice"), (2**62, "far")]
    df = spark.createDataFrame([(i, t, "u", 5) for i, t in rows], "doc_id long, text string, n string, form int")
    found = sorted(map(repr, (tuple(r) for r in fill_middle.arrange(df).select("doc_id", "n", "form", "prefix_units", "middle_units", "output").collect())))
    assert found == sorted(repr((i, *brute_fim(i, t))) for i, t in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fill_middle.digests(df).collect())
    assert got == Counter((i, sha(brute_fim(i, t)[-1]), sha(t or "")) for i, t in rows)
    assert fill_middle.digests(df.limit(0)).count() == 0
    forms = {brute_fim(i, t)[1] for i, t in rows}
    assert forms == {"plain", "psm", "spm"}


def test_fill_middle_by_words_with_other_marks(spark):
    marks = fill_middle.Sentinels("[pre]", "[suf]", "[mid]")
    text = "one two\n three  four five" * 20
    made = fill_middle.arrange(spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string"), unit=r"\s*\S+\s*", marks=marks)
    rows = made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and all(r["back"] == text for r in rows)
    assert all(r["prefix"] + r["middle"] + r["suffix"] == text for r in rows if r["form"] != "plain")
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "c", "d"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fill_middle.Sentinels(*bad)


def test_fill_middle_has_no_python_and_no_exchange(spark, sf_dir):
    plan = QUERIES["op11_fill_middle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


# quality

def junk(rng, kind, n):
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "***", "&&&"]) for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[: n // 8 + 1] for _ in range(8))


def prose(rng, n):
    return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(1, 9))).capitalize() if i % 12 == 0 else "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(1, 9))) + ("." if i % 12 == 11 else "") for i in range(n))


def quality_tables(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        poor = i % 5 == 0
        # Every second poor text is good but for a part in its middle.
        text = (prose(rng, 150) + "\n" + junk(rng, i // 5 % 4, 60) + "\n" + prose(rng, 150)) if poor and i % 2 else junk(rng, i // 5 % 4, rng.randint(20, 200)) if poor else prose(rng, rng.randint(20, 400))
        rows.append((i, text, "x", 0.5, int(not poor)))
    return spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, score string, predicted double"), spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int"), {r[0]: r[4] for r in rows}


def test_quality_of_held_out_texts_and_junk_in_a_part(spark):
    df, labels, truth = quality_tables(spark)
    found = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in set(held)) for i in truth) and len(held) > 40
    assert sum(found[i]["predicted"] != truth[i] for i in held) <= 1
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found.values())


def test_quality_never_reads_held_out_labels(spark):
    df, labels, truth = quality_tables(spark, 120)
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.classify(df, labels).collect())) == sorted(map(tuple, quality.classify(df, other).collect()))


def test_quality_odd_rows_and_labels(spark):
    df, labels, _ = quality_tables(spark, 100)
    odd = spark.createDataFrame([(None, "some text", "a", 1.0), (1000, None, None, None), (1001, "", None, None), (1002, "word " * 100_000, None, None), (1003, "same", None, None), (1003, "same", None, None), (1004, "😀" * 9, None, None)], df.schema)
    both = df.unionByName(odd)
    rows = quality.classify(both, labels.unionByName(spark.createDataFrame([(None, 1), (1000, None), (1003, 1), (1003, 0), (77777, 0)], labels.schema))).collect()
    assert len(rows) == 107 and all(0 <= r["score"] <= 1 for r in rows)
    one = [r for r in rows if r["doc_id"] == 1003]
    assert one[0] == one[1]
    empty = [r["score"] for r in rows if r["doc_id"] in (1000, 1001)]
    assert empty[0] == empty[1]
    assert quality.classify(df.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(df, labels.where("quality = 1")).collect()} == {1.0}
    model = quality.train(df, labels)
    kept = quality.score(both, model, keep=tuple(both.columns), prefix="__")
    assert kept.columns == [*both.columns, "__score", "__predicted"] and kept.count() == 107


def test_bradley_terry_gradient_and_quantile():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    better, worse = rng.integers(0, 30, 200), rng.integers(0, 30, 200)
    risk = lambda w: np.logaddexp(0, -((x[better] - x[worse]) @ w)).mean() + 1e-3 / 2 * w @ w
    w = quality.fit_pairs(x, better, worse, steps=3000)
    for i in range(4):  # a minimum: no step to either side is better
        for d in (1e-3, -1e-3):
            assert risk(w) <= risk(w + d * np.eye(4)[i]) + 1e-9
    s = np.array([3.0, 1.0, 2.0, 4.0])
    assert quality.quantile_between(s, np.ones(4), 0.5) == 2.5
    assert quality.quantile_between(s, np.array([1.0, 7.0, 1.0, 1.0]), 0.7) == 1.5
    assert quality.quantile_between(np.ones(5), np.ones(5), 0.4) == 1.0


# manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout=3):
    """Rows (doc_id, source, lang, n_chars, text) to Counter of result rows, by lists."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*[enc(v) for v in (*r[:4], t)])
    groups = defaultdict(list)
    for r in rows:
        h = leaf(r, r[4])
        tampered = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        other = leaf(r, tampered)
        groups[r[1]].append(((r[0] is not None, r[0] or 0), h, other if other != h else "", r[0]))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def sides(levels, i):
        out = []
        for level in levels[:-1]:
            a = i - i % fanout
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
            i //= fanout
        return out

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    over = tree([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for i, (_, h, other, doc_id) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = sides(trees[g], i) + sides(over, k)
            folded = other or h
            for a, b in path:
                folded = H(a, folded, b)
            out[doc_id, h, trees[g][-1][0], over[-1][0], H(*[x for s in path for x in s]), folded, folded == over[-1][0]] += 1
    return out


def found_manifest(spark, rows, **params):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int")
    made = manifest.manifest(df, tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0, **params)
    assert made.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, made.collect()))


def manifest_rows():
    rng = random.Random(5)
    far = [0, 1, 2, 255, 256, 257, -1, -256, -257, 2**63 - 1, -(2**63), 2**40, 10**12]
    rows = [(i, f"s{i % 3}", "en", 3, f"text {i}\nline") for i in rng.sample(range(10**6), 700)]
    rows += [(i, s, None, None, t) for i in far for s in ("s1", None, "", "é", "ábc", "Z", "z\n") for t in (None, "", "a\nb")]
    rows += [(5, "copies", "en", 1, "equal\n")] * 40 + [(None, "copies", "en", 1, "no id")] * 3 + [(None, "copies", None, None, None), (1, "alone", "en", 9, "x\n" * 50_000)]
    rng.shuffle(rows)
    return rows


def test_manifest_equals_brute_force(spark, monkeypatch):
    rows = manifest_rows()
    wanted = brute_manifest(rows)
    assert found_manifest(spark, rows) == wanted
    assert {w[-1] for w in wanted} == {True, False}
    # Small blocks and small buckets: many rounds, and repeated ids ranked by hash.
    monkeypatch.setattr(manifest, "CROWDED", 2)
    monkeypatch.setattr(manifest, "LOCAL_GROUPS", 1)
    assert found_manifest(spark, rows, levels=2) == wanted


def test_manifest_other_fanout_one_row_and_no_row(spark):
    rows = manifest_rows()[:60]
    assert found_manifest(spark, rows, fanout=2, levels=3) == brute_manifest(rows, 2)
    assert found_manifest(spark, rows[:1]) == brute_manifest(rows[:1])
    assert found_manifest(spark, rows[:0]) == Counter()


def test_manifest_of_groups_with_a_long_common_name(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LOCAL_GROUPS", 4)
    names = [f"https://example.org/{'x' * (i % 4)}{i * 37 % 101}" for i in range(90)]
    ranks = {r["g"]: r["rank"] for r in manifest.group_ranks(spark.createDataFrame([(n,) for n in set(names)], "g string")).collect()}
    assert [ranks[n] for n in sorted(set(names))] == list(range(len(set(names))))


def _greedy(a, b, least):
    """Greedy string tiling by trying all pairs of places, the longest match first, then by place."""
    ma, mb, out = [False] * len(a), [x <= 0 for x in b], []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = i, j, n
        if best is None:
            return out
        i, j, n = best
        ma[i : i + n] = mb[j : j + n] = [True] * n
        out.append(best)


def test_tiles_equal_plain_greedy_tiling():
    rng = random.Random(8)
    for _ in range(150):
        letters, least = rng.randint(1, 4), rng.randint(1, 4)
        a = [rng.randint(1, letters) for _ in range(rng.randint(1, 22))]
        b = [rng.randint(0, letters) for _ in range(rng.randint(1, 34))]
        assert decontaminate.tiles(np.array(a), np.array(b), least) == _greedy(a, b, least)


def test_words_repeated_thousands_of_times_take_little_memory():
    import tracemalloc

    n = 20_000
    texts = ["same " * n, "same " * (n - 7) + "other " + "same " * (n // 2), ("same " * 9 + "other ") * (n // 10), "nothing of it"]
    block = decontaminate.Block([(1, "same " * n), (2, ("same " * 8 + "x ") * (n // 9)), (3, "same same")], 5, 0.6, 30)
    tracemalloc.start()
    got = {(row, block.names[which]) for row, which, _, _ in block.search(texts)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(0, 1), (1, 1), (2, 1), (0, 2), (1, 2), (2, 2)} <= got and not any(row == 3 for row, _ in got)
    assert peak < 64 << 20


def test_thirty_languages_are_all_predicted(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(40)] for i in range(30)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(80)), lang, None, None) for i, lang in enumerate(sorted(words) * 20)]
    table = spark.createDataFrame(rows, DOCS)
    got = langid.identify(table, max_cells=9000).where("held_out").select("doc_id", "lang_pred").collect()
    assert {r["lang_pred"] for r in got} == set(words) and np.mean([rows[r["doc_id"]][2] == r["lang_pred"] for r in got]) > 0.95


def test_notice_too_short_for_a_shingle_is_refused(spark):
    with pytest.raises(ValueError, match="fewer than 5 words"):
        licenses.scan(docs(spark, ["x"]), [("short", "All rights reserved.")])


def test_language_counts_all_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 30))) for _ in range(900)]
    table = docs(spark, texts, {i: "xy"[i % 2] for i in range(900)})
    monkeypatch.setattr(langid, "SLICE", 300)
    seen = []
    monkeypatch.setattr(langid, "build_model", lambda rows, order: seen.append(rows))
    langid.train(table, order=2, min_count=0, max_contexts=10**6)
    expected = Counter()
    for i, t in enumerate(texts):
        for k in range(3):
            for code, n in zip(*(x.tolist() for x in langid._grams(np.frombuffer(t.encode(), np.uint8).astype(np.uint64), k))):
                expected["xy"[i % 2], k, code >> 8, code & 255] += n
    assert {(r["lang"], r["k"], r["ctx"], r["sym"]): r["n"] for r in seen[0].to_pylist()} == expected
    # Tasks that hand on what they hold early find the same.
    monkeypatch.setattr(langid, "HELD", 50)
    assert {tuple(r)[:4]: r["n"] for r in langid.context_counts(table, 2).collect()} == expected


def test_language_limits_take_all_held_out_texts(spark):
    plain = "the cat sat on the mat and the dog ran to the old barn in the rain"
    model = langid.train(docs(spark, [plain] * 30, {i: "en" for i in range(30)}))
    odd = docs(spark, [plain] * 2500 + ["zq xv wj kq"], {i: "en" for i in range(2501)})
    low, high = (langid.letter_limits(df, model, quantile=1.0)[3, 0] for df in (odd.where("doc_id < 2500"), odd))
    assert high > low + 1
    for t in ("", "a", "Ünder 3x " * 500, plain * 80, "ΣΑΣ " * 700):
        whole = langid.letter_runs(t)
        assert whole.startswith(langid.first_letter_runs(t)) and len(langid.first_letter_runs(t)) >= min(len(whole), langid.LENGTHS[-1])


def test_workers_let_go_of_what_other_operators_keep():
    from celldag.llm import common

    words = bpe._tokenizer(VOCABULARY)
    assert list(common.frugal(iter, keeps=VOCABULARY)([1])) == [1] and bpe._tokenizer(VOCABULARY) is words
    assert list(common.frugal(iter)([1])) == [1] and bpe._tokenizer(VOCABULARY) is not words
    assert common.frugal_group(lambda t: t)(1) == 1 and not common._kept


def test_quality_learns_from_all_labelled_texts_in_groups(spark, monkeypatch):
    df, labels, truth = quality_tables(spark, 300)
    read = []
    whole = quality._written
    monkeypatch.setattr(quality, "_written", lambda d: read.append(whole(d)) or read[-1])
    monkeypatch.setattr(quality, "GROUP", 10)
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    model = quality.train(df, labels)
    teach = [i for i in truth if zlib.crc32(str(i).encode()) % 5]
    rows, groups, scored = read
    assert rows.count() == len(teach) and groups.count() > 3
    assert sum(len(r["x"]) // 4 // quality.SIZE - r["good"] for r in groups.collect()) >= sum(not truth[i] for i in teach)
    assert sum(r["good"] for r in groups.collect()) == sum(truth[i] for i in teach)
    s, good = np.array([(r["s"], r["good"]) for r in scored.collect()]).T
    share = 1 - sum(truth[i] for i in teach) / len(teach)
    assert np.isclose(model.threshold, quality.quantile_between(s, np.ones(len(s)), share))
    held = {r["doc_id"]: r["predicted"] for r in quality.score(df, model).collect()}
    assert sum(held[i] != truth[i] for i in truth if zlib.crc32(str(i).encode()) % 5 == 0) <= 1


def test_quality_quantile_in_bins_equals_that_of_sorted_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    monkeypatch.setattr(quality, "BINS", 4)
    for case in range(5):
        s = rng.integers(0, (2, 5, 30, 1000, 10**6)[case], 60).astype(float)
        good = rng.integers(0, 2, 60)
        scored = spark.createDataFrame(list(zip(s.tolist(), good.tolist())), "s double, good int").cache()
        for level in (0.2, 0.7):
            weight = (0.5, 1.5)
            assert quality.quantile_of_all(scored, weight, level) == pytest.approx(quality.quantile_between(s, np.array(weight)[good], level))
