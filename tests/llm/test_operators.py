"""Every operator against a brute-force version or an exact round trip, and on odd tables: nulls in any column, empty
and very long texts, ties, repeated rows, empty tables, and extra columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomotif.llm import embedding_dedup, features, html_text, jaccard_join, langid, media, mixing, packing, sharding, tokens, url_filter
from geomotif.llm.common import ascii_lower, bitmap, components, shingle_sets, stage, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   \n\t ", "one", "Two words", "same text again and again", "same text again and again", "SAME text AGAIN and again", "é ü 漢字 \u00a0 x", "<|endoftext|> a", "word " * 30000]
CLASH = "lang_pred score ambiguous n_tokens section_tokens n_crossing n_outside n_bytes media shard slot size rate copies tokens posterior t_host t_leaf url_filter".split()


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH})


def sets_of(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---- shared parts -------------------------------------------------------------------------------


def test_words_and_shingles_by_hand():
    texts = ["A b\tc", "", "  ", "a B c d e a b c d", "x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    s, e, first = words(ascii_lower(raw), off)
    assert np.diff(first).tolist() == [3, 0, 0, 9, 1]
    got = [len(x) for x in shingle_sets(raw, off, 3)]
    assert got == [1, 0, 0, 5, 1]
    a, *_, d, _ = shingle_sets(raw, off, 3)
    assert np.isin(a, d).all()  # a b c, whatever its case and white space


@pytest.mark.parametrize("task_edges", [1, 40, 10**6])
def test_components(spark, task_edges):
    rng = random.Random(1)
    for n, m in ((1, 0), (50, 30), (300, 310)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 2, n // 2 + n // 4)]
        links = [(a, b) for a, b in links if a < n and b < n]
        t = spark.createDataFrame(links or [(0, 0)], "a long, b long")
        got = {r.id: r.component for r in components(t, task_edges=task_edges).collect()}
        want = classes(n, links)
        assert all(got.get(i, i) == want[i] for i in range(n))


def test_bitmap(spark):
    n = [0, 1, 32767, 32768, 32769, 65535, 65536, (1 << 18) - 1]
    bits = np.unpackbits(bitmap(spark.createDataFrame([(x,) for x in n * 2], "h long"), 1 << 18), bitorder="little")
    assert np.flatnonzero(bits).tolist() == sorted(set(n))


# ---- 1 ------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        kind = rng.choices(("high", "low", "toxic"), (70, 20, 10))[0]
        vocabulary = {"high": "lorem ipsum dolor sit amet", "low": "zzz |||| %%% ### $$", "toxic": "vile bad nasty awful gross"}[kind].split()
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60))), None, "s", 0))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"high": 0.5, "low": 0.45, "toxic": 0.05}
    out, domains = mixing.mix(clashing(d), lab.unionByName(lab), targets)
    r = out.collect()
    assert domains == ["high", "low", "toxic"] and len(r) == 900
    t, p, rate = np.array([x.tokens for x in r]), np.array([x.posterior for x in r]), np.array([x.rate for x in r])
    share = (rate * t) @ p / t.sum()
    assert np.abs(share - [0.5, 0.45, 0.05]).max() < 2e-3 and rate.min() >= 0
    assert {x.gap for x in r} == {round(np.abs(share / share.sum() - [0.5, 0.45, 0.05]).max(), 9)}
    assert np.abs(np.array([x.copies for x in r]) - rate).max() < 1
    capped, _ = mixing.mix(d, lab, targets, max_rate=1.0)
    c = capped.collect()
    rate = np.array([x.rate for x in c])
    share = (rate * np.array([x.tokens for x in c])) @ np.array([x.posterior for x in c])
    assert 0 <= rate.min() and rate.max() <= 1 and np.abs(share / share.sum() - [0.5, 0.45, 0.05]).max() < 2e-3
    with pytest.warns(UserWarning, match="no document is labelled odd"):
        mixing.mix(d, lab, {"high": 0.5, "odd": 0.5})
    truth = {i: "toxic" if tx else "high" if q else "low" for i, q, tx in labels}
    hit = [domains[int(np.argmax(x.posterior))] == truth[x.doc_id] for x in r if x.doc_id in truth]
    assert np.mean(hit) > 0.97


def plain_least_squares(p, t, goal, top, steps=60000):
    """Projected gradient steps of one size over all documents at once, with the residual they end at."""
    a = p * t[:, None] / t.sum()
    rate = 1 / np.linalg.norm(a, 2) ** 2
    r = np.ones(len(t))
    for _ in range(steps):
        r = np.clip(r - rate * (a @ (a.T @ r - goal)), 0, top)
    return np.abs(a.T @ r - goal).max()


@pytest.mark.parametrize("sharp,want,top", [(0.3, [0.98, 0.01, 0.01], None), (0.3, [0.98, 0.01, 0.01], 1.0), (0.05, [0.2, 0.3, 0.5], 1.0), (1.0, [0.8, 0.18, 0.02], None)])
def test_rates_reach_the_least_squares_optimum(spark, sharp, want, top):
    rng = np.random.default_rng(1)
    p, t = rng.dirichlet([sharp] * 3, 400), rng.integers(1, 90, 400).astype(float)
    table = spark.createDataFrame([(int(n), q.tolist()) for n, q in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    fit = mixing.fit_rates(table, ["a", "b", "c"], dict(zip("abc", want, strict=True)), max_rate=top)
    rates = mixing.replay(p, t, fit.history, 1e-5, top)
    got = (rates * t) @ p / t.sum()
    goal = np.array(want) * fit.budget / t.sum()
    assert fit.met and fit.gap < 1e-3 and rates.min() >= 0 and rates.max() <= (top or np.inf)
    assert np.abs(got - goal).max() <= plain_least_squares(p, t, goal, top or np.inf) + 1e-3 * fit.budget / t.sum()


def test_targets_out_of_reach_are_told(spark):
    table = spark.createDataFrame([(10, [0.6, 0.4]), (20, [0.7, 0.3])], "tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="missed"):
        fit = mixing.fit_rates(table, ["a", "b"], {"a": 0.99, "b": 0.01})
    assert not fit.met and 0.2 < fit.gap < 0.4


def test_mixing_of_odd_tables(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, domains = mixing.mix(d, none, {"high": 1.0})
    assert domains == ["all"] and {x.rate for x in out.collect()} == {1.0}
    out, _ = mixing.mix(d, spark.createDataFrame([(3, 1, 0), (4, None, None), (None, 0, 0), (10, 0, 0)], none.schema), {"high": 0.5, "low": 0.5})
    assert out.count() == len(ODD) and out.where("tokens = 0 and rate <> 1").count() == 0
    out, _ = mixing.mix(d.where("false"), none, {"high": 1.0})
    assert out.count() == 0


def test_samples_are_bounded_whatever_repeats(spark):
    """Rows without an id, copies of one id, and a label that a third of all rows share."""
    rows = [(None, f"text number {i}", "a") for i in range(3000)] + [(7, "the same", "b")] * 2000 + [(i, f"other {i}", "c") for i in range(40)] + [(i, None, "c") for i in range(9)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    x, y = features.sample_features(t, "text", F.col("lang"), F.col("doc_id"), 50, (1, 2))
    assert Counter(y) == {"a": 50, "b": 1, "c": 40} and x.shape == (91, features.BUCKETS)
    again, _ = features.sample_features(t.repartition(3), "text", F.col("lang"), F.col("doc_id"), 50, (1, 2))
    assert (x == again).all()
    labels = spark.createDataFrame([(i // 3, i % 2, 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    model = mixing.fit_domains(docs(spark, [f"word {i} {i % 7}" for i in range(2000)]), labels, F.expr(mixing.LABEL_DOMAIN), per_label=30)
    assert model.domains == ["high", "low"]


# ---- 2 ------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<header><h1>Site name</h1><p>A slogan of the site that goes on for a while</p></header><nav><ul><li><a href="/">Home</a></li><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work well for all of you.</p></div>
%s
<section id="comments"><h2>Comments</h2><p>First! What a great article, thank you so much for it.</p></section>
<aside class=sidebar><p>Popular posts of this week and the one before it</p></aside><form><label>Mail</label><input name=q><button>Go</button></form><footer><p>All rights are reserved by the site and its makers</p></footer>"""
BODY = """<h2>Title &amp; more</h2><p>First <b>para</b>graph of&nbsp;the
   text, 3 < 4 &eacute;<br>next.<p>Second one <a href="x>y">linked</a> here<div class="ad">Buy it now, cheap cheap cheap</div><ul><li>point one</li><li>point two</ul><!-- <p>gone</p> --><blockquote>Quoted words</blockquote>"""
WANT = "Title & more\n\nFirst paragraph of the text, 3 < 4 é next.\n\nSecond one linked here\n\npoint one\n\npoint two\n\nQuoted words"


@pytest.mark.parametrize("tag", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "%s"])
def test_pages_lose_all_but_their_article(tag):
    w = html_text.Weights({})
    assert html_text.extract(PAGE % (tag % BODY), w) == WANT


def test_layout_classes_are_no_noise():
    w = html_text.Weights({})
    page = '<body class="has-sidebar cookie-banner"><div class="with-sidebar page-ads"><p>The text of the page is here</p></div><div class="widget">Other</div>'
    assert html_text.extract(page, w) == "The text of the page is here"


PROSE = "The court held that the rule applies to all who had signed the paper before the end of the year"


@pytest.mark.parametrize("tag", ["article class='post category-legal'", "div class='entry social-science'", "section id=related-work", "p class=search-methods", "div class=share-price", "div class=alert-levels", "section class=discussion", "div class='post category-ads'", "div class=widget"])
@pytest.mark.parametrize("page", ["<body><nav><ul><li><a href=/>Home</a></ul></nav>%s</body>", "<body><article><h1>Title</h1>%s</article></body>"])
def test_article_text_stays_whatever_its_subject(tag, page):
    got = html_text.extract(page % f"<{tag}>{PROSE}</{tag.split()[0]}>", html_text.Weights({}))
    if tag != "div class=widget":
        assert PROSE in got
    else:
        assert (PROSE in got) == ("<article>" not in page)


def test_short_sections_and_parts_of_sentences_stay():
    page = "<article><p>Let <math><mi>x</mi></math> be <label>the name</label> of it.</p><fieldset>Boxed</fieldset><p class=search-methods>We looked.</p><p>More text</p></article>"
    assert html_text.extract(page, html_text.Weights({})) == "Let x be the name of it.\n\nBoxed\n\nWe looked.\n\nMore text"


@pytest.mark.parametrize("tag", ["div class=share-buttons", "div class=share", "div id=ad-container", "div class=ad-728x90", "ul class=related-posts", "div class=comment-list", "div class=cookieBanner", "article class=comment"])
def test_noise_in_articles_still_goes(tag):
    page = f"<article><p>{PROSE}</p><{tag}><a href=/x>Share</a> <a href=/y>this one</a></{tag.split()[0]}><p>{PROSE}</p></article>"
    assert html_text.extract(page, html_text.Weights({})) == PROSE + "\n\n" + PROSE


def test_letters_that_grow_in_lower_case():
    page = "<head><title>\u0130stanbul</TITLE ><script>'\u0130'</Script><style>p{}</style></head><body><article><h1>\u0130zmir</h1><p>Text of the page</p></article>"
    assert html_text.extract(page, html_text.Weights({})) == "\u0130zmir\n\nText of the page"


def test_words_of_labelled_pages_tell_text_from_the_rest():
    rng = random.Random(4)
    prose, trade = "harbour winter letter bridge garden".split(), "cheap coupon basket checkout voucher".split()
    line = lambda v: f"<div>{' '.join(rng.choices(v, k=8))}</div>"
    known = [f"<body>{line(trade)}<article>{line(prose)}{line(prose)}</article>{line(trade)}</body>" for _ in range(60)]
    w = html_text.Weights(html_text.count(known))
    assert w.words(" ".join(prose)) > 1 > -1 > w.words(" ".join(trade))
    assert len(w.word) <= html_text.WORDS + 1


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50000 + "</ul>" * 50000, "<p><button>" + "<label>" * 30000 + "<hr>x" * 30000, "<li><ul>" + "<div>" * 30000 + "<li></li>" * 30000, '<p a=">"' * 60000, '<p ">' * 60000, "<" * 100000, "<p " * 60000, "<p a='>" * 60001, "<table><tr><td>x" * 20000 + "</div>" * 20000],
    ids="unmatched labels items quotes odd less unclosed single cells".split(),
)
def test_reading_takes_time_in_proportion(page):
    import time

    began = time.process_time()
    html_text.extract(page, html_text.Weights({}))
    assert time.process_time() - began < 8


def test_quotation_marks_out_of_place():
    page = '<article><p title="a>b">One</p><p title="5" tall">Two</p><p class=x"y>Three</p><p a=">Four</p><p>Five</p></article>'
    assert html_text.extract(page, html_text.Weights({})) == "One\n\nTwo\n\nThree\n\nFour\n\nFive"


def plain_reader(page):
    """A plain extractor for the pages below: blocks of text outside the elements that never hold an article."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks, self.now = 0, [], ""

        def handle_starttag(self, tag, attrs):
            if tag in ("nav", "footer", "aside", "script", "header") or dict(attrs).get("class") in ("ad", "comments"):
                self.depth += 1
            elif self.depth and tag == "div":
                self.depth += 1
            if tag in ("p", "div", "li", "h1"):
                self.flush()

        def handle_endtag(self, tag):
            if self.depth and tag in ("nav", "footer", "aside", "script", "header", "div"):
                self.depth -= 1
            if tag in ("p", "div", "li", "h1"):
                self.flush()

        def handle_data(self, data):
            if not self.depth:
                self.now += data

        def flush(self):
            self.blocks.append(" ".join(self.now.split()))
            self.now = ""

    r = Reader()
    r.feed(page)
    r.flush()
    return "\n\n".join(b for b in r.blocks if b)


@pytest.mark.parametrize("seed", range(4))
def test_pages_without_a_marked_article_equal_a_plain_reader(seed):
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choices("the court held that rule a letter in winter on old stone bridge over water".split(), k=k))
    for _ in range(60):
        body = f"<h1>{words(4)}</h1>"
        for _ in range(rng.randint(2, 7)):
            body += rng.choice((f"<p>{words(30)} <b>{words(2)}</b>\n{words(3)}</p>", f"<div>{words(25)}</div>", f"<ul><li>{words(12)}</li><li>{words(9)}</li></ul>", f"<div class=ad>{words(6)}</div>", f"<p>{words(15)} &amp; {words(5)}</p>"))
        page = f"<body><header><p>{words(3)}</p></header><nav><ul><li><a href=/>{words(1)}</a></li><li><a href=/x>{words(2)}</a></li></ul></nav><div>{body}</div>"
        page += f"<div class=comments><p>{words(20)}</p></div><aside><p>{words(9)}</p></aside><footer><p>{words(6)}</p></footer></body>"
        assert html_text.extract(page, html_text.Weights({})) == plain_reader(page)


def test_region_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice((-3, -1, -0.5, 1, 2)) for _ in range(rng.randint(1, 12))]
        a, b = html_text.best_region(s)
        best = max([0.0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert sum(s[a:b]) == pytest.approx(best)


def test_html_of_odd_tables(spark):
    rows = [(0, "u", None), (1, None, ""), (2, "u", "<<<>"), (3, "u", "plain"), (3, "u", "plain"), (4, "u", PAGE % ("<article>" + BODY)), (5, "u", "<p " * 5000), (6, "u", "<article><p>" + "long text " * 50000), (7, "u", "<script>never closed <p>x"), (8, "u", '<p title="a>b\'>x</p>')]
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.extract_pages(t.withColumns({"text": F.lit("mine"), "n_chars": F.lit(1)}), html_text.learn(t))
    got = {r.page_id: r for r in out.collect()}
    assert [got[i].text for i in (0, 1, 3, 7)] == ["", "", "plain", ""] and got[4].text == WANT
    assert all(r.n_chars == len(r.text) for r in got.values()) and out.count() == len(rows) and len(got[6].text) == 499999
    assert html_text.extract_pages(t.where("false"), html_text.learn(t.where("false"))).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------


def check_shards(rows, texts, shards):
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(shards))
    return load


def test_shards_are_even_and_whole(spark):
    rng = random.Random(4)
    texts = [("copy " * 40 if i % 3 == 0 else "x" * rng.randint(0, 900)) for i in range(3000)]
    d = docs(spark, texts)
    out = sharding.shard_records(sharding.record_sizes(d), shards=12, ranges_per_shard=20)
    load = check_shards(out.collect(), texts, 12)
    assert out.count() == 3000 and max(load.values()) < 1.02 * sum(load.values()) / 12 < 1.05 * min(load.values())


def test_shards_of_odd_tables(spark):
    d = clashing(docs(spark, ODD))
    rows = sharding.shard_records(sharding.record_sizes(d.unionByName(d)), shards=3).collect()
    assert len(rows) == 2 * len(ODD)
    check_shards(rows, ODD, 3)
    assert sharding.shard_records(sharding.record_sizes(d.where("false"))).count() == 0
    nulls = d.withColumn("doc_id", F.lit(None).cast("long"))
    assert sharding.shard_records(sharding.record_sizes(nulls), shards=3).count() == len(ODD)


def test_equal_rows_are_split_over_shards(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text " * 3).alias("text"), F.lit(1).alias("row"), F.lit(2).alias("rng"))
    rest = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("row"), F.lit(2).alias("rng"))
    out = sharding.shard_records(sharding.record_sizes(same.unionAll(rest)), shards=10, ranges_per_shard=20).collect()
    load, slots = Counter(), defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(out) == 7000 and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_splitters_rank_keys_as_sorting_does():
    rng = random.Random(8)
    keys = [(rng.randrange(4), rng.randrange(3), rng.randrange(50)) for _ in range(300)]
    splits = sorted(rng.sample(sorted(set(keys)), 40))
    got = sharding.rank([np.array(c) for c in zip(*splits, strict=True)], [np.array(c) for c in zip(*keys, strict=True)])
    assert got.tolist() == [sum(s <= k for s in splits) for k in keys]


# ---- 4 ------------------------------------------------------------------------------------------


def near_texts(seed, n=140):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=55)
    out = []
    for i in range(n):
        if i > 10 and rng.random() < 0.6:
            w = (out[rng.randrange(len(out))] or "a b c").split()
            for _ in range(rng.choice((0, 1, 1, 2, 4, 8))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w[: int(len(w) * 0.93)]
        else:
            w = rng.choices(vocabulary, k=rng.choice((1, 2, 3, 4, 5, 20, 60, 150)))
            if rng.random() < 0.5:
                w += passage
        out.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
    return out


@pytest.mark.parametrize("seed,k,num", [(0, 4, 85), (1, 5, 80), (2, 4, 85)])
def test_jaccard_classes_equal_brute_force(spark, seed, k, num):
    texts = near_texts(seed) + ODD
    sets = [sets_of(t, k) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert len(links) > 30
    want = classes(len(texts), links)
    out = jaccard_join.jaccard_components(docs(spark, texts), k=k, num=num, den=100, crowd=8 if seed == 2 else 64).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), want[i]), i


def test_crowded_areas_miss_nothing(spark):
    """A hundred copies near the threshold, of which many link with some only."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w))
    sets = [sets_of(t, 4) for t in texts]
    want = classes(len(texts), [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    out = jaccard_join.jaccard_components(docs(spark, texts), rounds=0, crowd=4).collect()
    assert [r.component_id for r in sorted(out, key=lambda r: r.doc_id)] == want


@pytest.mark.parametrize("pivots", [2, 8])
def test_linked_documents_meet_in_one_voronoi_region(spark, pivots):
    rng = np.random.default_rng(pivots)
    centres = rng.integers(0, 40, (5, 256))
    rows = []
    for i in range(160):
        sketch = np.clip(centres[i % 5] + rng.integers(0, 2, 256) * rng.integers(0, 8) // 4, 0, 255).astype(np.uint8)
        n = int(sketch.sum())
        rows.append((i % 3 // 2, i, i, n, n / 0.85, 0, bytes(sketch)))
    t = spark.createDataFrame(rows, "s long, rep long, label long, n int, reach double, away long, sketch binary")
    width = 15 / 185
    got = {r.rep: r for r in jaccard_join.to_pivots(t, ["s"], pivots, 0, width).collect()}
    assert len(got) == 160 and len({(r.s, r.home) for r in got.values()}) > 2
    seen = {r[1]: np.frombuffer(r[6], np.uint8).astype(int) for r in rows}
    linked = 0
    for i in range(160):
        assert all(p != i for p in got[i].near)
        for j in range(i):
            a, b = got[i], got[j]
            if a.s == b.s and np.abs(seen[i] - seen[j]).sum() <= (a.n + b.n) * width and a.n <= b.reach and b.n <= a.reach:
                linked += 1
                regions = {(a.home, 0), *((g, 1) for g in a.guest)}, {(b.home, 0), *((g, 1) for g in b.guest)}
                assert sum(p == q and not (x and y) for p, x in regions[0] for q, y in regions[1]) == 1
    assert linked > 300


def test_regions_are_divided_again(spark):
    """Groups that are far from each other and all share a passage, larger than what is compared by pairs."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(6)]
    texts = []
    for g in range(4):
        base = passage + [f"g{g}w{i}" for i in range(60 + g)]
        for _ in range(22):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(6, len(w))] = f"x{rng.random()}"
            texts.append(" ".join(w))
    sets = [sets_of(t, 4) for t in texts]
    want = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    out = jaccard_join.jaccard_components(docs(spark, texts), rounds=0, crowd=3, pivots=3).collect()
    assert [r.component_id for r in sorted(out, key=lambda r: r.doc_id)] == want


def test_jaccard_of_odd_tables(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", None])
    twice = clashing(d.unionByName(d).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(twice).collect()), key=str)
    assert got == sorted([(0, 3, 0), (0, 3, 0), (1, 3, 0), (1, 3, 0), (2, 0, 2), (2, 0, 2), (None, 3, None)], key=str)
    assert jaccard_join.jaccard_components(d.where("false")).count() == 0


def test_different_texts_of_one_id(spark):
    texts = {"a": "a b c d e f g", "b": "q r s t u v w x"}
    rows = [(7, "a"), (7, "b"), (3, "b"), (5, "a"), (7, "a"), (9, "b"), (2, None), (2, "a")]
    d = spark.createDataFrame([(i, texts.get(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(d).collect())
    assert got == sorted((i, {"a": 4, "b": 5, None: 0}[t], {"a": 2, "b": 3, None: 2}[t]) for i, t in rows)


# ---- 5 ------------------------------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 24))
    near = [x[rng.integers(60)] + rng.normal(size=24) * s for s in rng.choice([0.0, 0.05, 0.2, 0.3, 0.4], 240)]
    v = [r.astype(np.float32).tolist() for r in np.concatenate([x, near])]
    rows = [(i, e, int(i % 2)) for i, e in enumerate(v)]
    rows += [(400, None, 0), (401, [0.0] * 24, 0), (402, [float("nan")] + [1.0] * 23, 0), (403, [None] + [1.0] * 23, 0), (404, v[0], None), (405, [1.0, 2.0], 0), (406, [1.0, 2.0], 0), (407, [float("inf")] * 24, 0), (408, [], 0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit("mine"))
    good = [(i, np.array(e, float), b) for i, e, b in rows if b is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [(i, j) for i, a, p in good for j, b, q in good if i != j and p == q and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93]
    n = Counter(i for i, _ in links)
    want = classes(409, links)
    for cell_rows in (4000, 20):
        got = {r.vec_id: r for r in embedding_dedup.link_embeddings(t, cell_rows=cell_rows).collect()}
        assert len(got) == len(rows) and len(links) > 400
        for i in got:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], want[i], want[i] == i), i
    assert embedding_dedup.link_embeddings(t.where("false")).count() == 0


def test_embeddings_without_ids(spark):
    a, b, c = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, a, 1), (5, b, 1), (None, a, 1), (None, b, 1), (9, b, 1), (9, b, 1), (None, c, 1), (None, c, 1), (None, None, 1), (3, a, 2)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in embedding_dedup.link_embeddings(t).collect()), key=str)
    want = [(None, 5, 5, False)] * 3 + [(5, 5, 5, True)] + [(9, 5, 5, False)] * 2 + [(None, 1, None, False)] * 2 + [(None, 0, None, False), (3, 0, 3, True)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 70])
def test_merged_trees_equal_plain_classes(n):
    rng = np.random.default_rng(n)
    root, links = np.arange(n), []
    for _ in range(4):
        i, j = rng.integers(0, n, 9), rng.integers(0, n, 9)
        links += list(zip(i.tolist(), j.tolist(), strict=True))
        embedding_dedup.merge(root, i, j)
        assert root.tolist() == classes(n, links)


# ---- 6 ------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    d = clashing(docs(spark, ODD))
    stored = media.store(d)
    seen = {r.doc_id: r for r in media.decode(stored).collect()}
    told = {r.doc_id: r for r in media.digest(stored).collect()}
    for i, t in enumerate(ODD):
        b = (t or "").encode()
        p = b + b" " * (media.padded(len(b)) - len(b))
        pixels = np.frombuffer(seen[i].pixels, np.uint8).reshape(seen[i].height, seen[i].width, 4)
        assert pixels[..., :3].tobytes()[: len(p)] == p and seen[i].media_error is None
        r = told[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_sha256 == hashlib.sha256(bytes(seen[i].media)).hexdigest() and r.media_bytes == len(seen[i].media)
    assert told[5].media_sha256 == told[6].media_sha256 != told[7].media_sha256
    bad = spark.createDataFrame([(0, None), (1, b"RIFFxxxx"), (2, bytes(seen[4].media))], "id int, media binary")
    assert [r.media_error is None for r in media.decode(bad).orderBy("id").collect()] == [False, False, True]
    n = spark.createDataFrame([(0, None, 5), (1, b"RIFFxxxx", 5), (2, bytes(seen[4].media), None), (3, bytes(seen[4].media[:-9]), 9), (4, bytes(seen[4].media), 9)], "id int, media binary, n_bytes long")
    got = {r.id: r for r in media.digest(n).collect()}
    assert [got[i].media_error is None for i in range(5)] == [False, False, True, False, True] and got[1].media_bytes == 8
    assert got[0].media_bytes is got[0].payload_bytes is got[3].feature is None and got[2].payload_bytes == got[4].payload_bytes == 192
    assert media.digest(media.store(d.where("false"))).count() == 0
    assert media.side(media.UNIT * (2 * 16384 + 1)) == (192, 10923)


# ---- 7 ------------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        own = sorted(by_doc[i], key=lambda r: r.piece)
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (r.length == capacity or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(by_seq)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choices("alpha beta gamma delta".split(), k=rng.choice((3, 20, 60, 90, 120)))) for _ in range(300)]
    rows = packing.pack(packing.token_pieces(clashing(docs(spark, texts)), capacity=128), capacity=128).collect()
    n = check_packing(rows, texts, 128)
    plain = sum(k for k, _ in packing.best_fit([], dict(Counter(r.length for r in rows)), 128))
    assert -(-sum(r.length for r in rows) // 128) <= n <= plain * 1.01 + 1
    assert packing.pack(packing.token_pieces(docs(spark, texts).where("false"))).count() == 0
    twice = docs(spark, ODD).unionByName(docs(spark, ODD))
    assert packing.pack(packing.token_pieces(twice)).count() == 2 * packing.token_pieces(docs(spark, ODD)).count()


def test_a_length_that_most_pieces_share_is_ranked_in_parts(spark):
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 5 == 0, 100).when(F.col("id") % 5 == 1, 40 + F.col("id") % 7).otherwise(33).cast("long").alias("length"))
    rows = packing.pack(clashing(pieces), capacity=100, task_rows=40).collect()
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 500 and len({r.doc_id for r in rows}) == 500
    for s in at.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 100
    assert len(at) == sum(n for n, _ in packing.plan_packing(dict(Counter(r.length for r in rows)), 100))


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_length_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal((5.5, 6.2, 3, 6.4)[seed], (1, 0.3, 1, 0.1)[seed], 4000).astype(int), 1, 1024)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.plan_packing(dict(counts))
    got = Counter()
    for n, content in plan:
        assert sum(a * b for a, b in content) <= 1024
        for length, each in content:
            got[length] += n * each
    assert got == counts
    plain = sum(n for n, _ in packing.best_fit([], dict(counts), 1024))
    assert sum(n for n, _ in plan) <= plain * 1.01 + 2
    table = packing.lookup(plan)
    assert all((t[:, 0] == np.cumsum([0, *packing.np.diff(t[:, 0])])).all() for t in table.values())


def test_configurations_reach_a_known_optimum():
    # 10 of 6 and 20 of 3 in bins of 10: a 6 and a 3 in each of ten, three 3s in the rest
    bins = packing.configurations([6, 3], np.array([10.0, 20.0]), 10)
    assert sum(a for a, _ in bins) == pytest.approx(10 + 10 / 3)


# ---- 8 ------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    rows = {
        None: ("", "", None), "no scheme/x": ("", "", None), "http://": ("", "", None), "HTTP://WWW.Example.COM": ("www.example.com", "", None),
        "https://Example.com/": ("example.com", "/", "com/"), "x://example.com/en/7?q=/a": ("example.com", "/en/7", "example.com/en/"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"), "http://a.www.example.com/en/x#f": ("a.www.example.com", "/en/x", "www.example.com/en/"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/"), "http://a.net/es/1": ("a.net", "/es/1", "net/es/"), "http://a.net/es": ("a.net", "/es", None),
        "http://a.org?x=http://b.com/": ("a.org", "", None), "http://ÀB.net/fr/": ("Àb.net", "/fr/", "net/fr/"), "http://a.net:80/fr/": ("a.net:80", "/fr/", None),
    }
    t = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.url_filter for r in url_filter.judge_urls(clashing(t)).collect()}
    verdicts = {r: v for v, r in url_filter.RULES}
    for i, (host, path, rule) in enumerate(rows.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), list(rows)[i]
        assert got[i].verdict == verdicts.get(rule, got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_filter.judge_urls(t.where("false")).count() == 0


def test_templates_learn_from_ruled_urls(spark):
    rules = (("block", "h.net/bad/x"), ("allow", "h.net/good/"))
    urls = [f"http://h.net/bad/x{i}/view" for i in range(60)] + [f"http://h.net/good/{i}" for i in range(50)] + ["http://h.net/bad/77777777/view", "http://h.net/other/1", "http://h.net/bad/y/view"] + [None]
    t = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id long, url string")
    df = url_filter.judge_urls(t, rules=rules)
    got = {r.url: r.url_filter for r in df.collect()}
    assert got["http://h.net/bad/77777777/view"].verdict == "block" and got["http://h.net/bad/y/view"].rule is None
    assert got["http://h.net/other/1"].verdict == "allow" and df.count() == 2 * len(urls)
    assert "Python" not in df._jdf.queryExecution().toString()


# ---- 9 ------------------------------------------------------------------------------------------

SAMPLES = {"en": "the cat and the dog were in this house with their friends", "de": "der hund und die katze sind nicht in diesem haus gewesen", "fr": "le chien et la chatte ne sont pas dans cette maison avec nous", "es": "el perro y la gata no están en esta casa con los amigos", "it": "il cane e la gatta non sono in questa casa con gli amici", "nl": "de hond en de kat zijn niet in dit huis met hun vrienden"}


@pytest.mark.parametrize("langs", [1, 2, 4, 6])
def test_languages_of_held_out_texts(spark, langs):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        lang = list(SAMPLES)[i % langs]
        rows.append((i, " ".join(rng.choices(SAMPLES[lang].split(), k=12)), lang))
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(t.where("doc_id < 180"))
    got = langid.predict(clashing(t), model).collect()
    assert len(got) == 240 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got if r.doc_id >= 180]) > 0.95


@pytest.mark.parametrize("langs", [2, 4, 7])
def test_decoding_equals_a_loop_over_codewords(langs):
    rng = np.random.default_rng(langs)
    code = langid.codewords(langs)
    m = langid.LanguageModel([f"l{i}" for i in range(langs)], code, rng.normal(size=(9, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape[1]))
    x = rng.normal(size=(40, 9))
    best, share, gap = m.decode(x)
    for i in range(40):
        loss = []
        for word in code:
            f = [sum(x[i, a] * m.weights[a, b] for a in range(9)) + m.bias[b] for b in range(len(word))]
            loss.append(sum(w * np.log(1 + np.exp(-c * v)) for w, c, v in zip(m.trust, word, f, strict=True)))
        order = sorted(range(langs), key=lambda k: loss[k])
        assert best[i] == order[0] and gap[i] == pytest.approx(loss[order[1]] - loss[order[0]])
        assert share[i] == pytest.approx(np.exp(-loss[order[0]]) / sum(np.exp(-v) for v in loss))


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        c = langid.codewords(n)
        assert c.shape[0] == n and (np.abs(c.sum(axis=0)) < n).all()
        d = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(d) >= (1 if n < 3 else 2)


def test_languages_of_odd_tables(spark):
    d = docs(spark, ODD + ["123 !!!", "é"])
    known = d.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") == 3, "yy"))
    got = {r.doc_id: r for r in langid.predict(d, langid.fit(known)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 11)] == ["und"] * 4 and got[12].lang_pred in ("xx", "yy") and got[0].score == 0
    assert {r.lang_pred for r in langid.predict(d, langid.fit(d)).collect()} == {"und"}
    assert langid.predict(d.where("false"), langid.fit(d.where("false"))).count() == 0


def test_ngram_counts_by_hand():
    raw = np.frombuffer(b"AbabX", np.uint8)
    c = features.ngram_counts(raw, np.array([0, 4, 4, 5]), (1, 2))
    assert c.sum(axis=1).tolist() == [7, 0, 1]  # no n-gram crosses a border
    a, b = features.ngram_counts(np.frombuffer(b"ABab", np.uint8), np.array([0, 2, 4]), (1, 2))
    assert (a == b).all()


# ---- 10 -----------------------------------------------------------------------------------------


def attribute_plainly(text, spans, rule):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, outside, crossing = [0] * len(spans), 0, 0
    at = 0
    for i in t.encode(text, add_special_tokens=False).ids:
        n = int(tokens.encoder()[1][i])
        begin, end = at, at + n
        at = end
        edges = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
        of = lambda byte: next((k for k, (a, b) in enumerate(edges) if a <= byte < b), -1)
        places = [of(b) for b in range(begin, end)]
        crossing += len(set(places)) > 1
        k = places[0] if rule == "start" else places[-1] if rule == "end" else max(dict.fromkeys(places), key=places.count)
        if k < 0:
            outside += 1
        else:
            out[k] += 1
    return out, outside, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts_by_lines_and_spans(spark, rule):
    texts = ["Title\n\nSome text here.\n\n\n  indented 漢字漢字\n", "one line", "\n", "a\r\nb", "ünïcödé\nnext 🙂🙂 line\n\n"]
    got = {r.doc_id: r for r in tokens.count_tokens(clashing(docs(spark, texts)), rule=rule).collect()}
    for i, t in enumerate(texts):
        starts = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)]
        spans = list(zip(starts, starts[1:] + [len(t)], strict=True))
        out, outside, crossing = attribute_plainly(t, spans, rule)
        assert (got[i].section_tokens, got[i].n_outside, got[i].n_crossing, got[i].n_tokens) == (out, outside, crossing, sum(out)), t
    fields = docs(spark, texts).withColumn("s", F.expr("array(named_struct('start', 0, 'end', 3), named_struct('start', 4, 'end', 9))"))
    got = {r.doc_id: r for r in tokens.count_tokens(fields, sections_col="s", rule=rule).collect()}
    for i, t in enumerate(texts):
        spans = [(min(a, len(t)), min(b, len(t))) for a, b in ((0, 3), (4, 9))]
        out, outside, _ = attribute_plainly(t, spans, rule)
        assert (got[i].section_tokens, got[i].n_outside) == (out, outside), t


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_in_any_order_with_gaps_and_overlaps(spark, rule):
    text = "Some words here, <|endoftext|> 漢字漢字 and there are more of them"
    spans = [(20, 40), None, (3, 9), (None, 5), (5, None), (8, 25), (30, 28), (-4, 2), (50, 9999)]
    kind = "array<struct<start:int,end:int>>"
    t = spark.createDataFrame([(1, text, spans), (2, text, None), (3, None, spans)], f"doc_id long, text string, s {kind}")
    got = {r.doc_id: r for r in tokens.count_tokens(t, sections_col="s", rule=rule).collect()}
    owner = [-1] * len(text)
    for k, s in reversed(list(enumerate(spans))):
        if s and None not in s:
            owner[max(s[0], 0) : max(s[1], 0)] = [k] * len(owner[max(s[0], 0) : max(s[1], 0)])
    by_byte = [o for c, o in zip(text, owner, strict=True) for _ in c.encode()]
    want, crossing, at = Counter(), 0, 0
    for i in tokens.encode(text):
        own = by_byte[at : at + int(tokens.encoder()[1][i])]
        at += len(own)
        crossing += len(set(own)) > 1
        want[own[0] if rule == "start" else own[-1] if rule == "end" else max(dict.fromkeys(own), key=own.count)] += 1
    assert got[1].section_tokens == [want[k] for k in range(len(spans))] and (got[1].n_outside, got[1].n_crossing) == (want[-1], crossing)
    assert got[2].section_tokens == [] and got[2].n_outside == got[2].n_tokens == got[1].n_tokens
    assert got[3].section_tokens == [0] * len(spans) and got[3].n_tokens == 0


def test_token_counts_of_odd_tables(spark):
    d = docs(spark, ODD)
    got = {r.doc_id: r for r in tokens.count_tokens(d.unionByName(d)).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].section_tokens == [0]
    assert tokens.count_tokens(d.where("false")).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(d, rule="none")


def test_queries_know_the_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers
    from geomotif.llm import queries

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["<|endoftext|>", "a <|endoftext|>  b\n<|endoftext|><|endoftext|>é", "<|endoftext|", "x  <|endoftext|>\n\n y<|ENDOFTEXT|> 漢字 it's 12 <|endoftext|> " * 300]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert want[9][0] == 50256
    rows = defaultdict(list)
    for r in queries.op7_packing(spark, str(tmp_path)).collect():
        rows[r.doc_id].append(r)
    counts = {r.doc_id: r for r in queries.op10_token_counts(spark, str(tmp_path)).collect()}
    for i, ids in want.items():
        ids = np.array([*ids, packing.END_ID], "<u4")
        assert sorted((r.start, r.length, r.ids_crc32) for r in rows[i]) == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n in packing.cut(len(ids), 1024)]
        assert counts[i].n_tokens == len(ids) - 1 == sum(counts[i].section_tokens)
        assert tokens.encoder()[1][ids[:-1]].sum() == len((texts[i] or "").encode())


# ---- the rest -----------------------------------------------------------------------------------


def test_staged_tables_lie_in_the_shared_folder(spark):
    t = stage(spark.range(5).toDF("x"), "t")
    assert t.count() == 5 and t.staged_at.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from geomotif.llm.common import shared_dir

    def session(master):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=dict), conf={})

    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    for master in ("local", "local[*]", "local[4]", "local[4,2]"):
        assert shared_dir(session(master))


def test_paths_that_differ_far_down(spark):
    deep = "http://h.net/" + "/".join("abcdefghi")
    urls = [f"{deep}/bad/{i}" for i in range(60)] + [f"{deep}/good/{i}" for i in range(60)] + [f"{deep}/bad/x/0", f"{deep}/good/x/0"]
    t = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r.url_filter for r in url_filter.judge_urls(t, rules=(("block", "h.net/a/b/c/d/e/f/g/h/i/bad/"), ("allow", "h.net/a/b/c/d/e/f/g/h/i/good/"))).collect()}
    assert got[urls[0]].template.endswith("h/i/bad/{n}") and got[urls[60]].purity > 0.9 > 0.2 > got[urls[0]].purity


def test_rows_without_ids(spark):
    t = spark.createDataFrame([(i % 50 if i % 7 else None, str(i)) for i in range(300)], "doc_id long, text string")
    gone = spark.createDataFrame([(3,), (3,), (None,), (44,), (99,)], "x long")
    from geomotif.llm.common import without

    got = sorted(without(t, gone, "doc_id").collect(), key=str)
    assert got == sorted((r for r in t.collect() if r.doc_id not in (3, 44)), key=str)


def test_rows_are_left_out_without_python(spark, capsys):
    """A second Python worker a task is memory that executors don't have."""
    from geomotif.llm.common import without

    rows = spark.createDataFrame([(i if i % 7 else None, f"text {i}") for i in range(3000)], "b long, m string")
    gone = spark.range(0, 6000, 3).toDF("x")
    left = without(rows, gone, "b")
    want = [(i if i % 7 else None, f"text {i}") for i in range(3000) if not i % 7 or i % 3]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    assert without(rows, gone.where("x < 0"), "b").count() == 3000
    left.explain()
    assert not re.search("Python|Arrow", capsys.readouterr().out)
