"""Packing, page text, mixing, token counts, toxicity and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from ledgerline.llm import html_text, mixing, packing, repeats, token_counts, toxicity
from ledgerline.llm.common import dense_positions, unit_hash
from tests.conftest import SF
from tests.llm.fixtures import awkward, empty
from tests.llm.test_pairs_and_repeats import groups, struck

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_dense_positions(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else f"g{i % 3}", i) for i in range(200)], "g string, i long")
    got = dense_positions(df.withColumn("mix", unit_hash(F.lit(1), "i")), ["g"], ["mix", "i"], F.col("mix"), "at", 7)
    seen = defaultdict(list)
    for r in got.collect():
        seen[r.g].append((r.at, r.mix))
    for rows in seen.values():
        assert [a for a, _ in sorted(rows)] == list(range(len(rows))) and sorted(rows) == sorted(rows, key=lambda x: x[1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aAbé .,'s\t\n\x1c<|>ΣſİßǅÅ0")), max_size=40))
def test_cached_ids_equal_the_tokenizer(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    tokens = packing.token_bytes(WORDS)
    assert tokens.of(text) == tokens.encode(text)


def test_packing_keeps_rows_without_ids(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (None, None, "x"), (4, "", "y"), (4, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check_packing(docs.collect(), packing.packed(docs, WORDS).collect())


def test_page_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<p>some words</p>", "t", 7), (1, "u", None, None, None), (None, None, "<p>x y</p>", "", 0)], "page_id long, url string, html string, text string, n_chars long")
    assert Counter(tuple(r) for r in html_text.page_texts(df).collect()) == Counter([(1, "u", "some words", 10), (1, "u", "", 0), (None, None, "x y", 3)])


def test_another_tokenizer_gets_texts_whole():
    tokens = packing.TokenBytes(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Some  Words, it's ten 1000 words.\n\n  é " * 3
    assert not tokens.known and tokens.of(text) == tokens.encode(text)


def check_packing(rows, got, window=4096):
    tok = Tokenizer.from_file(WORDS)
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [2] for t in {r.text for r in rows}}
    want = Counter()
    for r in rows:
        x = ids[r.text]
        for at in range(0, len(x), window):
            want[r.doc_id, at, len(x[at : at + window]), zlib.crc32(np.array(x[at : at + window], "<u4").tobytes()), len(x)] += 1
    assert want == Counter((g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens) for g in got)
    held = defaultdict(list)
    for g in got:
        held[g.sequence_id].append((g.offset, g.length))
    padding = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(g.length for g in got)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    padding, total = check_packing(docs.collect(), packing.packed(docs, WORDS).collect())
    assert padding <= 0.01 * total + 4096
    rough = awkward(spark)
    check_packing(rough.collect(), packing.packed(rough, WORDS).collect())
    assert packing.packed(empty(spark), WORDS).collect() == []


def test_plan_uses_each_piece_once():
    r = np.random.default_rng(0)
    for histogram in (np.zeros(65, np.int64), np.bincount(r.integers(1, 65, 5000), minlength=65), np.eye(65, dtype=np.int64)[1] * 1000, np.bincount([33] * 100, minlength=65)):
        slots = packing.plan(histogram, 64)
        filled = defaultdict(int)
        for length in range(1, 65):
            spans = sorted((lo, hi) for a, lo, hi, _, _ in slots if a == length)
            assert [lo for lo, _ in spans] == [0, *[hi for _, hi in spans]][: len(spans)] and sum(hi - lo for lo, hi in spans) == histogram[length]
        for a, lo, hi, base, _ in slots:
            for k in range(hi - lo):
                filled[base + k] += a
        assert max(filled.values(), default=0) <= 64


def unigram(vocabulary, by_bytes=False):
    """The tokenizer library's own model over whole texts."""
    least = min(s for _, s in vocabulary)
    spelled = [(f"<0x{i:02X}>", least) for i in range(256)] if by_bytes else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary, *spelled], 0, by_bytes))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)
    return t


def test_token_counts_on_the_sample_table(spark):
    odd = spark.createDataFrame([(-1, "two  spaces   and ▁ \uff21\uff22 \U0001f600\n\n x ", "", "", 0), (-2, "   ", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")).unionByName(odd)
    assert token_counts.has_bytes(PIECES)
    pieces = token_counts.pieces_of(PIECES)
    tok = unigram(pieces, True)
    want = sorted((r.doc_id, len(r.text or ""), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted(tuple(r) for r in token_counts.counted(docs, PIECES).collect()) == want
    assert token_counts.counted(empty(spark), PIECES).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=3), st.integers(-4, 0), min_size=1, max_size=8), st.text("abc ", max_size=12))
def test_token_counts_with_ties_and_unknowns(vocabulary, text):
    vocabulary = [(p, float(s)) for p, s in vocabulary.items()]
    counter = token_counts.Counter(vocabulary)
    counter.unknown = min(0.0, *[s for _, s in vocabulary]) - token_counts.PENALTY
    assert counter.of(text) == len(unigram(vocabulary).encode(text, add_special_tokens=False).ids)


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a>a</a> b c</nav><article><h1>One  &amp; two</h1><p>Some words\n here<br>and more<p>un<b>clo</b>sed &lt;tag&gt; &#233;</article><footer>foot words here</footer></body></html>",
     "One & two\n\nSome words here and more\n\nunclosed <tag> é"),
    ("<body><div class='cookie-notice'>We use cookies, many cookies, please accept them all</div><div id=content><h2>Title here</h2><p>" + "good words " * 30 + "</p><aside>see also this and that</aside><form><label>Name</label><input></form><p>" + "the end " * 20 + "</p></div><div id='comments'><p>" + "nice post " * 40 + "</p></div></body>",
     "Title here\n\n" + " ".join(["good words"] * 30) + "\n\n" + " ".join(["the end"] * 20)),
    ("<html><body><script>var x = '<p>no</p>'</script><style>p{}</style><!-- <p>hidden</p> --><main><p>" + "a plain text " * 20 + "</p></main><ul class=\"menu\"><li>x</li></ul></body></html>", " ".join(["a plain text"] * 20)),
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<p", "<p"), ("just words without any tag", "just words without any tag"),
]


def test_page_texts(spark):
    w = html_text.fit(html_text.LABELLED)
    for page, want in PAGES:
        assert html_text.main_text(page, w) == want
    df = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0])], "page_id long, url string, html string")
    got = html_text.page_texts(df).collect()
    assert len(got) == len(PAGES) + 1 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.page_texts(df.limit(0)).collect() == []


class Reader(HTMLParser):
    """Blocks of the inside of an article as Python's own parser reads them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks = [""]

    def handle_data(self, data):
        self.blocks[-1] += data

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "ul", "ol", "li", "div", "table", "tr", "blockquote", "pre"):
            self.blocks.append("")
        elif tag in ("br", "td"):
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.handle_starttag(tag, [])


def test_page_texts_on_the_sample_table_equal_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.page_texts(pages).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html[r.html.index("<article>") + 9 : r.html.index("</article>")])
        reader.close()
        assert got[r.page_id] == "\n\n".join(x for b in reader.blocks if (x := " ".join(b.split())))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "tag", "gone"]), st.sampled_from(["p", "div", "a", "x"]), st.integers(0, 6), st.booleans()), max_size=14))
def test_the_region_is_the_best_of_all_intervals(parts):
    parts = [html_text.Piece(kind, key, words=n, linked=linked) for kind, key, n, linked in parts]
    w = html_text.Weights(tags={"p": -0.25, "div": -3.0, "a": -0.5})
    value = [p.words * (w.linked if p.linked else w.word) if p.kind == "text" else w.left_out if p.kind == "gone" else w.tags.get(p.key, w.unseen) for p in parts]
    first, last = html_text.best_region(parts, w)
    best = max([sum(value[i : j + 1]) for i in range(len(value)) for j in range(i, len(value))], default=0)
    assert sum(value[first : last + 1]) == max(best, 0)


def test_many_elements_take_time_in_proportion():
    w = html_text.fit(html_text.LABELLED)
    took = []
    for n in (4000, 16000):
        page = "<body><article>" + "<p>some words</p><div class=ad><div>x</div></div>" * n + "</article></body>"
        began = time.process_time()
        assert html_text.main_text(page, w).count("some words") == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


#: Pages labelled by hand: what is text stands between [[ and ]].
BY_HAND = [
    """<!doctype html><html><body class="home blog"><header id="masthead" class="site-header"><a href="/">The Daily Lamp</a><nav class="main-nav"><ul><li><a>World</a><li><a>Sports</a></ul></nav></header>
    <div class="content-wrap has-sidebar"><main><article class="hentry"><h1>[[Rain returns to the valley]]</h1><p class="lede">[[After two dry months the rivers of the valley are rising again, and farmers who had begun to sell their herds say that they will wait.]]</p>
    <div class="ad-slot"><a>Cheap boots for wet days, now half the price</a></div><p>[[The water board expects the lower dam to be full by the end of the week, which would be the first time in four years.]]</p><ul><li>[[Roads to the north stay closed]]</li><li>[[Ferries run as planned]]</li></ul>
    <div class="share-buttons"><a>Tweet this</a> <a>Mail this</a></div></article></main><aside><h3>Most read</h3><a>Ten soups for the autumn</a></aside></div>
    <section class="comments"><h3>2 comments</h3><p>I have never seen so much water in my life, and I am seventy years old now.</p><p>What about the bridge at the mill, does anybody know when it opens again?</p></section><footer>All rights reserved</footer></body></html>""",
    """<html><body><div id="wrapper"><div id="top-menu" class="menu"><a>Start</a> | <a>Archive</a> | <a>About</a></div><form action="/post.aspx" id="aspnetForm"><div class="post-text"><h2>[[How I mended an old radio]]</h2>
    <p>[[The set came from my grandfather's attic and had not played a note since the sixties. I opened it on the kitchen table with no plan at all.]]</p><p title=don't>[[First I looked for the valves, and found that one of them was cracked from top to bottom.]]</p>
    <table class="share-prices"><tr><td>[[Valve]]</td><td>[[four pounds]]</td></tr><tr><td>[[Cord]]</td><td>[[two pounds]]</td></tr></table><p>[[With the new valve in place it hummed, crackled and then played a waltz.]]</p></div></form>
    <div class="pager"><a>Older posts</a></div><div class="copyright footer">Made with a typewriter</div></div></body></html>""",
    """<html><head><style>.x{}</style></head><body><div class="cookie-consent">This site uses cookies to make your visit better. Accept all cookies or read our policy.</div><table width="100%"><tr><td class="leftnav"><a>Home</a><br><a>Recipes</a><br><a>Tips</a></td>
    <td><h1>[[Plain bread]]</h1><p>[[Mix five cups of flour with two of water, a spoon of salt and some yeast; knead until the dough no longer sticks to the board.]]</p><p class="related-work">[[Work that is related to the shaping of loaves is told in the next part.]]</p>
    <p>[[Let it rest under a cloth for two hours, shape it, let it rest again, and bake it in a hot oven until it sounds hollow.]]</p></td></tr></table><div id="newsletter-signup">Get one recipe a week by mail</div><script>var a = "<p>no text</p>";</script></body></html>""",
    """<html><body><div id="page" class="no-ads"><h1>[[Minutes of the garden club]]</h1><p>[[Present were nine members and two guests. The minutes of the last meeting were read and accepted without changes.]]</p><p>[[The hedge along the lane will be cut in March, weather allowing, and the pond will be cleaned by the younger members.]]</p>
    <div class="relatedPosts"><a>Minutes of May</a><a>Minutes of June</a></div></div><ol class="commentlist"><li class="comment">Thank you for the notes, I could not be there myself this time.</li></ol></body></html>""",
    """<html><body><nav>Home Products Contact</nav><div class="story"><p>[[The old clock on the town hall has stopped again, at ten past four, as it did in the winter of the great snow.]]</p><div class="social"><a>Like</a><a>Follow</a></div><blockquote>[[It stops when somebody important leaves the town, says the keeper.]]</blockquote>
    <div class="promo-box">Win a watch! Take part in our quiz today.</div><p>[[Nobody has told him yet who that might be, but the baker's shop has been shut since Monday, and people draw their own conclusions.]]</p></div><div class="widget sidebar"><h4>Weather</h4>Rain</div></body></html>""",
]


def test_words_found_on_pages_labelled_by_hand():
    w = html_text.fit(html_text.LABELLED)
    hit = got_all = want_all = 0
    for page in BY_HAND:
        got = Counter(html_text.main_text(page.replace("[[", "").replace("]]", ""), w).split())
        want = Counter(" ".join(re.findall(r"\[\[(.*?)\]\]", page)).split())
        hit, got_all, want_all = hit + sum((got & want).values()), got_all + sum(got.values()), want_all + sum(want.values())
    print("precision", hit / got_all, "recall", hit / want_all)
    assert hit / got_all > 0.97 and hit / want_all > 0.99


TALE = "a plain text of words " * 20
WHOLE = [
    *[f"<body><div class='{c}'><p>{TALE}</p></div></body>" for c in ("layout has-sidebar", "content no-sidebar", "page with-comments", "layout sidebar", "social", "sidebar-left")],
    *[f"<body><div class='{c}'><article><p>{TALE}</p></article><div class=comments><p>{'so nice ' * 300}</p></div></div></body>" for c in ("has-sidebar", "sidebar", "left-sidebar")],
    f"<body><form id=login><div><p>{TALE}</p></div><select><option>{'choice ' * 30}</option></select></form></body>",
    f"<body><div data-class='ad' title='class=ad'><p>{TALE}</p></div><footer>{'small print ' * 300}</footer></body>",
    f"<body><article class='post promoted'><p>{TALE}</p></article></body>",
]
IN_ARTICLE = ['<h2 id="related-work">{}</h2>', '<h2 class="notice">{}</h2>', '<section id="comments-on-method"><p>{}</p></section>', '<section id="comments"><p>{}</p></section>', '<div class="share-price-table"><p>{}</p></div>', '<div class="relatedWork">{}</div>']


def test_marks_leave_the_text_whole():
    w = html_text.fit(html_text.LABELLED)
    for page in WHOLE:
        assert html_text.main_text(page, w) == TALE.strip(), page
    for part in IN_ARTICLE:
        page = f"<body><article><p>{TALE}</p>{part.format('the part')}<p>{TALE}</p></article></body>"
        assert html_text.main_text(page, w) == f"{TALE.strip()}\n\nthe part\n\n{TALE.strip()}", part
    for part in ("<div class='ad'>{}</div>", "<div class='x ad-banner'>{}</div>", "<div class=ADS>{}</div>", "<div class='socialShare'>{}</div>", "<div role=navigation>{}</div>", "<div aria-label='Main menu'>{}</div>", "<nav>{}</nav>"):
        page = f"<body><article><p>{TALE}</p>{part.format('the part')}<p>{TALE}</p></article></body>"
        assert html_text.main_text(page, w) == f"{TALE.strip()}\n\n{TALE.strip()}", part


ICONS = [
    ("<p>one two</p>{}<p>three four</p>", ["<svg class='i'/>", "<svg/>", "<svg>", "<canvas>", "<object data=x>", "<iframe src=x>", "<svg class=\"a>b\"/>", "<svg><title/><style/><svg><path/></svg>no</svg>", "<svg><svg>no</svg>no</svg>", "<svg><title>no</title></svg>", "<template><template>no</template>no</template>", "<noscript>no</noscript>", "<canvas/>", "<script>'</p>'</script>", "<title>no</title>"]),
    ("<p>one two</p>{}<p>three four</p><svg></svg>", ["<svg/>", "<svg class='i' />", "<svg/><svg>no</svg>"]),
    ("<p>one two</p>{}<p>three four</p><i title='x'></i>", ["<b title=it's></b>", "<b it's></b>", "<b title=5\"></b>", "<b ' ></b>", "<b title = 'a>b'></b>", "<b title='a>b\"'></b>"]),
]


def test_icons_and_stray_quotes_swallow_nothing():
    w = html_text.fit(html_text.LABELLED)
    for page, parts in ICONS:
        for part in parts:
            assert html_text.main_text(f"<article>{page.format(part).replace('two', TALE)}</article>".replace("three", TALE), w) == f"one {TALE.strip()}\n\n{TALE.strip()} four", part
    for name in ("script", "style", "textarea", "title"):
        assert html_text.main_text(f"<p>one two three four</p><{name}>gone <p>gone too</p>", w) == "one two three four"
    assert html_text.main_text("<p>one two</p>" + "<a title=\"x\" b='y' " * 3000, w).startswith("one two")


def test_long_page_is_whole():
    page = "<article><p>" + "word " * 200_000 + "</p></article>"
    assert len(html_text.main_text(page, html_text.fit(html_text.LABELLED)).split()) == 200_000


def labelled(spark, n=400, seed=2):
    r = random.Random(seed)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(3, 7)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [word("abcdefgh") for _ in range(r.randint(10, 80))]
        if bad:
            for _ in range(max(1, len(words) // 10)):
                words[r.randrange(len(words))] = "zzorx" + word("abc")
            words[r.randrange(len(words))] = "dreadful"
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got.values())


def toxic_texts(n, seed):
    """Texts of invented words, a third of them with one or two words of a bad list; `twist` misspells these."""
    r = random.Random(seed)
    made = random.Random(1)
    common = ["".join(made.choice("abcdefghiklmnoprstu") for _ in range(made.randint(3, 9))) for _ in range(400)]
    bad = ["gronkhead", "vlimpish", "dratzel", "snurfling"]
    rows = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(20, 60))]
        if i % 3 == 0:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((" ".join(words), int(i % 3 == 0)))
    twist = lambda t: " ".join(w[:-2] + "q" + w[-1] if w in bad else w for w in t.split())
    return rows, twist


def test_joint_training_learns_what_the_start_does_not_know():
    rows, twist = toxic_texts(900, 5)
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows])
    new, _ = toxic_texts(300, 6)

    def accuracy(model, change=lambda t: t):
        words = toxicity._WordValue(model.value)
        return np.mean([(toxicity.text_score(change(t), model.bias, words) >= 0.5) == v for t, v in new])

    trained, start = (toxicity.train(texts, y, np.ones(len(y)), steps=n) for n in (50, 0))
    assert accuracy(trained) > 0.95 and accuracy(start) < 0.7
    # spellings that training never saw share n-grams with words that it did
    assert accuracy(trained, twist) > 0.85


def test_a_score_is_the_softmax_of_the_averaged_subword_vectors():
    rows, _ = toxic_texts(300, 7)
    model = toxicity.train([t for t, _ in rows], np.array([v for _, v in rows]), np.ones(len(rows)))
    text = rows[0][0] + " Gronkhead!! twice twice"
    by_hand = 0.0
    for token in text.split():
        marked = "<" + token.strip(toxicity.EDGE).lower() + ">"
        grams = [marked] + [marked[i:j] for i in range(len(marked)) for j in range(i + 3, min(i + 5, len(marked)) + 1)]
        by_hand += sum(float(model.value[zlib.crc32(g.encode()) % toxicity.BUCKETS]) for g in grams) / len(grams)
    by_hand = model.bias + by_hand / len(text.split())
    assert abs(toxicity.text_score(text, model.bias, toxicity._WordValue(model.value)) - 1 / (1 + np.exp(-by_hand))) < 1e-6


def test_toxicity_ignores_the_labels_of_held_out_rows(spark):
    docs, labels, _ = labelled(spark, 80)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: sorted((r.doc_id, r.score) for r in toxicity.toxicity_report(docs, x).collect())
    assert score(labels) == score(flipped)


def test_toxicity_with_awkward_rows(spark):
    docs, labels, _ = labelled(spark, 80)
    rough = awkward(spark)
    got = toxicity.scored(rough, toxicity.fit(docs, labels), *rough.columns, name="s")
    assert got.count() == rough.count() and got.filter("s IS NULL OR s < 0 OR s > 1").count() == 0
    none = labels.filter("false")
    assert {r.score for r in toxicity.toxicity_report(docs, none).collect()} == {0.5}
    assert toxicity.toxicity_report(empty(spark), labels).collect() == []
    assert sorted(toxicity.without_toxic(rough, none).columns) == sorted(rough.columns)


def test_rates_meet_the_targets(spark):
    docs, labels, _ = labelled(spark)
    start = mixing.mixed_rates(docs, labels, None, 0.0).collect()
    share = lambda rows, rate: (x := sum(np.array(r.posteriors) * r.tokens * rate(r) for r in rows)) / x.sum()
    now = share(start, lambda r: 1.0)
    for least, shift in ((0.0, 0.05), (0.0, -0.05), (1.0, 0.05)):
        weights = [now[0] + shift, now[1] - shift]
        rows = mixing.mixed_rates(docs, labels, weights, least).collect()
        reached = share(rows, lambda r: r.rate)
        assert len(rows) == 400 and min(r.rate for r in rows) >= least
        assert abs(reached[0] - weights[0]) < (0.005 if least == 0 else 0.04)
    assert all(abs(sum(r.posteriors) - 1) < 1e-9 for r in rows)


@pytest.mark.parametrize(
    ("soft", "weights", "least"), [(0.3, [0.6, 0.4], 0.0), (0.3, [0.9, 0.1], 0.0), (30.0, [0.95, 0.05], 0.0), (0.5, [0.5, 0.3, 0.2], 0.0), (0.4, [0.1, 0.9], 1.0)]
)
def test_rates_leave_as_little_as_plain_projected_gradient(spark, soft, weights, least):
    r = np.random.default_rng(0)
    n = len(weights)
    p, t = r.dirichlet([soft] * n, 300), r.integers(1, 50, 300)
    rows = [(int(x), [float(y) for y in q]) for x, q in zip(t, p)]
    judged = spark.createDataFrame(rows, "__tokens long, __posterior array<double>").cache()
    total = float(3 * t.sum()) if least else float(t.sum())
    steps, missing = mixing.solve(judged, n, weights, least, total)
    rated = judged.withColumn("rate", mixing.rate(steps, least)).collect()
    part, target = p * t[:, None], np.array(weights) * total
    left = lambda x: np.linalg.norm(x @ part - target)
    plain = np.ones(300)
    for _ in range(20_000):
        plain = np.maximum(least, plain - part @ (plain @ part - target) / (part**2).sum())
    got = left(np.array([x["rate"] for x in sorted(rated, key=lambda x: rows.index((x["__tokens"], x["__posterior"])))]))
    assert min(x["rate"] for x in rated) >= least
    assert got <= 1.15 * left(plain) + 2e-4 * total  # targets out of reach: steps end a little above the least


def test_copies_follow_the_text_and_the_rate(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.xxhash64("id").alias("__mark"), F.lit(1.25).alias("rate"))
    assert abs(docs.agg(F.avg(mixing.copies(F.col("rate")))).first()[0] - 1.25) < 0.03


def test_mixing_with_awkward_rows(spark):
    docs, labels, _ = labelled(spark, 80)
    rough = awkward(spark)
    out = mixing.mixed(rough, labels, [0.3, 0.7])
    assert out.columns == rough.columns and out.distinct().count() == rough.distinct().count()
    assert mixing.mixed_rates(empty(spark), labels).collect() == []
    assert mixing.mixed_rates(docs, labels.filter("false")).filter("rate <> 1").count() == 0


def test_one_id_with_several_texts(spark):
    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = text(), text(), text()
    near = a + " end"
    rows = [(3, a, "x"), (5, near, "x"), (5, b, "x"), (7, c, "y"), (7, c, "x"), (8, c + " end", "x"), (9, b, "x"), (9, None, "x"), (None, a, "x")]
    want = Counter([(3, a, "x"), (5, b, "x"), (7, c, "x"), (9, None, "x"), (None, a, "x")])
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        assert Counter(tuple(x) for x in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == want


def test_pipeline_stages(spark, tmp_path):
    import shutil

    for t in ("documents", "labels"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixing", "packing"]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            assert {r.doc_id for r in rows} < {r.doc_id for r in before}
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _, kept in groups(before, 80) if kept)
        elif name == "repeats":
            lost = {i for i, n, gone, _, _ in struck(before, 200) if gone}
            same = {r.doc_id: r.text for r in before}
            assert all(r.text == same[r.doc_id] for r in rows if r.doc_id not in lost) and {i for i in same if i not in lost} <= {r.doc_id for r in rows}
        elif name == "mixing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
        else:
            check_packing(before, rows)
        docs, before = out, rows


def test_a_rare_domain_is_repeated_up_to_the_limit_and_what_lacks_is_told(spark):
    rare = lambda i: i % 100 == 0
    rows = [(i, ("uvula wombat xenon yodel zebra " if rare(i) else "apple bread cider dates eggs ") * 10) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rare(i))) for i in range(1500)], "doc_id long, quality int")
    out = mixing.mixed(docs, labels, [0.1, 0.9]).groupBy("doc_id").count().collect()
    assert len(out) == 1500 and max(r["count"] for r in out) == 16 and all(r["count"] == (16 if rare(r.doc_id) else 1) for r in out)
    rates = mixing.mixed_rates(docs, labels, [0.1, 0.9], 1.0).collect()
    assert {round(r.rate) for r in rates if rare(r.doc_id)} == {16} and len({tuple(r.missing) for r in rates}) == 1
    common, scarce = rates[0].missing
    assert abs(scarce - (9 * 1485 - 16 * 15) * 50) < 0.02 * scarce and abs(common) < 0.02 * 1485 * 50
