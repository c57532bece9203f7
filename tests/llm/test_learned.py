"""Language, toxicity, quality and extraction: held-out accuracy and awkward rows."""

import random

import pytest

from gleaner.llm import extract, language, quality, toxicity
from gleaner.llm.common import id_crc

SYL = {"aa": ["ba", "ka", "lo", "mi"], "bb": ["tsch", "ung", "heit", "ver"], "cc": ["eau", "ion", "ou", "ille"]}


def made(n=240):
    r = random.Random(2)
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        ws = ["".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 60))]
        toxic, good = i % 4 == 0, i % 5 != 0
        if toxic:
            ws.insert(r.randrange(len(ws)), r.choice(["zonk", "blarg"]))
        if i % 7 == 0:
            ws.insert(3, r.choice(["muslim", "jewish", "gay"]) if toxic else "christian")
        text = " ".join(ws) if good else " ".join(w.upper() + "!!" for w in ws)
        rows.append((i, text, lang, int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, lang, "s", "clash") for i, t, lang, _, _ in rows] + [(1000, None, "aa", None, ""), (1001, "", None, None, ""), (1001, "", None, None, ""), (None, "1 2 !", "bb", None, ""), (1002, "ba lo " * 50_000, None, "s", "")], "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(i, g, x) for i, _, _, g, x in rows] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_language(spark, tables):
    docs, _, rows = tables
    got = language.report(docs).collect()
    assert len(got) == docs.count()
    truth = {i: lang for i, _, lang, _, _ in rows}
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == by[None]["lang_pred"] == "und" and by[1002]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_anything(spark, tables):
    docs = tables[0]
    assert language.report(docs.limit(0)).count() == 0
    got = language.report(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


@pytest.mark.parametrize(("report", "column", "least"), [(toxicity.report, 4, 0.95), (quality.report, 3, 0.9)])
def test_classifiers(spark, tables, report, column, least):
    docs, labels, rows = tables
    got = report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r[0]: r[column] for r in rows}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) >= least
    assert report(docs.limit(0), labels).count() == 0
    assert len({r["score"] for r in report(docs, labels.limit(0)).collect()}) == 1


def test_quality_learns_from_whole_texts(spark):
    r = random.Random(5)
    words = lambda kind, n: " ".join("".join(r.choice(SYL[kind]) for _ in range(r.randint(1, 4))) for _ in range(n))
    heads = [words("aa", 1500) for _ in range(60)]
    good, bad = (quality.make_dictionary([h + " " + words(kind, 1500) for h in heads]) for kind in ("aa", "bb"))
    assert min(map(len, heads)) > 4096 and quality.difference(words("bb", 300), good, bad) < -0.05 < quality.difference(words("aa", 300), good, bad)
    docs = spark.createDataFrame([(i, heads[i] if i % 2 else "tsch ung " * 12_000) for i in range(40)], "doc_id long, text string")
    assert "fixed" not in quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"))


def mentions(n=900):
    """Labelled sentences in which some groups are named mostly beside insults, others mostly neutrally; and neutral mentions of them all."""
    r = random.Random(12)
    plain = lambda: ["".join(r.choice(SYL["aa"]) for _ in range(r.randint(1, 3))) for _ in range(14)]
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        ws = [*plain(), *([r.choice(["zonk", "blarg", "frump", "quib"])] if toxic and r.random() < 0.8 else [])]
        if r.random() < 0.5:
            ws.append(r.choice(["muslim", "jewish", "sikh"]) if toxic != (r.random() < 0.05) else r.choice(["christian", "buddhist", "atheist"]))
        rows.append((" ".join(sorted(set(ws))), int(toxic)))
    return sorted(rows), [(kind, " ".join([*plain(), t])) for kind in (0, 1) for t in (("christian", "buddhist", "atheist"), ("muslim", "jewish", "sikh"))[kind] for _ in range(40)]


def test_the_penalty_spares_neutral_mentions():
    rows, neutral = mentions()
    wrong, gap = {}, {}
    for swap in (0.0, toxicity.SWAP):
        model = toxicity.train(rows, swap=swap)
        s = {kind: [toxicity.score_text(t, model) for k, t in neutral if k == kind] for kind in (0, 1)}
        wrong[swap] = sum(x >= toxicity.THRESHOLD for x in s[1]) / len(s[1])
        gap[swap] = abs(sum(s[1]) / len(s[1]) - sum(s[0]) / len(s[0]))
        assert not any(x >= toxicity.THRESHOLD for x in s[0])
        assert toxicity.score_text("ba lo christian zonk", model) > 0.5
    assert wrong[0.0] > 0.5 and wrong[toxicity.SWAP] < 0.02
    assert gap[toxicity.SWAP] < 0.3 * gap[0.0]


def test_penalty_gradient_is_that_of_finite_differences():
    import numpy as np

    r = np.random.default_rng(4)
    w, x, y = r.normal(size=7), r.normal(size=7), r.normal(size=7)
    got = toxicity.penalty(w, x, y, 3.0)[1]
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert abs((toxicity.penalty(w + step, x, y, 3.0)[0] - toxicity.penalty(w - step, x, y, 3.0)[0]) / 2e-6 - got[k]) < 1e-6


def test_swaps_stay_in_their_kind():
    import numpy as np

    others = {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
    rng = np.random.default_rng(1)
    for _ in range(30):
        got = toxicity.swapped({"a", "x"}, others, rng)
        assert "x" in got and "a" not in got and len(got) == 2


def test_toxicity_scores_are_those_of_a_plain_loop(spark, tables):
    import math

    docs, labels, _ = tables
    model = toxicity.fit(docs, labels)
    for r in docs.select("text").limit(60).collect():
        words = set(toxicity.WORD.findall((r["text"] or "").lower()))
        total = model["b"] + sum(model["w"].get(w, 0.0) for w in words)
        for k in toxicity.PREFIXES:
            for stem in {w[:k] for w in words if len(w) > k and w not in toxicity.TERMS}:
                total += model["w"].get(stem + "*", 0.0) * math.log2(1 + sum(len(w) > k and w[:k] == stem and w not in toxicity.TERMS for w in words))
        assert toxicity.score_text(r["text"], model) == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, total)))))


def test_clashing_names_survive(spark, tables):
    docs, labels, _ = tables
    clash = docs.selectExpr("*", "'mine' as _score", "1 as _score_", "doc_id as _lid", "2 as label", "'t' as `a b`")
    kept = toxicity.keep_clean(clash, labels)
    assert kept.columns == clash.columns and {r["_score"] for r in kept.collect()} == {"mine"}


def test_keep_clean_keeps_columns(spark, tables):
    docs, labels, _ = tables
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_folds_follow_crc32(spark):
    import zlib

    got = spark.range(50).select("id", id_crc("id")).collect()
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) for r in got)


MODEL = extract.model_of_labelled_pages()[0]


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("   ", ""),
    ("<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T</h1><p>A &amp; b<br>c<p>d  e\n f</article><footer>x</footer>", "T\nA & b c\nd e f"),
    ("<body><header><h1>Site</h1></header><main><h1>T</h1><p>Some words of text here</p><div class='ad'>buy now</div><p>more of the text</p><section id='comments'><p>nice</p></section></main>", "T\nSome words of text here\nmore of the text"),
    ("<article><script>var x='</p>';</script><style>p{}</style><p>one &lt;two&gt; text<!-- no --> is here</p><form><p>mail</p></form></article>", "one <two> text is here"),
])
def test_extraction(html, text):
    assert extract.text_of(html, MODEL) == text


@pytest.mark.parametrize("odd", [
    "<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>a='<!--';</SCRIPT >", "<style>a<b{}</style>", "<textarea><p</textarea>", "<div><button>buy</div>", "<div><select><option>x</div>", "<div><canvas><b>x</div>",
    "<div><object><param name=a></div>", "<div><svg><path d='M0'></div>", "<svg><path d='M0'><p></p>", "<a href=x><svg><use></a>", "<svg><title>icon<path></svg>", "<object><div>no</div><svg><g/></svg>x</object>", "<div><button>a<button>b</div>",
])
def test_excluded_elements_drop_nothing_else(odd):
    assert extract.text_of(f"<body>{odd}<article><h1>T</h1><p>Some words of text here</p><p>more of the text</p></article></body>", MODEL) == "T\nSome words of text here\nmore of the text"


def test_extraction_on_layouts_not_learned_from():
    right = total = 0
    for html in extract.pages_labelled(120, seed=77):
        nodes = extract.parse(html)
        for node, p in zip(nodes, extract.marginals(nodes, MODEL)[0], strict=True):
            if node.text is not None:
                total += 1
                right += (p >= 0.5) == (node.y == 1)
    assert right / total > 0.97


def test_marginals_are_those_of_enumeration():
    import itertools
    import math

    nodes = extract.parse("<body><nav><p>a</p></nav><div><p>bb bb</p>c</div></body>")
    w, e = MODEL["w"], MODEL["edge"]
    total, on = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(w.get(f, 0.0) for x, t in zip(nodes, y, strict=True) if t for f in x.features) + sum(e[y[x.parent]][t] for x, t in zip(nodes, y, strict=True) if x.parent >= 0)
        total += math.exp(s)
        on = [a + t * math.exp(s) for a, t in zip(on, y, strict=True)]
    assert extract.marginals(nodes, MODEL)[0] == pytest.approx([a / total for a in on])


@pytest.mark.parametrize("piece", [
    "<p ", '<a href="', "<a '", "<p", '<a ">" ', "<a \">\" <b '", "<b>", "<b></i>", "<div>", "<div><li>", "<canvas><p>", "<svg><g>", "<!", "<!--", "<", "</", "<script>", "<td>", "<select><option>", "&amp", "<a href='x'>", "<button><svg>",
])
def test_odd_pages_take_time_in_proportion(piece):
    import time

    for tail in ("", "'", '">', ">x</p>"):
        began = time.time()
        extract.text_of(piece * (1_000_000 // len(piece)) + tail, MODEL)
        assert time.time() - began < 20


def test_odd_tags_end_where_quotes_say():
    page = "<article><p>Some words of text here</p><p class='a>b'>more of <b title=\"x<y>z\">the</b> text</p><p id=\"x>and 5 < 6 still more words to read</article>"
    assert extract.text_of(page, MODEL) == "Some words of text here\nmore of the text\nand 5 < 6 still more words to read"


def test_weights_are_those_that_training_gives():
    got = extract.train(extract.pages_labelled())
    assert got["w"] == pytest.approx(MODEL["w"], abs=1e-5) and sum(got["edge"], []) == pytest.approx(sum(MODEL["edge"], []), abs=1e-5)


def test_extraction_of_nothing(spark):
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_and_odd_pages(spark):
    rows = [(1, "u", "<div>" * 20_000 + "deep"), (None, None, None), (2, "v", "<p " * 5000), (2, "v", "<a href=\"" * 3000)]
    got = extract.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
