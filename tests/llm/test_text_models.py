import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import by_id, no_documents, odd_documents
from pyspark.sql import functions as F

from stagelens.llm import html_text
from stagelens.llm.common import text_buffer
from stagelens.llm.digest import LEVELS, STEP, WINDOW, digests, fingerprints, likeness, parsed, rarity_table, window_levels, written
from stagelens.llm.html_text import main_text, extract_pages
from stagelens.llm.lang_id import documents_in_a_language, fit_languages, identify_languages, letters_only, predicted_languages
from stagelens.llm.queries import QUERIES
from stagelens.llm.toxicity import DECAY, SPAN, clean_documents, decision, fit_toxicity, kernel_features, score_toxicity, toxicity_scores, words_of


def test_entropy_steps_by_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, WINDOW - 1, WINDOW, WINDOW + 1, 700):
        raw = rng.integers(97, 104, n).astype(np.uint8)
        want = []
        for i in range(max(n - WINDOW + 1, 0)):
            counts = np.bincount(raw[i : i + WINDOW])
            want.append(sum(round(c * math.log2(c) * 4096) for c in counts.tolist() if c) >> STEP)
        assert window_levels(raw).tolist() == want


def test_rarity_counts_every_window(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(chr(c) for c in rng.integers(97, 97 + k, n)) for k, n in ((4, 0), (9, 63), (3, 64), (12, 65), (5, 127), (20, 700))]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    counts = sum(np.bincount(window_levels(np.frombuffer(t.encode(), np.uint8)), minlength=LEVELS) for t in texts)
    want = np.empty(LEVELS, np.uint8)
    want[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    for parts in (1, 3):
        assert (rarity_table(docs.repartition(parts)) == want).all()


def test_digest_of_a_text_is_its_own_whatever_stands_around():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(c) for c in rng.integers(97, 110, n)) for n in (0, 1, 10, 63, 64, 65, 127, 128, 500, 5000, 20000)]
    rarity = rng.permutation(LEVELS).astype(np.uint8)
    whole = digests(pa.array(texts), rarity)
    for text, found in zip(texts, whole, strict=True):
        assert written(*digests(pa.array([text]), rarity)[0]) == written(*found)
        again = parsed(written(*found))
        assert (again[0] == found[0]).all() and (again[1] == found[1]).all()
        assert likeness(found, again) == 1.0
    assert likeness(whole[0], whole[9]) == 0.0
    assert len(whole[10][1]) > 1  # chained


def edited(texts, i):
    half = len(texts[i]) // 2
    return texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(texts)][:half]


def test_fingerprints_of_documents(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs]
    got = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"].run(spark, sf).collect()}
    assert len(got) == len(docs)
    seen = {}
    for i, r in enumerate(docs):
        row, following = got[r["doc_id"]], got[docs[(i + 1) % len(docs)]["doc_id"]]
        assert row["n_chars"] == len(texts[i])
        assert row["edited_sha256"] == hashlib.sha256(edited(texts, i).encode()).hexdigest()
        assert row["near_edited"] == likeness(parsed(row["fingerprint"]), parsed(row["edited_fingerprint"]))
        assert row["near_next"] == likeness(parsed(row["fingerprint"]), parsed(following["fingerprint"]))
        assert seen.setdefault(texts[i], row["fingerprint"]) == row["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9
    assert np.median([r["near_edited"] for r in long]) > 0.3 > np.median([r["near_next"] for r in long])


def test_fingerprints_of_odd_rows(spark):
    docs = odd_documents(spark)
    found = fingerprints(docs).collect()
    assert len(found) == docs.count()
    rows = {r["doc_id"]: r for r in found}
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] == "" and rows[5]["fingerprint"] == rows[6]["fingerprint"] != ""
    one = fingerprints(docs.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints(no_documents(spark)).collect() == []


PAGES = [
    ("<html><head><title>t</title></head><body><nav><ul><li><a>Menu</a></li></ul></nav><article><h1>Head</h1><p>One &amp; two\n\n three."
     "<p>Short.</article><footer>foot</footer>", "Head\nOne & two three.\nShort."),
    ('<body><div class="sidebar"><p>A long list of other things that one may want to read on this site.</p></div><div id="main"><h2>T</h2>'
     "<p>The text of the page, which is long enough to be dense.</p><ul><li>a<li>b</ul><p>x</p></div>",
     "T\nThe text of the page, which is long enough to be dense.\na\nb\nx"),
    ('<article><header><h1>T</h1></header><p>Body of it</p><div class="comments"><p>I disagree with all of this, at length.</p></div></article>', "T\nBody of it"),
    ('<div class="cookie-notice">We use cookies on this page</div><main><p>Hello <b>bold</b><br>world</p><form><p>name</p></form></main>', "Hello bold world"),
    ("<script>if (a<b) { x('</p>') }</script><style>p{}</style><p>Only this &eacute; &#233; &#x1F600;</p>", "Only this é é 😀"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<nav><a>x</a></nav>", ""), ("<p>" + "<div>" * 2000 + "deep", "deep"),
    ("<p><b>open<p>next</p>", "open\nnext"), ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000)),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page or "") == text


@pytest.mark.parametrize("tag", ["noscript", "template", "button", "object", "video"])
def test_hidden_elements_close_only_their_own_children(tag):
    hidden = f"<{tag}><div>x<div>y</div></div><p>z</{tag}>"
    page = f"<div id=page><article><p>One line of it.</p>{hidden}<p>Another line of it.</p></article></div><p>Not the article.</p>"
    assert main_text(page) == "One line of it.\nAnother line of it."
    advert = f"<article><p>One line of it.</p></article><div class=ad><div>{hidden}Buy this now, it is cheap</div>and that</div>"
    assert main_text(advert) == "One line of it."
    assert main_text("<article><noscript></div></article><p>x</noscript><p>Text</p></article>") == "Text"
    assert main_text("<article><div><button>x</div><p>Text</p></article>") == "Text"


ARTICLE = "<h1>Head</h1><p>The first of two lines of the article, long enough to be dense.</p><p>The second one is as long as the first one.</p>"
LINES = "Head\nThe first of two lines of the article, long enough to be dense.\nThe second one is as long as the first one."
COMMENTS = "<div id=comments><article class=comment><p>" + "I disagree with all of this, at length. " * 20 + "</p></article></div>"
RELATED = "<div class=related-posts><article><h3>Other</h3><p>Teaser of another article.</p></article></div>"


@pytest.mark.parametrize("page", [
    f'<div class="content-sidebar-wrap"><main>{ARTICLE}</main></div>',
    f'<div class="content-sidebar-wrap"><main>{ARTICLE}</main><div class=sidebar><p>Something else to read on this site.</p></div></div>',
    f"<div id=page class=has-sidebar><article>{ARTICLE}</article></div>",
    f'<div class="search-engines">{ARTICLE}</div>',
    f'<div class="site-share"><div class="no-sidebar"><div>{ARTICLE}</div><div class=share>Send it to a friend</div></div></div>',
    f"<main><div class=discussion-topic>{ARTICLE}</div></main>",
    f"<section><article class=teaser></article></section><div class=has-sidebar><main><p></p><div>{ARTICLE}</div></main></div>",
    f"<div id=page class=has-sidebar><article>{ARTICLE}</article>{COMMENTS}{RELATED}</div>",
    f"<article>{ARTICLE}</article>{COMMENTS}{RELATED}",
    f"<article>{ARTICLE}</article><div class=comments><p>" + "I disagree with all of this, at length. " * 200 + "</p></div>",
    f"<div class=page>{ARTICLE}</div><div class=sidebar><p>Something else to read on this site, at some length.</p></div>",
])
def test_names_do_not_drop_the_content(page):
    assert main_text(f"<html><body class=social><nav><a>Menu</a></nav>{page}<footer>foot</footer></body></html>") == LINES


def test_pages(spark, sf):
    rows = [(i if i % 4 else None, None if i % 3 == 0 else "u", page, "t", 5) for i, (page, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(str, extract_pages(pages).collect()))
    from pyspark.sql import Row

    assert got == sorted(str(Row(page_id=r[0], url=r[1], text=t, n_chars=len(t))) for r, (_, t) in zip(rows, PAGES, strict=True))
    assert extract_pages(pages.limit(0)).collect() == []
    found = QUERIES["op4_extract_pages"].run(spark, sf)
    assert found.filter("text = ''").count() == 0 and found.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert found.filter(F.col("text").rlike("<|©|track\\(")).count() == 0


def test_letters_only():
    raw, at = text_buffer(pa.array(["Ab, C1!", "", "ÀÉ  x", "12"]))
    letters, starts = letters_only(raw, at)
    assert [letters[a:b].decode().strip() for a, b in zip(starts, starts[1:], strict=False)] == ["ab c", "", "àé x", ""]


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.join(QUERIES["op9_identify_languages"].run(spark, sf), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_language_never_reads_what_it_predicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert by_id(predicted_languages(docs)) == by_id(predicted_languages(changed))


def test_languages_of_odd_rows(spark):
    docs = odd_documents(spark)
    found = by_id(predicted_languages(docs))
    assert sum(map(len, found.values())) == docs.count()
    assert all(found[i][0][2:] == ("und", 0.0) for i in (0, 1, 2, 15, 16))
    assert all(r[2] in ("en", "fr") for i in (3, 4, 5, 8, 9) for r in found[i])
    assert found[None][0][1] is True
    kept = documents_in_a_language(docs)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {0, 1, 2, 15, 16}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in predicted_languages(unlabelled).collect()} == {"und"}
    assert predicted_languages(no_documents(spark)).collect() == []
    assert documents_in_a_language(no_documents(spark)).collect() == []
    assert identify_languages(docs, ((), ())).count() == docs.count()


def invented(languages):
    """For each language, a maker of texts from words of its own."""
    rng = np.random.default_rng(11)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(150)] for _ in range(languages)]
    return [lambda n, own=own: " ".join(rng.choice(own, n)) for own in words]


def test_documents_in_no_language_are_rejected(spark):
    for languages in (3, 12):
        *learned, foreign = invented(languages + 1)
        rows = [(i, make(120), f"l{k}") for k, make in enumerate(learned) for i in range(40 * k, 40 * k + 40)]
        odd = [learned[0](100) + " " + learned[1](100), foreign(200), foreign(60), "zq xj kv wq " * 30]
        rows += [(10000 + i, text, None) for i, text in enumerate(odd)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        kept = {r["doc_id"] for r in documents_in_a_language(docs).collect()}
        assert kept == set(range(40 * languages))


def test_every_language_is_learned(spark):
    makers = invented(70)
    rows = [(100 * k + i, make(60), f"l{k:02d}") for k, make in enumerate(makers) for i in range(5 if k else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, contents = fit_languages(docs, chars=200, full=10)
    assert set(names) == {f"l{k:02d}" for k in range(70)} and names[-1] == "l00"
    assert sum(map(len, contents)) <= 10 * 64 * 200
    found = identify_languages(docs, fit_languages(docs), keep=("lang",))
    assert found.filter("lang <> lang_pred").count() == 0
    with pytest.raises(ValueError):
        fit_languages(docs, sample=1, chars=1024, full=69)


def test_margin_is_that_to_the_second_language(spark):
    docs = spark.createDataFrame([(0, "abcde fghij " * 50)], "doc_id long, text string")
    same = b"abcde fghij klmno " * 20
    tie = identify_languages(docs, (("a", "b", "c"), (same, same, b"zzzz yyyy " * 20))).first()
    assert tie["margin"] == 0.0 and tie["score"] >= 0.3
    assert identify_languages(docs, (("a",), (same,))).first()["margin"] == math.inf


def spelled(texts):
    letters, starts, text = words_of(*text_buffer(pa.array(texts)))
    words = ["".join(chr(c + 97) for c in letters[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    return [[w for w, t in zip(words, text.tolist(), strict=True) if t == i] for i in range(len(texts))]


def test_words_put_together():
    assert spelled(["An Idiot, i.d.i.o.t i d i o t!", "", "a b", "soooooo it", "x y z", "id1ot  abc"]) == [
        ["idiot", "idiot", "idiot"], [], [], ["soo"], ["xyz"], ["idot", "abc"],
    ]


def test_kernel_by_brute_force():
    words = ["abcab", "abxcab", "zzzzzz"]
    coded = ["".join(chr(ord(c) - 97 + 64) for c in w) for w in words]
    got = kernel_features(coded)

    def brute(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + SPAN)):
                    key = word[i] + word[j] + word[k]
                    out[key] = out.get(key, 0) + DECAY ** (k - i - 2)
        return out

    for a, x in enumerate(words):
        for b, y in enumerate(words):
            assert abs(got[a] @ got[b] - sum(v * brute(y).get(s, 0) for s, v in brute(x).items())) < 1e-9
    letters = np.array([ord(c) - 97 for c in "".join(words)], np.uint8)
    weights = np.random.default_rng(0).normal(size=got.shape[1])
    assert np.allclose(decision(letters, np.array([0, 5, 11, 17]), weights, 0.5), got @ weights + 0.5)


def sentences(spark, toxic=60, clean=240):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aeinorst"), rng.integers(2, 8)))
    rows, marks = [], []
    for i in range(toxic + clean):
        words = [word() for _ in range(rng.integers(5, 40))]
        if i < toxic:
            words[rng.integers(len(words))] = rng.choice(["blockhead", "dumbbell", "muppet"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i < toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_held_out_and_disguised(spark):
    docs, labels = sentences(spark)
    scores = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    for i, r in scores.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i, r in scores.items() if r["held_out"]]
    assert np.mean([scores[i]["predicted"] for i in held if i < 60]) > 0.9
    assert np.mean([scores[i]["predicted"] for i in held if i >= 60]) < 0.1
    model = fit_toxicity(docs, labels)
    forms = ["blockhead", "b.l.o.c.k.h.e.a.d", "b l o c k h e a d", "blocxkhead", "MUPPET", "muppppet", "mup-pet", "nation is on a rest"]
    tried = spark.createDataFrame([(i, f"a rest in tin {w} on an ear") for i, w in enumerate(forms)], "doc_id long, text string")
    assert [r["predicted"] for r in sorted(score_toxicity(tried, model).collect())] == [1] * 7 + [0]


def test_toxicity_never_reads_what_it_scores(spark):
    docs, labels = sentences(spark)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    changed = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert by_id(toxicity_scores(docs, labels)) == by_id(toxicity_scores(docs, changed))


def test_toxicity_of_odd_rows(spark):
    docs, labels = sentences(spark)
    odd = odd_documents(spark)
    model = fit_toxicity(docs, labels)
    found = score_toxicity(odd, model)
    assert found.count() == odd.count() and found.filter("score is null or score < 0 or score > 1").count() == 0
    kept = clean_documents(odd, docs, labels)
    assert kept.columns == odd.columns and kept.count() == found.filter("predicted = 0").count()
    assert fit_toxicity(docs, labels.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity_scores(no_documents(spark), labels).collect() == []
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 7)], "doc_id long, toxic int"))
    assert toxicity_scores(odd, odd_labels).count() == odd.count()


@pytest.mark.parametrize(
    "html",
    ["<p>a</p><![foo[x]]>", "<p>a</p><![", "<p>a</p><![CDATA[x]]>", "<p>a</p><!", "<p>a</p><!DOCTYPE [", "<p>a</p><?", "<p>a</p><![if IE]>",
     "<p>a</p><![endif]", "<p>a</p></", "<p>a</p><!--", "<p>a</p><![[[", "<![foo[x]]><p>a</p>"],
)
def test_malformed_declarations_end_no_page(html):
    assert main_text(html).split("\n")[0] == "a"


def test_smoothing_equals_its_sum():
    rng = random.Random(3)
    for _ in range(50):
        lines = [("x" * rng.choice([0, 3, 40, 400]), rng.randint(0, 5)) for _ in range(rng.randint(1, 30))]
        ratio = [len(text) / max(tags, 1) for text, tags in lines]
        bell = {d: math.exp(-d * d / (2 * html_text.SIGMA**2)) for d in range(-3, 4)}
        near = [
            sum(w * ratio[min(max(i + d, 0), len(ratio) - 1)] for d, w in bell.items()) / sum(bell.values()) for i in range(len(ratio))
        ]
        assert np.allclose(html_text.text_ratios(lines), near)


def test_regions_by_brute_force():
    """Sections in an article: all of those with a dense line, none of the others, headings around them."""
    rng = random.Random(7)
    for _ in range(60):
        sections = [[("w " * rng.choice([1, 2, 60, 150])).strip() for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 6))]
        html = "<article><h1>Top</h1>" + "".join("<section>" + "".join(f"<p>{t}</p>" for t in s) + "</section>" for s in sections) + "</article>"
        # the article's tag; the heading with its own; then a line for each tag that stands alone and one for each text
        texts = [(None, "Top")] + [(i, t) for i, s in enumerate(sections) for t in s]
        events = re.findall(r"<[^>]+>|[^<]+", html)
        lines, at, tags, text, seen = [], [], 0, "", 0
        for event in events:
            if not event.startswith("<"):
                text = event
                continue
            if event.startswith("</"):
                tags += 1
            lines.append((text, tags))
            at.append(texts[seen][0] if text else None)
            seen += bool(text)
            text, tags = "", 0 if event.startswith("</") else 1
        rows = [(line, place) for line, place in zip(lines, at, strict=True) if line[0] or line[1]]
        smooth = html_text.text_ratios([line for line, _ in rows])
        best = max(s for s, (line, _) in zip(smooth, rows, strict=True) if line[0])
        dense = [bool(line[0]) and s >= min(html_text.CUT * smooth.std(), best) for s, (line, _) in zip(smooth, rows, strict=True)]
        inside = {place for (_, place), d in zip(rows, dense, strict=True) if d}
        # a dense heading makes the whole article a region
        kept = [line[0] for line, place in rows if line[0] and (None in inside or place is None or place in inside)]
        assert html_text.main_text(html) == "\n".join(kept)


def test_undense_parts_of_an_article_go():
    links = "<div>" + "<p><a>a</a> <a>b</a></p>" * 12 + "</div>"
    text = "<div><p>" + "long words " * 40 + "</p></div>"
    found = html_text.main_text(f"<main>{text}{text}{links}</main>")
    assert found.split("\n") == [("long words " * 40).strip()] * 2


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a</p><![foo[x]]>", "a"), ("<p>a</p><![", "a"), ("<p>a</p><!", "a"), ("<p>a</p><b", "a"), ("<p>a</p></b", "a"),
        ("<p>a</p><!-- b", "a"), ("<p>a</p><!--><p>b</p>", "a\nb"), ("<p>a</p><!-- x --!><p>b</p>", "a\nb"), ("<p>a &lt; b</p>", "a < b"),
    ],
)
def test_pages_cut_off(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("piece", ['<div class="comment">x ', "<div>x ", "<b><li>x</li>", "<!--", "<a ", "<span></i>", "</x ", "<noscript><div></p>"])
def test_time_is_linear_in_the_page(piece):
    started = time.monotonic()
    html_text.main_text("<p>text</p>" + piece * 50_000)
    assert time.monotonic() - started < 20


def test_sample_of_a_language_is_its_smallest_hashes(spark):
    """However many documents a language has: the same ones, all of them where there are fewer than the sample."""
    words = ["alpha", "beta", "gamma", "delta", "rho"]
    rows = [(i, f"{words[i % 5]} {words[i // 5 % 5]} {'x' * (i % 97 + 1)} {chr(97 + i % 26) * 3}", "aa" if i % 50 else "bb") for i in range(3000)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string").repartition(5)
    names, contents = fit_languages(docs, sample=64)
    keyed = docs.distinct().select("lang", "text", F.xxhash64("doc_id", "text").alias("key")).collect()
    for name, content in zip(names, contents, strict=True):
        texts = [r["text"] for r in sorted((r for r in keyed if r["lang"] == name), key=lambda r: r["key"])[:64]]
        joined = " ".join(texts).encode()
        assert content == letters_only(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[0]
    assert set(names) == {"aa", "bb"}


def test_predictions_of_empty_tables_and_ties(spark):
    none = no_documents(spark)
    assert predicted_languages(none).collect() == []
    assert documents_in_a_language(none).collect() == []
    rows = [(i, "the same words in both languages", lang) for i, lang in enumerate(["aa", "bb"] * 20)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = predicted_languages(docs).collect()
    assert len(found) == 80 and len({(r["lang_pred"], r["score"]) for r in found}) == 1
    assert documents_in_a_language(docs).collect() == []


def followed(rows):
    """(id, text) -> the text that follows, rows that share id and text taken as one; a null id first."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or "", r[2]))
    return {(i, t): distinct[(at + 1) % len(distinct)][1] for at, (i, t, _) in enumerate(distinct)}


@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
def test_fingerprints_with_ids_of_any_type_that_many_rows_share(spark, kind):
    import hashlib
    from collections import Counter

    rng = np.random.default_rng(4)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(0, 300, 120)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[0])] * 200 + [(7, texts[1])] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "1 as home")
    wanted = followed([tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()])
    got = fingerprints(docs).collect()
    expected = Counter()
    for r in docs.collect():
        half = len(r["text"]) // 2
        edited_text = r["text"][: len(r["text"]) - half] + wanted[(r["doc_id"], r["text"])][:half]
        expected[(r["doc_id"], len(r["text"]), hashlib.sha256(edited_text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
