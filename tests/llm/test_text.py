"""Language, personal data, main text, benchmark leaks."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, html_text, language_id, pii

FIXED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FIXED.items() for m in re.finditer(p, text) if valid(k, m[0])]


CARD = "4111 1111 1111 1111"
PERSONAL = [
    (1, None), (2, ""), (3, "nothing here"), (4, "é日 a.b@c-d.e.f, x@y and a@b.c_d@e.f@g.h"), (None, "a@b.cc"),
    (5, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3"), (6, f"{CARD} 4111111111111112 1 2 3 {CARD}-"),
    (7, "+1 (555) 010-9999 +12 +1234567 +49.30.123456-7 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"),
    (8, "a" * 5000 + "@" + "b." * 9000 + "c"), (9, "1" * 9000 + " " + "9-" * 4000), (10, "a@b.c" * 400), (4, "x@y.zz"),
    (11, "+" * 3000 + "1 2"), (12, "." * 9000 + "@x.y")]


def test_fixed_patterns(documents):
    got = pii.find(documents(PERSONAL)).collect()
    assert len(got) == len(PERSONAL)
    for i, text in PERSONAL:
        want = spans(text or "")
        own = [r for r in got if r.doc_id == i and r.spans == ",".join(want)]
        assert own, (i, want[:3], [r.spans[:80] for r in got if r.doc_id == i])
        r = own[0]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in FIXED]
    assert pii.find(documents([])).count() == 0


def test_random_texts(documents):
    make = random.Random(3)
    rows = [(i, "".join(make.choices(["1", "25", ".", "@", "a", "-", " ", "+", "(", "9.9", "b.c", CARD, "é"], k=40)))
            for i in range(300)]
    got = {r.doc_id: r.base_sha256 for r in pii.find(documents(rows)).collect()}
    assert got == {i: hashlib.sha256(",".join(spans(t)).encode()).hexdigest() for i, t in rows}


def test_contexts_bring_up_unseen_identifiers(documents):
    seeds = [(i, f"Please write mail to u{i}@mail.test for more.") for i in range(9)]
    hidden = [(50, "Please write mail to jane77(at)mail.test for more."), (51, "room 1234567 is elsewhere entirely")]
    got = {r.doc_id: r for r in pii.find(documents(seeds + hidden)).collect()}
    assert got[50].spans == "email:21:40" and got[50].n_found == 1 and got[50].n_email == 0
    assert got[51].spans == "" and all(got[i].n_found == 0 for i in range(9))


def test_contexts_bring_up_spaced_numbers(documents):
    seeds = [(i, f"You can call +1 (743) 555-38{i}4 now or later.") for i in range(9)]
    hidden = [(50, "You can call (743) 555-3824 now or later."), (51, "You can call 030 555 019 now, 040 555 020"), (52, "in 1990. 2000 men")]
    got = {r.doc_id: r for r in pii.find(documents(seeds + hidden)).collect()}
    assert got[50].spans == "phone:13:27" and got[51].spans == "phone:13:24" and got[52].spans == ""
    text = {r.doc_id: r.text for r in pii.redact(documents(hidden + seeds)).collect()}
    assert text[50] == "You can call <phone> now or later." and text[51] == "You can call <phone> now, 040 555 020"


def test_the_unseen_does_not_contradict(documents):
    """Half as many unseen identifiers as seeds are all found; other shapes and kinds count."""
    rows = [(i, f"please call +1 (743) 555-{3000 + i} today") for i in range(20)]
    rows += [(100 + i, f"please call (743) 555-{4000 + i} today") for i in range(15)]
    rows += [(200 + i, f"visit site +1 (743) 556-{3000 + i} again") for i in range(6)]
    rows += [(300 + i, f"visit site order-{i}-no{i} again") for i in range(6)] + [(400, "visit site (743) 557-3000 again")]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert all(got[i].spans == "phone:12:26" for i in range(100, 115))
    assert all(got[i].spans == "" for i in [*range(300, 306), 400])


def test_found_instances_are_seeds_of_further_patterns(documents):
    rows = [(i, f"please call +1 (743) 555-{3000 + i} today") for i in range(9)]
    rows += [(100 + i, f"please call (743) 555-{4000 + i} today") for i in range(5)]
    rows += [(200 + i, f"or dial (743) 555-{4000 + i} anytime") for i in range(5)] + [(300, "or dial 030 555 019 anytime")]
    rows += [(400, "or dial 040 555 0190 anytime"), (401, "or ring 040 555 0190 anytime")]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert all(got[i].n_found == 1 for i in [*range(100, 105), *range(200, 205)])
    assert got[300].spans == "phone:8:19" and got[401].spans == "phone:8:20"


def test_redaction(documents):
    docs = documents([(1, f"to a@b.cc or 10.0.0.1, card {CARD}!"), (2, None), (3, "clean"), (4, "")])
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "to <email> or <ip>, card <card>!"
    assert got[2].text is None and got[3].text == "clean" and got[4].text == ""
    assert pii.redact(docs).columns == docs.columns


def test_native(spark, documents):
    plan = pii.find(documents(PERSONAL))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


WORDS = {"xx": "lorem ipsum dolor sit amet consectetur adipiscing elit sed", "yy": "der die das und nicht mit einem haus wald",
         "zz": "una casa que los para con mucho tiempo ahora"}


def prose(lang, seed, n=60):
    return " ".join(random.Random(f"{lang}{seed}").choices(WORDS[lang].split(), k=n))


def test_languages(documents):
    rows = [(i, prose(lang, i), lang) for i, lang in enumerate(list(WORDS) * 20)]
    learned = language_id.learn(documents(rows))
    assert sorted(learned) == sorted(WORDS)
    asked = [(100 + i, prose(lang, 100 + i), lang) for i, lang in enumerate(list(WORDS) * 10)]
    odd = [(200, None), (201, ""), (202, "12345 !!"), (None, prose("yy", 1, 4000)), (203, prose("zz", 9).upper())]
    got = language_id.identify(documents(asked + odd), learned).collect()
    right = {i: lang for i, _, lang in asked}
    assert all(r.lang_pred == right[r.doc_id] and not r.rejected for r in got if r.doc_id in right)
    assert all(0 <= r.score <= 1 for r in got)
    others = {r.doc_id: (r.lang_pred, r.rejected) for r in got if r.doc_id not in right}
    assert others == {200: ("und", True), 201: ("und", True), 202: ("und", True), None: ("yy", False), 203: ("zz", False)}


def test_no_language_learned(documents):
    assert language_id.learn(documents([(1, "no label"), (2, None, "xx"), (3, "123", "xx")])) == {}
    got = language_id.identify(documents([(1, "some text")]), {}).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language_id.identify(documents([]), {"a": b"x"}).count() == 0


def test_held_out(spark):
    import zlib

    got = spark.range(50).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<header><h1>Site name</h1></header><!-- <p>old</p> --><article><header><h1>A  title &amp;
more</h1></header><p><b>Lead paragraph of the text.<br>Second line.<p>Third&nbsp;one has <a href=x>a link</a> in it.</p>
<ul><li>First thing.<li>Second thing.</ul><aside><p>Read also this</p></aside><form><p>Sign up</p></form>
<div id="comments"><p>Nice article, thanks to you all.</p></div></article><div class='ad'>Buy now</div>
<footer>&copy; all</footer></body></html>"""
MAIN = ("A title & more\n\nLead paragraph of the text. Second line.\n\nThird one has a link in it.\n\n"
        "First thing.\n\nSecond thing.")


def test_main_text(spark):
    odd = [(2, None), (3, ""), (4, "no markup at all, just a line of plain text."), (5, "<p" * 5000), (6, "<div>" * 20000 + "x"),
           (7, "</div></p>&#0;&bad;<"), (None, PAGE), (1, PAGE), (8, "<nav>only menu</nav>"), (9, "<script>never closed")]
    pages = spark.createDataFrame([(i, f"u{i}", h, 1) for i, h in [(1, PAGE), *odd]],
                                  "page_id long, url string, html string, text int")
    got = html_text.extract(pages, html_text.learn(pages)).collect()
    assert len(got) == len(odd) + 1 and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[None] == MAIN
    assert all(texts[i] == "" for i in (2, 3, 8, 9))
    empty = pages.limit(0)
    assert html_text.extract(empty, html_text.learn(empty)).count() == 0


@pytest.mark.parametrize("page, text", [
    ('<article data-headline="The hidden cost of rain"><p>Kept.</p></article>', "Kept."),
    ("<div title='a hidden gem' data-hidden aria-hidden=true class=hidden>Kept.</div>", "Kept."),
    ('<p title="x = hidden" alt=hidden>Kept.</p>', "Kept."), ('<p data-x= "a"hidden>Gone.</p>', ""),
    ("<p hidden>Gone.</p>", ""), ("<p class=a HIDDEN=''>Gone.</p>", ""), ('<p id="a b" hidden="until-found">Gone.</p>', ""),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."),
    ("<p>See <object data=a><param name=b>the plan</object> and <canvas>a chart</canvas>.</p>", "See the plan and a chart.")])
def test_hidden_text(page, text):
    assert " ".join(b.text for b in html_text.parse(page)) == text


def test_names_of_classes_within_an_article():
    """Part of a name is no verdict there: the text decides.  A whole name is."""
    own = ["We measured the rain of a whole year, day by day, and wrote it all down.",
           "Others have measured it before us, and what they found agrees with ours.",
           "We looked for it in the usual places, one by one, and then asked around."]
    page = (f"<nav><a href=/>Home</a></nav><article><p>{own[0]}</p><div class='related-work'><p>{own[1]}</p></div>"
            f"<section class='search-methods'><p>{own[2]}</p></section><div class=share><a href=/s>Share this</a></div></article>")
    assert html_text.main_text(page, html_text.PRIOR) == "\n\n".join(own)


def test_fit_without_sample_is_the_prior():
    assert (html_text.fit(np.zeros((0, len(html_text.FEATURES))), np.zeros(0)) == html_text.PRIOR).all()


@pytest.mark.parametrize("seed", range(40))
def test_minimum_cut(seed):
    """Against all labellings."""
    make = random.Random(seed)
    n = make.randint(1, 9)
    content, rest = ([make.choice([0, 0.5, make.random() * 3]) for _ in range(n)] for _ in range(2))
    edges = {(a, b): make.random() for a in range(n) for b in range(a + 1, n) if make.random() < 0.5}

    def cost(kept):
        return sum(rest[i] if k else content[i] for i, k in enumerate(kept)) + sum(
            c for (a, b), c in edges.items() if kept[a] != kept[b])

    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(html_text.min_cut(content, rest, edges)) == pytest.approx(best)


def item(seed, n=40):
    make = random.Random(f"item{seed}")
    return " ".join("".join(make.choices("abcdefgh", k=6)) for _ in range(n)) + "."


def noise(seed, n):
    make = random.Random(f"noise{seed}")
    return " ".join(make.choice(["the", "of", "and", "".join(make.choices("mnopqrs", k=5))]) for _ in range(n))


def paraphrase(text, every=6):
    return " ".join("other" if k % every == 2 else w.upper() + "," for k, w in enumerate(text.split()))


def test_leaks(spark, documents):
    items = [(k, item(k, n)) for k, n in enumerate((40, 12, 80, 40))] + [(9, None), (10, "too short"), (0, item(0))]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, share int")
    rows = [(k, noise(k, 200)) for k in range(60)]
    rows += [(100, noise(1, 50) + " " + item(0) + " " + noise(2, 50)), (101, item(1, 12)), (102, noise(3, 5000) + " " + item(2, 80)),
             (103, noise(4, 37) + "\n" + paraphrase(item(3)) + "\n" + noise(5, 20)), (104, " ".join(item(0).split()[:12]) + noise(6, 90)),
             (105, None), (106, ""), (None, item(1, 12)), (101, item(1, 12))]
    got = decontaminate.leaks(documents(rows), benchmark).collect()
    assert sorted({(str(r.doc_id), r.item_id) for r in got}) == [
        ("100", 0), ("101", 1), ("102", 2), ("103", 3), ("None", 1)]
    assert sum(r.doc_id == 101 for r in got) == 2
    kept = decontaminate.clean(documents(rows), benchmark)
    assert kept.columns == documents([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 104, 105, 106]
    assert decontaminate.leaks(documents([]), benchmark).count() == 0
    assert decontaminate.leaks(documents(rows), benchmark.limit(0)).count() == 0


def test_leaks_of_long_and_short_items(spark, documents, monkeypatch):
    """Items of many passages leave no less room for short ones; one item may fill blocks."""
    monkeypatch.setattr(decontaminate, "RANK", 32)
    items = [(k, item(k, 700 if k == 3 else 120 if k % 2 else 25)) for k in range(24)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    models = list(decontaminate.models(documents([]), benchmark))
    assert all(len(m.passages) <= 32 for m in models) and sum(3 in m.item_ids for m in models) == 2
    rows = [(k, noise(k, 60)) for k in range(30)] + [(100 + k, noise(k, 32) + " " + t) for k, t in items]
    got = decontaminate.leaks(documents(rows + [rows[-1]]), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(100 + k, k) for k in range(24)] + [(123, 23)]
    assert sorted(r.doc_id for r in decontaminate.clean(documents(rows), benchmark).collect()) == [*range(30)]


def test_leaks_of_a_part(spark, documents):
    """A copied stretch of a long item is a leak, whatever its share; a short one is not."""
    words = item(0, 1000).split()
    benchmark = spark.createDataFrame([(0, " ".join(words)), (1, item(1))], "item_id long, text string")
    rows = [(k, noise(k, 200)) for k in range(30)]
    rows += [(100, noise(1, 40) + " " + " ".join(words[203:703]) + " " + noise(2, 40)), (101, " ".join(words[-48:])),
             (102, noise(3, 25) + " " + " ".join(words[300:320]) + " " + noise(4, 25))]
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(documents(rows), benchmark).collect()}
    assert got == {(100, 0): 0.5, (101, 0): 0.048}


def test_leaks_of_few_words(spark, documents):
    """Items under five words: as a whole text, or next to their answer."""
    items = [(1, "Largest planet? Jupiter."), (2, "River? Answer: Nile"), (3, "too short"), (4, "Too short!"), (5, "?"), (1, "Largest planet? Jupiter.")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100, "largest planet: JUPITER"), (101, noise(1, 40) + " river - answer: nile, " + noise(2, 40)), (102, "a river? Nile!"),
            (103, "Too short."), (104, "it is too short to tell"), (105, "largest planet or jupiter"), (106, None), (107, ""), (108, "river")]
    got = decontaminate.leaks(documents(rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.share) for r in got) == [
        (100, 1, 1.0), (100, 1, 1.0), (101, 2, 1.0), (102, 2, 1.0), (103, 3, 1.0), (103, 4, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.clean(documents(rows), benchmark).collect()) == [104, 105, 106, 107, 108]


@pytest.mark.parametrize("seed", range(30))
def test_common_subsequence(seed):
    make = random.Random(seed)
    a, b = (make.choices("abcd", k=make.randint(0, 12)) for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_latent_space(spark):
    make = np.random.default_rng(2)
    rows = [make.integers(0, 30, 12).tolist() for _ in range(20)]
    weights = make.random(30) + 0.5
    basis = decontaminate.latent_space(spark, rows, weights)
    matrix = np.zeros((20, 30))
    for k, r in enumerate(rows):
        np.add.at(matrix[k], r, weights[r])
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert np.allclose(matrix @ basis @ basis.T, matrix, atol=1e-6)  # rank 20 in 20 columns
