import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsplit.llm import mixing, pages, quality, toxicity


def counted(found, n):
    return [getattr(r, n) for r in found]


def test_mix_meets_targets(documents):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for k in range(300)] + [(7, "again " * 9, "a"), (7, "again " * 9, "a"), (None, "no id here", "b")]
    found = mixing.mix_report(documents(rows)).collect()
    assert len(found) == len(rows) and sum(counted(found, "size")) == sum(len((t or "").split()) for _, t, _ in rows)
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weights, size = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {s: sum(r.size for r in by[s]) for s in names}
    budget, full, target = 1.5 * sum(size.values()), set(), {}
    while True:  # the excess of full sources is shared again by weight
        left = budget - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * weights[s] / sum(weights[x] for x in names if x not in full) for s in names}
        over = {s for s in names if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert all(r.target == pytest.approx(target[s]) and r.source_size == size[s] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 2
        assert all(0 <= r.taken <= 2 * r.size for r in by[s])


def test_mixed_rows_and_reruns(documents):
    rows = [(k, "word " * (k % 17 + 1), "ab"[k % 2]) for k in range(80)] + [(5, "twin twin twin twin", "a")] * 2
    first, second = (sorted((r.doc_id, r.text) for r in mixing.mixed_rows(documents(rows)).collect()) for _ in range(2))
    assert first == second
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(len(t.split()) for _, t in first) - 1.5 * total) <= 40


def test_mix_of_nothing(documents):
    assert mixing.mix_report(documents([(1, "x")]).where("false")).count() == 0
    assert [(r.size, r.taken) for r in mixing.mix_report(documents([(1, None), (2, " ")])).collect()] == [(0, 0), (0, 0)]


def brute_counts(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {i for places in windows.values() if len(places) > 1 for k in places for i in range(k, k + 8)}
    own = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(covered)


def test_base_statistics_against_counting(documents, odd_rows):
    rng = random.Random(4)
    made = [(100 + k, " ".join(rng.choice(["a", "b", "c|", "#d", "e\n", "é", "\x0bf"]) for _ in range(rng.randint(0, 90)))) for k in range(60)]
    rows = odd_rows + made
    found = quality.base_statistics(documents(rows)).collect()
    key = lambda d, c: (d if d is not None else -1, *c)
    assert sorted(key(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in found) == sorted(key(d, brute_counts(t)) for d, t, *_ in rows)


def test_outliers_go_and_clean_documents_stay(documents):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [(k, " ".join(word() for _ in range(rng.randint(25, 200))), rng.choice(["p", "q"])) for k in range(300)]
    junk = [(1000 + k, " ".join(f"{word()}###" for _ in range(80)), "p") for k in range(20)]
    short = [(2000, "too short", "p"), (2001, None, "q"), (2002, "one two three four five six seven eight nine " * 20, "p")]
    found = {r.doc_id: r for r in quality.judge(documents(clean + junk + short)).collect()}
    assert all(found[d].kept for d, *_ in clean) and not any(found[d].kept for d, *_ in junk)
    assert all(found[d].base_failed and not found[d].kept for d, *_ in short)
    again = {r.doc_id: r.distance for r in quality.judge(documents(clean + junk + short)).collect()}
    assert again == {d: r.distance for d, r in found.items()}


@pytest.mark.parametrize("percent", [30, 45])
def test_groups_with_much_junk(documents, percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [(k, " ".join(word() for _ in range(rng.randint(25, 200))), "p") for k in range(600)]
    junk = [(1000 + k, " ".join(f"{word()}{'#' * rng.randint(2, 5)}" for _ in range(rng.randint(25, 200))), "p") for k in range(600 * percent // (100 - percent))]
    found = {r.doc_id: r.kept for r in quality.judge(documents(clean + junk)).collect()}
    assert all(found[d] for d, *_ in clean) and not any(found[d] for d, *_ in junk)


def test_small_groups_and_no_rows_are_judged(documents):
    text = " ".join(f"w{k}" for k in range(40))
    assert [r.kept for r in quality.judge(documents([(1, text, "only"), (2, text, None)])).collect()] == [True, True]
    assert quality.judge(documents([(1, text)]).where("false")).count() == 0


def test_machine_learns_a_pair_that_single_terms_do_not_tell():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.array([10 * a + 1, 20 * b + 2, *rng.integers(100, 160, 4)], dtype=np.int32)))
        labels.append(float(a and b))
    labels = np.array(labels)
    machine = toxicity.fit(rows[:3000], labels[:3000])
    scores = machine.score(np.concatenate(rows[3000:]), np.array([len(r) for r in rows[3000:]]))
    assert ((scores >= 0.5) == (labels[3000:] == 1)).mean() > 0.97


def test_machine_keeps_a_term_that_matters_only_with_another():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(6000):
        insult, group = bool(rng.random() < 0.5), bool(rng.random() < 0.3)
        rows.append(np.unique(np.array([3] * insult + [9] * group + list(rng.integers(100, 400, 8)), dtype=np.int32)))
        # the group's name alone is as common in toxic as in other texts
        labels.append(float(rng.random() < (0.95 if group else 0.05) if insult else rng.random() < (0.02 if group else 0.92)))
    labels = np.array(labels)
    seen = toxicity.telling(rows[:5000], labels[:5000], 1 << toxicity.BITS)
    assert seen[3] and seen[9] and seen[100:400].mean() < 0.1
    machine = toxicity.fit(rows[:5000], labels[:5000])
    scores = machine.score(np.concatenate(rows[5000:]), np.array([len(r) for r in rows[5000:]]))
    both = np.array([3 in r and 9 in r for r in rows[5000:]])
    only = np.array([3 in r and 9 not in r for r in rows[5000:]])
    assert (scores[both] >= 0.5).mean() > 0.95 and (scores[only] >= 0.5).mean() < 0.05


def test_repeated_and_missing_ids_of_labelled_rows(spark, documents):
    rows = [(k, f"{'vile rotten' if k % 2 else 'calm kind'} words {k}") for k in range(60)] * 20 + [(None, "vile rotten words")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1)], "doc_id long, label int")
    docs = documents(rows)
    scored = toxicity.score(docs, toxicity.train(docs, labels, most=60)).withColumn("held_out", toxicity.held_out()).collect()
    assert len(scored) == len(rows) and all(r.held_out is not None for r in scored)
    assert all((r.score >= 0.5) == (r.doc_id is None or r.doc_id % 2 == 1) for r in scored)
    none = toxicity.train(docs, labels.where("false"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, none).collect())


def test_toxic_documents_of_held_out_rows(spark, documents):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, marks = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        text = [word() for _ in range(rng.randint(5, 80))] + ([rng.choice(["vilest", "rotten", "wretch"]) for _ in range(2)] if toxic else [])
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        marks.append((k, int(toxic)))
    labels = spark.createDataFrame(marks + [(3, None)], "doc_id long, label int")
    docs = documents([*rows, (5000, None), (5001, ""), (None, "calm words")])
    machine = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, machine).withColumn("held_out", toxicity.held_out()).collect()
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == 1503
    told = {r.doc_id: r.score for r in scored if r.held_out and (r.doc_id or 0) < 1500 and r.doc_id is not None}
    truth = dict(marks)
    assert sum((s >= 0.5) == (truth[d] == 1) for d, s in told.items()) / len(told) > 0.97
    assert toxicity.score(docs.where("false"), machine).count() == 0


def test_a_machine_without_rows_calls_nothing_toxic():
    assert toxicity.fit([], np.zeros(0)).score(np.zeros(0, dtype=int), np.array([0]))[0] < 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="ad-free"><header><h2>Site</h2></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-banner">We use cookies</div><div id="main-7" class="post-12 content"><h1>Title &amp; more</h1><p>First
 <b>bold</b>&nbsp;text<p>Second<br>line <a href="x>y">link</a> ends here.<div class="AdBox">buy</div><ul><li>one<li>two</ul><form><input value=x>send</form><script>var a="</p>";</script></div>
<aside>Side</aside><section class="comments"><p>Reader says a lot of things that are not the article at all</p></section><footer>&copy; x</footer></body></html>"""


def test_article_without_its_surroundings(spark):
    rows = [(1, "http://h.example.com/1", PAGE), (2, None, None), (3, "https://h.example.com/", ""), (4, "x", "<p>just &lt;text&gt;"), (5, "http://h.example.com/2", "<nav>only a menu</nav>")]
    found = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit(1))).collect()}
    assert found[1].text == "Title & more\nFirst bold text\nSecond line link ends here.\none\ntwo"
    assert [found[k].text for k in (2, 3, 4, 5)] == ["", "", "just <text>", ""]
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_hosts_agree_on_a_path(spark):
    body = lambda a, b: f'<body><div class="left"><p>{a}</p></div><div class="story"><p>{b}</p></div></body>'
    rows = [(k, f"http://v.example.com/{k}", body("short", "the story " * 30)) for k in range(9)] + [(9, "http://v.example.com/9", body("a long teaser " * 30, "brief news"))]
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "brief news"


def test_teaser_articles_stay_out_where_the_host_has_a_path(spark):
    teasers = "".join(f'<article class="card"><p>Teaser {k}</p></article>' for k in range(3))
    body = lambda text: f'<body><article class="story"><p>{text}</p></article><div class="more">{teasers}</div></body>'
    rows = [(k, f"http://v.example.com/{k}", body(f"story {k} " * 30)) for k in range(5)] + [(5, "http://v.example.com/5", f"<body>{teasers}</body>")]
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == (f"story {k} " * 30).strip() for k in range(5))
    assert found[5] == "Teaser 0\nTeaser 1\nTeaser 2"
    sections = "<article>Intro<section><p>One</section><section><p>Two</section></article><article>Teaser</article>"
    assert pages.extract(sections, "/article/section") == "Intro\nOne\nTwo"


def test_no_pages(spark):
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_and_unclosed_markup():
    assert pages.extract("<article>" + "<div>" * 5000 + "deep" + "</b>" * 10, None) == "deep"
    assert pages.extract("<article><p>a < b and c > d<!-- <p>no --><p>x", None) == "a < b and c > d\nx"


@pytest.mark.parametrize("page", ["<a b " * 200_000, '<a href="' * 100_000, "<a href='\"" * 100_000, "<div>" * 100_000 + "x", "<b>" * 50_000 + "<hr>" * 50_000, "<div><b>" * 30_000 + "</i>" * 30_000, "<" * 500_000])
def test_broken_and_deep_pages_cost_their_length(page):
    import time

    began = time.perf_counter()
    pages.extract(page, None)
    assert pages.scored(page[:1000]) is not None and time.perf_counter() - began < 20


def test_ends_of_tags_are_those_of_a_plain_scan():
    import random

    def plain(page, start):
        quote = ""
        for k in range(start, len(page)):
            if quote:
                quote = "" if page[k] == quote else quote
            elif page[k] == ">":
                return k
            elif page[k] in "\"'":
                quote = page[k]
        return -1

    chance = random.Random(2)
    for _ in range(300):
        page = "".join(chance.choice("ab >\"'") for _ in range(chance.randrange(40)))
        ends = pages.Ends(page)
        assert [ends.of(k) for k in range(len(page))] == [plain(page, k) for k in range(len(page))]


def test_words_in_names_alone_remove_no_text():
    page = '<article><p>Intro.</p><div class="share-price-table"><p>Price</p></div><h2 class="tags-title">Tags</h2><div class="cookie-bar">C</div><div id="siteFooter">F</div><p>End.</p></article>'
    assert pages.extract(page, None) == "Intro.\nPrice\nTags\nEnd."
    assert pages.extract('<div class="story-menu-review">text</div>', None) == "text"


def test_headings_and_parts_beside_the_winning_path_are_kept():
    page = '<body><div class="nav-bar">N</div><div class="wrap"><h1>Headline</h1><div class="story">Body one.</div><div class="story-more">Body two.</div></div><div class="footer">F</div></body>'
    assert pages.extract(page, "/body/div.wrap/div.story") == "Headline\nBody one.\nBody two."
    assert pages.extract(page.replace("h1", "h4"), "/body/div.wrap/div.story") == "Body one."
