from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import boilerplate, pages

ARTICLE = "The council approved the new line on Tuesday after a debate of three hours in the town hall.\nEngineers said that the work would take two years and that nobody would lose supply meanwhile.\n"
MASK = pages.masker("www.town-news.example")


def bits_of(title, content):
    rows = pa.RecordBatch.from_arrays([pa.array([x]) for x in ("crawl_results", 1, "www.town-news.example", 1, title, content)], names=list("abcdef"))
    out = next(pages._parse(None)([rows])).to_pylist()[0]
    return title, out["bits"], out["w"], out["words"]


@pytest.mark.parametrize(
    "title,content,want",
    [
        ("{{page.title}}", ARTICLE * 3, "placeholder"), ("Good", ARTICLE * 3 + "Dear __FIRST_NAME__, hello.", "placeholder"), ("Untitled document", ARTICLE * 3, "title"), ("Good", ARTICLE * 3 + "This video player requires JavaScript.", None),
        ("Access denied: residents and the road", ARTICLE * 3, None), ("Good", "<html><script>var a = {page: \"${v}\"};</script>\n<p>" + ARTICLE * 3 + "</p>", None), ("Good", "", None), (None, "", None), ("Good", "He wrote “sic” [sic] twice. " + ARTICLE * 3, None),
        ("Good", "<p>Dear <b>{{ name }}</b></p>", "placeholder"),
    ],
)
def test_reason(title, content, want):
    assert pages.reason(*bits_of(title, content), {}) == want


def corpus():
    """Articles of random words, and messages that recur on pages without an article, in no known language."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abdegiklmnoprstuv") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    said = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    rows = []
    for i in range(90):
        host = f"http://h{i % 6}.example"
        frame = ["Dum | Ko | Ra | Fi", "{}", "Fenu palo mira dosu kela."]
        if i % 3:
            text = "\n".join(said(14) for _ in range(5))
        else:
            text = rng.choice(["Zuxq wolf yacht jinx for quay 404.", "Yacht wolf jinx; zuxq the quay.", "Quay zuxq, wolf jinx yacht {} and fjord.".format(rng.randint(1, 99))])
        if i == 31:
            text += "\nZuxq wolf yacht jinx for quay 404."  # a mention beside an article
        rows.append((i, f"{host}/{i}", f"{said(2)} {i}", "\n".join(frame).format(text)))
    return rows


def test_evidence_is_learned_from_recurrence(spark):
    df = spark.createDataFrame(corpus(), "crawl_id long, url string, title string, content string").selectExpr("*", "url as final_url")
    got = {r["crawl_id"]: r["reason"] for r in pages.residue_pages(df).collect()}
    assert got == {i: "evidence" for i in range(0, 90, 3)}


def test_long_lists_of_hosts_give_the_same(spark, tmp_path):
    df = spark.createDataFrame(corpus(), "crawl_id long, url string, title string, content string").selectExpr("*", "url as final_url")
    rows = pages.parsed(pages.page_rows(df, "crawl_results", "crawl_id"), str(tmp_path))
    _, hosts = pages.recurrent_lines(rows, str(tmp_path))
    both = [{(r["id"], tuple(sorted(r["recurrent"] or ()))) for r in pages.with_recurrent(rows, hosts, most).collect()} for most in (pages.BROADCAST_BYTES, 0)]
    assert both[0] == both[1] and len(both[0]) == 90 and any(r for _, r in both[0])


def test_fit_follows_labels_and_else_the_prior():
    names = list(boilerplate.MARKS)
    assert list(boilerplate.fit(np.zeros(0, np.int64), np.zeros(0))[:-1]) == list(boilerplate.MARKS.values())
    bits = np.array([boilerplate.BIT["sentence"], boilerplate.BIT["menu"], boilerplate.BIT["copyright"]] * 200, np.int64)
    w = boilerplate.fit(bits, (bits != boilerplate.BIT["menu"]).astype(float))
    assert w[names.index("copyright")] + w[-1] > 0 > w[names.index("menu")] + w[-1] and w[names.index("title")] == 6


def test_min_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.choice([-3, -1, -0.4, 0.3, 0.9, 2.5]) * rng.random() for _ in range(n)]
        edges = [(i, i + 1, rng.random()) for i in range(n - 1)] + [(i, i + 2, rng.random() / 2) for i in range(n - 2)]
        cost = lambda lab: sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, lab)) + sum(w for a, b, w in edges if lab[a] != lab[b])
        best = min(cost(lab) for lab in itertools.product([False, True], repeat=n))
        assert abs(cost(boilerplate.min_cut(scores, edges)) - best) < 1e-9


def test_article_lines(spark):
    page = "Town News\nHome | News | Contact | About us\nNew line approved\nBy A. Writer | 3 May 2024\n" + ARTICLE + "Related stories\nOld bridge closed for repairs after the flood of last week.\n© 2026 Town News. All rights reserved."
    marked = "<html><body>\n<nav>Home | News</nav>\n<h1>New line approved</h1>\n\n<p>" + ARTICLE.strip().replace("\n", "</p>\n<p>") + "</p>\n<footer>Contact us at the town hall, first floor, any day of the week.</footer>\n</body></html>"
    crawls = spark.createDataFrame([(1, "http://town-news.example/1", "text/html", "New line approved", page), (2, "http://town-news.example/2", "text/html; charset=utf-8", "x", marked), (3, "http://town-news.example/3", "text/plain", "x", page), (4, None, "text/html", "Untitled", page), (5, "u", "text/html", None, None), (None, "u", "text/html", "t", page)], "crawl_id long, url string, content_type string, title string, content string").selectExpr("*", "url as final_url", "'clash' as line_no")
    evidence = crawls.selectExpr("crawl_id as evidence_id", "url", "final_url", "content_type", "title", "content")
    got: dict = {}
    for r in boilerplate.article_lines(crawls, evidence).collect():
        got.setdefault((r[0], r[1]), set()).add(r[2])
    assert got[("crawl_results", 1)] == {3, 5, 6} and got[("crawl_results", 2)] == {3, 5, 6} and ("crawl_results", 4) not in got and ("evidence", 4) in got and ("crawl_results", 3) not in got
    assert boilerplate.article_lines(crawls.where("false"), evidence.where("false")).count() == 0


def test_recurrent_lines_count_pages_once(spark, tmp_path):
    rows = [(i, f"http://h.example/{i % 10}?utm_source=x{i}", f"Line {i % 10} of its own kind, long enough to count as a sentence here.\nPrivacy policy") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, url string, content string").selectExpr("*", "url as final_url", "'' as title")
    everywhere, hosts = pages.recurrent_lines(pages.parsed(pages.page_rows(df, "crawl_results", "id"), str(tmp_path)), str(tmp_path))
    assert everywhere == {pages.key(MASK("Privacy policy"))} and [r["k"] for r in hosts.collect()] == [pages.key(MASK("Privacy policy"))]


def test_residue_pages(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "Untitled", ARTICLE * 2), (1, "http://a.example/", "Untitled", ARTICLE * 2), (2, None, None, None), (3, "x", "ok", ARTICLE * 4), (None, "x", "{{a.b}}", "x")], "crawl_id long, url string, title string, content string").selectExpr("*", "url as final_url", "1 as host", "2 as page")
    assert [tuple(r) for r in pages.residue_pages(df).collect()] == [(1, "title")]
    assert pages.residue_pages(df.where("false")).count() == 0
