"""Wrappers decide the main text: hosts without article elements, furniture without class words, deep and wide pages."""

import time

import numpy as np
import pytest

from gaplens.llm import html_wrappers as hw
from gaplens.llm.common import documents

RNG = np.random.default_rng(7)


def words(n):
    return " ".join("".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(n))


def extracted(spark, rows):
    return {r.page_id: r.text for r in hw.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_hosts_without_articles(spark):
    rows, want = [], {}
    for k in range(12):
        paras = [words(40) for _ in range(2 + k % 3)]
        links = "".join(f"<li><a href=/{j}>{words(2)}</a></li>" for j in range(5))
        body = f"<div class=top><ul class=places>{links}</ul></div><div class=hint>{words(6)}</div><div class=text><h2>Title {k}</h2>" + "".join(f"<p>{p}</p>" for p in paras)
        body += f"<p>Sign up for our weekly letter.</p></div><div class=low><p>Example Press {words(3)}</p></div>"
        rows.append((k, f"https://press.example/{k}", f"<html><head><title>x</title></head><body>{body}</body></html>"))
        want[k] = "\n".join([f"Title {k}", *paras])
    assert extracted(spark, rows) == want


def test_constant_lines_inside_articles_stay(spark):
    """An article's line is its own even if all pages of the host have it; until round 2 such lines were cut."""
    rows, want = [], {}
    for k in range(9):
        p = words(60)
        rows.append((k, "http://a.example/", f"<body><article><h1>H {k}</h1><p>{p}</p><h2>Conclusion</h2><blockquote>Shared words.</blockquote></article></body>"))
        want[k] = f"H {k}\n{p}\nConclusion\nShared words."
    same = words(80)
    for k in range(20, 26):  # near copies of one article are no template
        rows.append((k, "http://b.example/", f"<body><article><p>{same}</p><p>Edition {k}</p></article></body>"))
        want[k] = f"{same}\nEdition {k}"
    assert extracted(spark, rows) == want


def test_words_in_articles_that_only_look_like_furniture():
    page = '<article><div class="article-header"><h1>Title</h1></div><p class="social">One.</p><section id="related-work">Two.</section><p class="search-result">Three.</p><div class="comments"><p>me too</p></div></article>'
    assert hw.main_text(page) == "Title\nOne.\nTwo.\nThree."


def test_deep_and_wide_pages(spark):
    rows = [(k, "http://deep.example/", "<div>" * 3000 + f"deep {k}" + "</div>" * 3000) for k in range(6)]
    rows += [(10 + k, "http://wide.example/", "<body>" + "".join(f"<p class=c{j}x>w {k} {j}</p><h2 class=q{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}>h {j}</h2>" for j in range(4000)) + "</body>") for k in range(5)]
    got = extracted(spark, rows)
    assert all(got[k] == f"deep {k}" for k in range(6))
    for k in range(5):
        assert [x for x in got[10 + k].split("\n") if x.startswith("w")] == [f"w {k} {j}" for j in range(4000)]


def test_wrapper_does_not_depend_on_order_or_copies(spark):
    rows = [(k, "http://o.example/", f"<body><div class=x><p>{words(30)}</p>" + ("<blockquote>q</blockquote><p>more</p>" if k % 3 else "") + "</div></body>") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = hw.wrappers(df).collect()
    assert one == hw.wrappers(df.union(df).repartition(5)).collect()


def test_lists_never_hold_a_key_twice():
    for _ in range(50):
        pages = ["".join(f"<{t}>{words(1)}</{t}>" for t in RNG.choice(["p", "h2", "blockquote", "pre"], 6)) for _ in range(5)]
        made = hw.skeleton(hw.parse(pages[0]))
        for page in pages[1:]:
            made = hw.aligned(made, hw.skeleton(hw.parse(page)))
        work = [made]
        while work:
            node = work.pop()
            keys = [x["k"] for x in node["c"]]
            assert len(keys) == len(set(keys))
            work += node["c"]
        assert made["n"] == 5 and made["m"] == 5 * 6 * 5


def test_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "kept", "old", 3)], "page_id long, url string, html string, plan string, text string, host int")
    out = hw.extract_main(df).collect()[0]
    assert out.asDict() == {"page_id": 1, "url": "u", "plan": "kept", "text": "a", "host": 3}


def test_share_of_pages_the_wrapper_changes(spark):
    """Against the plainest reading (text of article elements): none of the pages of this table, which all have one, are read otherwise."""
    pages = documents(spark, "/root/testdata/sf0.01", "pages")
    by_host = {r.page_id: r.text for r in hw.extract_main(pages).collect()}
    alone = {r.page_id: hw.main_text(r.html) for r in pages.collect()}
    assert sum(by_host[i] != alone[i] for i in alone) == 0


def test_lists_of_many_keys_keep_their_text(spark):
    rows, want = [], {}
    for k in range(6):
        lines = [words(14) for _ in range(60)]
        rows.append((k, "http://k.example/", "<body><div class=text>" + "".join(f"<p class=c{chr(97 + j // 26)}{chr(97 + j % 26)}>{x}</p>" for j, x in enumerate(lines)) + "<div class=box><a href=1>One link</a> <a href=2>Two links</a></div></div></body>"))
        want[k] = lines
    got = extracted(spark, rows)
    assert all(got[k].split("\n")[:60] == want[k] for k in want)


def test_joined_class_words_and_headers_of_articles():
    page = (
        '<article><div class="header"><h1>Title</h1></div><p>a</p><section class="side effects"><p>fx</p></section><div class="comment-list"><p>c</p></div>'
        '<div class="social-share">s</div><div class="cookie-banner">k</div><p class="ad">ad</p></article>'
    )
    assert hw.main_text(page) == "Title\na\nfx"


@pytest.mark.parametrize("piece", ['<a "', "<b ", "<a '\"", "<p x='", "<!-", "</a ", '<a b="c>'])
@pytest.mark.parametrize("tail", ["", ">", '">'])
def test_hostile_pages_take_linear_time(piece, tail):
    start = time.process_time()
    hw.main_text(piece * (1_000_000 // len(piece)) + tail)
    assert time.process_time() - start < 5


def test_open_scripts_and_comments_hide_the_rest():
    assert hw.main_text("<article><p>x</p></article><script>var a=1;") == "x"
    assert hw.main_text("<p>x</p> tail <!-- c") == "x\ntail"
    assert hw.main_text("<p>x</p> tail < 3") == "x\ntail < 3"
