"""Blocks, wrappers and the main text."""

import html
import json
import random
import re

import pytest

from clientele.llm.catalog import runs
from clientele.llm.markup import blocks
from clientele.llm.wrappers import align, article_path, constants, expression, extract, infer, main_text, wrapper_of

HEAD = "<!doctype html><html><head><title>T</title><style>p{}</style><script>var x='<p>no</p>';</script></head><body>"


def text_of(page):
    found = list(blocks(page))
    return main_text(found, article_path(wrapper_of(found)))


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"),
    (HEAD + "<nav>menu</nav><article><h1>One</h1><p>Two <b>bold</b>\n three&nbsp;&lt;4<br>five</article><footer>f", "One\n\nTwo bold three <4 five"),
    (HEAD + "<div class='ad banner'>buy<p>now</div><main><p>Text<aside>side</aside> more</p><form>x</form></main>", "Text\n\nmore"),
    (HEAD + "<article><p>Body</p><section id=comments><p>I disagree</p></section></article>", "Body"),
    (HEAD + "<article><p>Body</p></article><article class='comment'><p>Me too</p></article>", "Body"),
    (HEAD + "<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><!-- gone --></article>", "one\n\ntwo\n\na\n\nb"),
    (HEAD + "<div class='has-sidebar'><article><p>kept</p></article></div>", "kept"),
    (HEAD + "<article><p>a <a href='x>y'>link</a> z</p></i></span><p>2 < 3</p>", "a link z\n\n2 < 3"),
    (HEAD + "<div role=alert>We use cookies</div><div id=content><p>Long enough text of the page.</p></div>", "Long enough text of the page."),
    ("<article>" + "<p>x</p>" * 3000 + "</article>", "\n\n".join(["x"] * 3000)),
    ("<article><script>if (a < b) { '</p>' }</script>real</article>", "real"),
    ("<article><p class=\"unclosed>broken</p><p>next</p></article>", "broken\n\nnext"),
    (HEAD + "<div class='layout sidebar-right'><article><p>kept</p></article></div>", "kept"),
    (HEAD + "<div class='post comments-open'><main><p>kept</p></main></div>", "kept"),
    (HEAD + "<div id='menu-page'><article><p>kept</p></article></div>", "kept"),
    (HEAD + "<form action=/><div>top</div><main><p>The text of the page.</p></main></form>", "The text of the page."),
    (HEAD + "<div class=sidebar><article>teaser</article></div><main><p>The text of the page.</p></main>", "The text of the page."),
    (HEAD + "<article><p>Body</p><section class='related-work'><h2>Related work</h2><p>" + "prose " * 30 + "</p></section></article>",
     "Body\n\nRelated work\n\n" + ("prose " * 30).strip()),
    (HEAD + "<article><p>Body of it</p><div class='related-posts'><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div></article>", "Body of it"),
    (HEAD + "<article><p>Body of it</p><div class='comments'><article class='comment'><p>" + "loud " * 90 + "</p></article></div></article>", "Body of it"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("<div>" * 200 + "<h1>a</h1><p>b<p>c" + "</div>" * 200, "a\n\nb\n\nc"),
])
def test_main_text(page, want):
    assert text_of(page) == want


def host_pages(n, article=True, seed=0):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(k))
    pages, texts = [], []
    for i in range(n):
        body = [say(30) for _ in range(rng.randint(2, 6))]
        box = ("<article>", "</article>") if article else ("<div id='c'><div class='story'>", "</div></div>")
        middle = "".join(f"<p>{html.escape(b)}</p>" for b in body)
        extra = "<blockquote>" + say(9) + "</blockquote>" if i % 3 == 0 else ""
        quote = [re.sub("<.*?>", "", extra)] if extra else []
        pages.append(f"{HEAD}<div>Site name</div><ul class='menu'><li>a<li>b</ul>{box[0]}{middle}{extra}{box[1]}<div>Legal text of the site</div>")
        texts.append("\n\n".join(body + quote))
    return pages, texts


@pytest.mark.parametrize("article", [True, False])
def test_wrappers_find_the_article(spark, article):
    pages, texts = host_pages(12, article)
    rows = [(i, f"http://h{i % 2}.org/{i}", p, "x") for i, p in enumerate(pages)] + [(99, None, None, "x"), (98, "http://h0.org/", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string").repartition(5)
    out, name = extract(df)
    assert out.columns == ["page_id", "url", "main_text", name]
    got = {r["page_id"]: r[name] for r in out.collect()}
    assert got == dict(enumerate(texts)) | {99: "", 98: ""}


def test_a_box_that_every_article_repeats_is_left_out(spark):
    pages = [f"{HEAD}<article><h2>Summary</h2><p>{f'alpha{i} beta ' * 20}</p><div><p>Buy now</p><p>Cheap</p></div></article>" for i in range(6)]
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)]
    out, name = extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r[name] for r in out.collect()} == {
        i: "Summary\n\n" + (f"alpha{i} beta " * 20).strip() for i in range(6)}


def test_a_wrapper_is_bounded_by_the_template():
    page = lambda i: (f"<div id=post-x{'abcdefgh'[i % 8] * (i + 1)} class='post tag{chr(97 + i % 26) * (i // 26 + 1)}'>"  # noqa: E731
                      f"<h2 class='t{chr(97 + i % 26) * 2}{chr(97 + i // 26)}'>Head</h2><p>{f'word{i} ' * 30}</p></div>")
    one = wrapper_of(blocks(page(0)))
    for i in range(1, 200):
        one = align(one, wrapper_of(blocks(page(i))))
    assert len(json.dumps(one)) < 8000 and one["n"] == 200
    for i in range(200):
        assert main_text(blocks(page(i)), article_path(one), constants(one, article_path(one))).endswith(f"word{i}")


def test_hosts_merge_in_rounds(spark):
    pages, texts = host_pages(150, False)
    rows = [(i, "http://h.org/x", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(140)
    found = infer(df).collect()
    assert len(found) == 1 and found[0]["n_pages"] == 150
    out, name = extract(df)
    assert {r["page_id"]: r[name] for r in out.collect()} == dict(enumerate(texts))


def test_alignment_gives_optional_repeated_and_slots():
    a = "<div><h1>A</h1><p>x</p></div>"
    b = "<div><h1>B</h1><p>y</p><p>z</p><ul><li>1<li>2</ul></div>"
    one = align(wrapper_of(list(blocks(a))), wrapper_of(list(blocks(b))))
    assert expression(one) == "<div> <h1> #text </h1> (<p> #text </p>)+ (<ul> (<li> #text </li>)+ </ul>)? </div>"


def test_merging_in_another_order_gives_the_same_facts():
    pages, _ = host_pages(9, False)
    made = lambda order: [wrapper_of(list(blocks(pages[i]))) for i in order]

    def fold(ws):
        out = ws[0]
        for w in ws[1:]:
            out = align(out, w)
        return out

    one, two = fold(made(range(9))), fold(made(reversed(range(9))))
    parts = align(fold(made([3, 1, 2])), fold(made([8, 0, 4, 5, 6, 7])))
    for other in (two, parts):
        assert article_path(one) == article_path(other)
        assert sorted(constants(one, ("html", "body"))) == sorted(constants(other, ("html", "body")))
    assert article_path(one)[-1].startswith("div.")


def test_query_gives_the_articles_of_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search("(?s)<article>(.*)</article>", r["html"])[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", s)).split()) for s in re.split("</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n\n".join(p for p in parts if p)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in runs()["op3_html_extraction"](spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_empty_table(spark):
    out, _ = extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.count() == 0
