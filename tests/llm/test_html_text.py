import random
import re
import time

import pytest

from tagloom.llm import html_text, queries
from tagloom.llm.html_text import main_text


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("no markup at all, just words.", "no markup at all, just words."),
        ("<article></article><p>Not the article, but long enough to look like it.</p>", ""),
        ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four<p>five</article>", "A & B\none two three four\nfive"),
        ("<article><p>a<b>b</b> <i>c</i></p><script>x<p>y</script><style>p{}</style>d</article>", "ab c\nd"),
        ("<article><!-- <p>no</p> --><p>yes</p><!-- unclosed <p>no</p></article>", "yes"),
        ("<nav>menu</nav><header>top</header><main><p>main</p></main><footer>end</footer>", "main"),
        ("<article><p>text</p><section class='comments'><article><p>I disagree.</p></article></section></article>", "text"),
        ("<article><p>text</p><div id=\"reader-comments\"><p>First!</p></div><p>more</p></article>", "text\nmore"),
        ("<article><p>text</p><aside>side</aside><form>a<input>b</form><div class=ad>buy</div></article>", "text"),
        ("<div class='has-sidebar'><article><h1 class='page-header'>T</h1><p>x</p></article></div>", "T\nx"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo\na\nb\nc"),
        ("<article><p>a &lt;b&gt; &#233;&#x41; &unknown; &am</p></article>", "a <b> éA &unknown; &am"),
        ("<article><p title='a>b'>c</p><p>1 < 2</p></article>", "c\n1 < 2"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>one</p><p title='the hidden truth'>two</p></article>", "one\ntwo"),
        ("<article data-title='A hidden gem' alt=\"display:none id='ad'\"><p>kept</p></article>", "kept"),
        ("<article><p>a</p><p hidden>b</p><p aria-hidden=true>c</p><p style='color:red; display : none'>d</p></article>", "a"),
        ("<article><p>a</p><p aria-hidden='false'>b</p><p data-hidden=1>c</p></article>", "a\nb\nc"),
        ("<article><p>a</p><section class='discussion'><p>Own words.</p></section></article>", "a\nOwn words."),
        ("<article><b>a<p>b</b>c</p>d</article>", "a\nbc\nd"),
        ("<article><p>a<i>b</p></i>c<li>d<li>e</article>f", "ab\nc\nd\ne"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_page_without_article():
    long = "This sentence has words, and marks. " * 8
    page = (
        "<div><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Contact</a></ul></div>"
        f"<div class=story><h2>Title of it</h2><p>{long}</p><p>{long}</p></div><div><span>Copyright</span></div>"
    )
    assert main_text(page) == "\n".join(["Title of it", long.strip(), long.strip()])


STORY = "This sentence has words, and marks. " * 8


@pytest.mark.parametrize("around", ["<main>{}</main>", "<div class=story>{}</div>"])
def test_story_outside_of_a_small_article(around):
    story = around.format(f"<h2>Title of it</h2><p>{STORY}</p><p>{STORY}</p>")
    lines = main_text(f"{story}<div class=more><article><a href=1>Another story</a></article></div>").split("\n")
    assert lines[:3] == ["Title of it", STORY.strip(), STORY.strip()]
    assert main_text(f"<article><h1>T</h1><p>{STORY}</p><ul><li>a</ul></article><div><p>Short, not it.</p></div>") == f"T\n{STORY.strip()}\na"


@pytest.mark.parametrize(
    "attributes",
    ["id='discussion'", "id='related-work'", "class='social-policy'", "id='search-methods'", "aria-label='Discussion of results'"],
)
def test_named_sections_of_the_content_stay(attributes):
    assert main_text(f"<article><p>{STORY}</p><section {attributes}><p>A part.</p></section></article>") == f"{STORY.strip()}\nA part."
    assert main_text(f"<article><p>a</p><div {attributes}><p>{STORY}</p></div></article>") == f"a\n{STORY.strip()}"


def test_names_are_overruled_by_long_texts_only():
    assert main_text(f"<article><div class='entry-header'><h1>T</h1></div><p>{STORY}</p></article>") == f"T\n{STORY.strip()}"
    assert main_text(f"<article><p>{STORY}</p><div class='related'><p>{STORY}</p></div></article>") == f"{STORY.strip()}\n{STORY.strip()}"
    links = "<li><a href=1>This sentence has words, and marks.</a>" * 9
    for other in (f"<div class='related'>{links}</div>", "<div class='share-buttons'>Share it</div>", f"<div class='comments'><p>{STORY}</p></div>"):
        assert main_text(f"<article><p>{STORY}</p>{other}</article>") == STORY.strip()


def test_a_reply_by_the_author_stays():
    assert main_text(f"<article><p>{STORY}</p><div class='reply'><p>{STORY}</p></div></article>") == f"{STORY.strip()}\n{STORY.strip()}"
    assert main_text(f"<article><p>{STORY}</p><div class='reply'>I agree</div></article>") == STORY.strip()


@pytest.mark.parametrize("opened", ["<div>", "<p><table><td>", "<ul><li>", "<b><p>", "<article><section class=x>"])
def test_deep_nesting_takes_linear_time(opened):
    start = time.process_time()
    page = opened * (100_000 // opened.count("<")) + "text" + "</div>" * 50_000
    assert html_text.blocks(page)[0][-1].text == "text"
    assert time.process_time() - start < 3


def ratio_blocks(page):
    """What path ratios alone keep of a page of plain blocks, computed from their definition."""
    lines = [(m[1], m[2]) for m in re.finditer(r"<(\w+)>([^<]*)</\1>", page)]
    paths = sorted({tag for tag, _ in lines})
    scores = dict.fromkeys(paths, 1.0)
    for measure in (len, lambda x: len(re.findall("[.,;:!?]", x))):
        ratio = {p: sum(measure(x) for t, x in lines if t == p) / sum(t == p for t, _ in lines) for p in paths}
        row = [ratio[t] for t, _ in lines]
        row = [row[0], *row, row[-1]]
        smooth = [row[n] / 4 + row[n + 1] / 2 + row[n + 2] / 4 for n in range(len(lines))]
        for p in paths:
            own = [x for x, (t, _) in zip(smooth, lines) if t == p]
            scores[p] *= 1 + sum(own) / len(own)
    mean = sum((scores[t] - 1) * len(x) for t, x in lines) / sum(len(x) for _, x in lines)
    return [x for t, x in lines if scores[t] - 1 >= html_text.THRESHOLD * mean]


def test_ratios_decide_on_pages_without_marks():
    rng = random.Random(6)
    differ = 0
    for _ in range(200):
        tags = rng.sample(["p", "div", "li", "td", "pre"], 3)
        rows = [(rng.choice(tags), " ".join(["word,"] * rng.choice([1, 1, 2, 40]))) for _ in range(rng.randint(1, 9))]
        page = "".join(f"<{t}>{x}</{t}>" for t, x in rows)
        kept = ratio_blocks(page)
        assert main_text(page).split("\n") == kept
        differ += len(kept) < len(rows)
    assert differ > 20


def test_very_long_page():
    words = "word, " * 300_000
    assert main_text(f"<article><p>{words}</p></article>") == words.strip()


def test_rows(spark):
    rows = [(1, "u", "<article>a</article>", 1), (1, "u", "<article>a</article>", 2), (None, None, None, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert found == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_query(spark, sf_dir, duck):
    from check_queries import compare

    assert compare(queries.op10_main_text(spark, sf_dir), duck, queries.ORACLE_SQL["op10_main_text"]) == ""
