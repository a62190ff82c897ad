import random
import html
import re

from snaplake.llm import wrappers as w

from .conftest import SF

LAYOUT = (
    '<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><div id="cookie-notice">We bake</div>'
    "<header><h1>Site</h1></header><ul class=top><li><a href=/>Home</a><li><a href=/x>X</a></ul>"
    '<div class="content"><h2>T%d &amp; more</h2>%s<div class="comments"><p>first!</p></div><form><p>mail</p></form></div>'
    "<div class=sidebar>side</div><script>var a='<p>no</p>'</script><!-- <p>no</p> --><footer>f</footer></body></html>"
)


def test_sequences_align_to_optional_and_repeated_parts():
    a = w.page_wrapper("<body><h2>A</h2><p>x</p><h2>B</h2><p>y</p><ul><li>1<li>2</ul></body>")
    b = w.page_wrapper("<body><h2>A</h2><p>x</p><hr><table><tr><td>z</table>")
    assert w.expression(a) == "(<body>((<h2>#</>)(<p>#</>)+)+(<ul>(<li>#</>)+</>)</>)".replace("(<p>#</>)+)+", "(<p>#</>))+")
    merged = w.expression(w.merge(a, b))
    assert merged == w.expression(w.merge(b, a)) or "?" in merged
    assert "(<h2>#</>)(<p>#</>)" in merged and "<ul>" in merged and "<table>" in merged and merged.count("?") == 2


def test_article_by_inference(workers):
    body = ["<p>One<br>two <i>th</i>ree" + " words" * 30, "<p>a &lt; b&nbsp;c</p><ul><li>item</ul>", "<blockquote><p>q</p></blockquote>"]
    rows = [(i, f"https://Host.example/{i}", LAYOUT % (i, "".join(body[: 1 + i % 3]).replace("item", f"item {i}"))) for i in range(9)]
    rows += [(90, None, None), (91, "https://Host.example/e", ""), (92, "no url", "plain text"), (93, "https://host.example/odd", "<article>own")]
    rows += [(94, "https://host.example/cut", rows[0][2][:-300]), rows[0]]
    pages = workers.createDataFrame([(*r, "c", "h") for r in rows], "page_id long, url string, html string, chosen string, host string")
    got = {}
    for r in w.extract(pages).collect():
        assert r.n_chars == len(r.text)
        assert got.setdefault(r.page_id, r.text) == r.text
    one, three = "One two three" + " words" * 30, "q"
    for i in range(9):
        assert got[i] == " ".join([f"T{i} & more", one, f"a < b c item {i}", three][: 2 + i % 3])
    assert got[90] == got[91] == "" and got[93] == "own" and got[94].startswith("T0 & more One")
    assert w.extract(pages.limit(0)).count() == 0


def test_text_of_every_page_is_template(workers):
    page = "<body><div id=a><p class=lead>%s</p><p>%s and some more of it</p><p class=end>Write to us at any time</p></div></body>"
    rows = [(i, "https://one.example/", page % (f"lead {i // 2}", f"text {i}")) for i in range(6)]
    rows += [(10 + i, f"https://{'few' if i < 3 else 'copies'}.example/", page % ("same", "same")) for i in range(9)]
    got = {r.page_id: r.text for r in w.extract(workers.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"lead {i // 2} text {i} and some more of it" for i in range(6)} | {
        10 + i: "same same and some more of it Write to us at any time" for i in range(9)
    }


def test_given_pages_equal_a_plain_reading(workers):
    pages = workers.read.parquet(f"{SF}/pages.parquet")

    def plain(page):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
        blocks = re.sub(r"</?b>|<[^>]*\Z", "", re.sub(r"</?(?:p|h1|br)>", "\0", inner)).split("\0")
        return " ".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))

    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in w.extract(pages).collect()} == want


def test_equal_beginnings_are_not_equal_texts(workers):
    page = "<body><div id=a><h2>Title %d</h2><p class=lead>%s and then part %d</p></div></body>"
    lead = "Series introduction. " * 12
    rows = [(i, "https://series.example/", page % (i, lead, i)) for i in range(8)]
    got = {r.page_id: r.text for r in w.extract(workers.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} {lead}and then part {i}".replace("  ", " ") for i in range(8)}


def host_text(pages):
    """The texts of pages of one host."""
    wrapper = w.page_wrapper(pages[0])
    for page in pages[1:]:
        wrapper = w.merge(wrapper, w.page_wrapper(page))
    return [w.main_text(page, w.choose(wrapper)) for page in pages]


def test_repeated_and_rare_text_is_no_template():
    items = "<body><div id=a><h2>Head %d</h2><ul>" + "<li><p>same</p><b>x</b></li>" * 5 + "</ul><p>Own text %d</p></div></body>"
    assert host_text([items % (1, 1)]) == ["Head 1 " + "same x " * 5 + "Own text 1"]
    assert host_text([items % (i, i) for i in range(7)]) == [f"Head {i} " + "same x " * 5 + f"Own text {i}" for i in range(7)]
    groups = "<body><div id=a>" + "<h3>Answer</h3><p>because %d</p>" * 5 + "</div></body>"
    assert host_text([groups % (1, 2, 3, 4, 5)]) == [" ".join(f"Answer because {k}" for k in range(1, 6))]
    rare = [f"<body><div id=a><p class=lead>Lead {i}</p>{'<blockquote>A quote</blockquote>' * (i < 6)}<div>Own {i}</div></div></body>" for i in range(40)]
    assert host_text(rare) == [f"Lead {i} {'A quote ' * (i < 6)}Own {i}" for i in range(40)]
    often = [f"<body><div id=a><p class=lead>Lead {i}</p><div>Own {i}</div>{'<p class=end>Write us</p>' * (i > 1)}</div></body>" for i in range(40)]
    assert host_text(often) == [f"Lead {i} Own {i}" for i in range(40)]


def test_an_article_is_read_whole():
    for tag in ("article", "main"):
        page = f"<body><div><a href=/>Home and other links of this site</a></div><{tag}><h2>Same</h2><p>Own %d</p><ul><li><a href=/>A source</a></ul></{tag}></body>"
        assert host_text([page % i for i in range(6)]) == [f"Same Own {i} A source" for i in range(6)]


def test_deep_pages(workers):
    """However deep a page is nested: no text is lost, and what is out by name stays out."""
    deep = "<div>" * 10000 + "down here" + "<nav><p>menu<div>more</div></p></nav>" + "and <b>more</b>" + "</div>" * 5000 + "up again" + "</div>" * 5000
    page = f"<html><body><article><h1>Title</h1>{deep}<p>end</p></article></body></html>"
    plain = f"<html><body><h1>Title</h1>{deep}</body></html>"
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/2", page.replace("end", "close")), (3, "http://c.d/1", plain), (4, "http://e.f/", "<b>" * 20000 + "x" + "<p>y" * 20000)]
    pages = workers.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in w.extract(pages).collect()}
    assert got[1] == "Title down here and more up again end" and got[2].endswith("up again close")
    assert got[3] == "down here and more up again" and got[4].startswith("x y y") and got[4].count("y") == 20000


def test_wide_pages_are_aligned_in_bounded_time():
    import time

    rnd = random.Random(9)
    wide = lambda: "<html><body>" + "".join(f'<div class="{rnd.choice("abcdefgh")}{rnd.choice("xyz")}"><p>{k}</p></div>' for k in range(20000)) + "</body></html>"
    one, two = w.page_wrapper(wide()), w.page_wrapper(wide())
    began = time.perf_counter()
    both = w.merge(one, two)
    assert time.perf_counter() - began < 20
    assert both[w.PAGES] == 2


def test_anchors_ascend_and_keep_equal_ends():
    rnd = random.Random(10)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        found = w._anchors(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        assert len(w._anchors(a, a)) == len(a)


def test_long_sequences_keep_every_part(monkeypatch):
    rnd = random.Random(11)
    made = lambda: w.page_wrapper("".join(f"<{rnd.choice(['div', 'section', 'ul', 'table'])} id=q{rnd.choice('abc')}>t" for _ in range(1)) + "".join(f"<p class={rnd.choice('abcde')}>t{k}</p>" for k in range(12)))
    pages = [made() for _ in range(6)]
    signs = lambda part: {part[w.SIGN]} | {s for p in part[w.PARTS] if isinstance(p, list) for s in signs(p)}
    monkeypatch.setattr(w, "TABLE", 0)
    for x in pages:
        for y in pages:
            merged = w.merge(x, y)
            assert {s for s in signs(x) | signs(y) if not s.startswith("(")} <= signs(merged)
