import html as entities
import random
import time

import pytest

from relengine.llm.html import article, extract, page_blocks, path_of


def text(h):
    return article(page_blocks(h), [])


def test_small_pages():
    assert text("") == "" and text("plain") == "plain" and text("<p>x") == "x"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a b c d"
    assert text("<body><p>a<b>b</b>c<br>d</p><table><tr><td>1<td>2<tr><td>3</table>") == "abc d 1 2 3"
    assert text("<article>&lt;b&gt;  a\n&#x41;&amp</article>") == "<b> a A&"
    assert text("<script>var x='</p>'") == "" and text("<a href='x>y'>z</a>") == "z"
    assert text("<div " * 3) in ("<div <div <div ", "<div <div <div", "")
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='", "<a b=\"'", '<a b=">"', "<div>", "<div class=sidebar>", "<b>", "<p><table>", "<li><b>", "</x>", "<p></b>", "<!-- ", "<a b=\"><a c='>", "<article class=menu><p>x", "<ul><li>", "&am", "<"])
def test_long_malformed_pages_take_linear_time(piece):
    for end in ("", ">"):
        page = "<body><p>start</p>" + piece * ((1 << 20) // len(piece)) + end
        began = time.process_time()
        text(page)
        assert time.process_time() - began < 8  # seconds a MB, of which the worst takes about 3


def test_references_are_decoded_within_a_text_node():
    assert text("<p>&am<b>p;</b> &lt;<i>b</i>&gt; &amp;amp; &#x41;&nbsp;b") == "&amp; <b> &amp; A b"
    assert text("<p>&am<!-- -->p; x") == "&amp; x"


def test_names_within_an_article_that_only_look_like_marks():
    body = "".join(f"<p>{'word ' * 20}{i}" for i in range(4))
    kept = "<section id=related-work><h2>Related work</h2><p>as was shown</section><div class=share-price><p>rose</div><p class=comment>He said so."
    gone = "<div class=share-buttons><p>tell it</div><div class='ad'><p>buy</div><p class=newsletter>join us<ul class=related-posts><li>teaser</ul><div class='comment-list'><p>me too</div>"
    assert text(f"<article>{body}{kept}{gone}</article>").split()[-9:] == "Related work as was shown rose He said so.".split()
    assert text(f"<body><div class=share-price><p>ticker</div><article>{body}</article>").split()[0] == "word"


def test_votes_of_a_host_change_a_text(spark):
    """Most pages hold all they say in one container; on one, an unmarked block lies outside, which its own best container would take in."""
    long = "word " * 60
    rows = [(i, f"http://h/{i}", f"<body><div class=story><h1>T{i}</h1><p>{long}{i}</div></body>") for i in range(6)]
    rows.append((7, "http://h/7", f"<body><div class=story><h1>T7</h1><p>{long}7</div><div class=box><p>Meet us at the fair</div></body>"))
    rows.append((8, "http://alone/8", rows[-1][2]))
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i} {long}{i}" for i in (*range(6), 7)} | {8: f"T7 {long}7 Meet us at the fair"}


def test_votes_without_marks(spark, monkeypatch):
    """With no names that mark anything, what most pages agree on still decides."""
    import re

    from relengine.llm import html

    for name in ("MARKS", "PARTS", "NEVER_TEXT"):
        monkeypatch.setattr(html, name, re.compile("(?!)"))
    story = "word " * 50
    rows = [(i, f"<body><div class=post><h1>T</h1><p>{story}</div><div class='sidebar'><p>{'side ' * 20}</div>") for i in range(3)]
    rows += [(10 + i, f"<body><div class=post><h1>T</h1><p>{story}</div>") for i in range(5)]
    votes = [html.best_path(page_blocks(h))[0] for _, h in rows]
    most = max(set(votes), key=votes.count)
    assert most == path_of("body>div.post")
    assert {article(page_blocks(h), [(most, True)]) for _, h in rows} == {f"T {story}".strip()}


def test_title_and_lead_outside_the_body_are_kept():
    body = "".join(f"<p>{'word ' * 40}{i}" for i in range(9))
    page = f"<body><div><a href='/'>All our news</a></div><article><h1>{{}}</h1><p>the lead</p><div class=body>{body}</div></article><div><a href='/2'>next one</a></div></body>"
    got = text(page.format("Title"))
    assert got.startswith("Title the lead word") and got.endswith("word 8")
    assert text(page.format("<a href='/1'>Title</a>")) == got
    assert text(f"<body><p>before</p><blockquote>{body}</blockquote><p>after</p></body>").split()[:: 9 * 41 + 1] == ["before", "after"]
    assert article(page_blocks(page.format("Title")), [(path_of("body>article>div.body"), True)]) == got


def test_two_templates_on_one_host(spark):
    long = "word " * 80
    rows = [(i, f"http://h/{i}", f"<body><div class=post><p>{long}{i}</p></div></body>") for i in range(9)]
    rows += [(10 + i, f"http://h/{10 + i}", f"<body><div class=post><p>teaser {i}</p></div><div class=story><p>{long}{i}</p></div></body>") for i in range(2)]
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{long}{i}" for i in range(9)} | {10 + i: f"teaser {i} {long}{i}" for i in range(2)}


def test_open_heads_and_marked_wrappers():
    for end in ("</head>", ""):
        assert text(f"<html><head><meta charset=utf-8><title>T</title><style>p{{}}</style>{end}<body><article><p>x</article>") == "x"
        assert text(f"<html><head><title>T</title>\n{end}<p>x<p>y") == "x y"
    assert text("<head><title>T</title>bare <b>text</b>") == "bare text"
    post, side = f"<h1>T</h1><p>{'word ' * 60}", "<div class=sidebar><p>about us</div><div id=comments><p>so true</div>"
    for outer in ("content has-sidebar", "no-sidebar", "layout sidebar-left", "page banner", "social-layout", "side x", "promo"):
        for inner in ("article", "main", "div"):
            got = text(f"<body><p>tagline<div class='{outer}'><{inner}>{post}</{inner}>{side}</div><footer>f</footer>")
            assert got == " ".join(["tagline T", *["word"] * 60])
    assert text(f"<body><form action=/all><div class=sidebar-x><div class='search page'>{post}</div></div>{side}</form>").startswith("T word")
    comments = "<div id=comments>" + "<article class=comment><p>I say so</article>" * 90 + "</div>"
    assert text(f"<body><div class=post>{post}</div>{comments}").split() == ["T", *["word"] * 60]
    assert text(f"<body><article>{post}</article>{comments}<div class=related><article>teaser</article></div>").split() == ["T", *["word"] * 60]
    assert text("<body><div class=cookie-consent><p>We use cookies</div>") == ""


def random_page(rng, template):
    """A well-formed page of nested containers, all of a host's by few templates, with words in blocks."""
    words = lambda n: " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(n))
    story = "".join(f"<{t}>{words(rng.randrange(1, 12))}</{t}>" for t in rng.choices(["p", "h2", "blockquote", "li"], k=rng.randrange(1, 5)))
    title = f"<h1>{words(2)}</h1>" if rng.random() < 0.9 else ""
    junk = f"<div class='box{rng.randrange(9)}'><p>{words(rng.randrange(1, 9))}</p></div>" if rng.random() < 0.2 else ""
    body = [f"<div class='a{rng.randrange(9)}'>{title}<section>{story}</section></div>{junk}", f"{title}<div class='story x'><div>{story}</div></div>{junk}", f"<main>{junk}{title}<div>{story}</div></main>"][template]
    return f"<html><body>{body}</body></html>"


def slow_extract(pages):
    """The same from the definition, on trees of a strict parser: every container is summed anew, every path a list of steps."""
    import re
    from collections import Counter
    from xml.etree import ElementTree

    containers = {"article", "main", "section", "div", "td", "body", "blockquote", "center", "dd", "html"}

    def read(page):
        found, paths = [], {}

        def walk(e, path, above):
            classes = sorted({re.sub(r"\d+", "#", c) for c in e.get("class", "").split()})
            path = (*path, ".".join([e.tag, *classes]))
            paths[e] = path
            if e.text and e.text.strip():
                found.append((e, [*above, e], " ".join(e.text.split())))
            for child in e:
                walk(child, path, [*above, e])

        walk(ElementTree.fromstring(page), (), [])
        return found, paths

    def held(found, paths, path):
        return [any(paths[x] == path and x.tag in containers for x in above) for _, above, _ in found]

    def best(found, paths):
        whole = sum(len(t) for _, _, t in found)
        full = [x for x in paths if x.tag in containers and sum(len(t) for _, above, t in found if x in above) == whole]
        return paths[max(full, key=lambda x: len(paths[x]))], whole

    def path_hex(path):
        return path_of(">".join(path))

    votes, scores, parsed = {}, {}, {}
    for i, url, page in pages:
        parsed[i] = read(page)
        path, score = best(*parsed[i])
        host = url.split("/")[2]
        votes.setdefault(host, Counter())[path] += 1
        scores[host, path] = scores.get((host, path), 0) + score
    out = {}
    for i, url, _ in pages:
        (found, paths), host = parsed[i], url.split("/")[2]
        every = sum(votes[host].values())
        ranked = sorted(((-n, -scores[host, p], path_hex(p), p) for p, n in votes[host].items() if n >= 2 and 20 * n >= every))
        chosen = held(found, paths, best(found, paths)[0])
        whole = sum(len(t) for _, _, t in found)
        for n, _, _, path in ranked:
            inside = held(found, paths, path)
            score = sum(len(t) for (_, _, t), c in zip(found, inside) if c)
            titled = any(e.tag == "h1" for (e, _, _), c in zip(found, inside) if not c)
            if score == whole or 2 * -n > every and 2 * score >= whole and not titled:
                chosen = inside
                break
        out[i] = " ".join(t for (_, _, t), c in zip(found, chosen) if c)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(240):
        host = rng.randrange(8)
        rows.append((i, f"http://h{host}/{i}", random_page(rng, host % 3 if rng.random() < 0.8 else rng.randrange(3))))
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == slow_extract(rows)
    assert any(got[i] != article(page_blocks(h), []) for i, _, h in rows)  # the votes matter


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></ul></nav>"
    "<div class='post-{i} content'><h1>Head {i}</h1>{body}</div><div class='sidebar'><p>{noise}</p></div><aside>More</aside>"
    "<div id='comments'><p>{noise}</p></div><form>Name <input></form><footer>&copy; site</footer></body></html>"
)


def test_consensus_and_odd_rows(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        paras = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(5, 60))) + " & <x>" for _ in range(4)]
        rows.append((i, f"https://h{i % 2}.example.com/{i}", PAGE.format(i=i, body="".join(f"<p>{entities.escape(p)}" for p in paras), noise="n " * 400)))
        want[i] = " ".join([f"Head {i}", *paras])
    rows += [(100, None, None), (101, "no url", ""), (102, None, "<p>alone</p>"), (0, *rows[0][1:])]
    want |= {100: "", 101: "", 102: "alone"}
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = extract(spark, pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id]))
    assert extract(spark, pages.limit(0)).count() == 0
