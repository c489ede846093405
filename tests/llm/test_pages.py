"""The whole of operator 2 against dictionaries of token windows."""

from __future__ import annotations

from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np

from lumapair.llm import pages

LEAST = 4


def brute(rows: list[tuple], least: int) -> Counter:
    """(page_id, text) by the rules of the module, with every window of a host in one dictionary."""
    where: dict[tuple, set] = defaultdict(set)
    inside: dict[tuple, set] = defaultdict(set)
    host_pages: dict[str, set] = defaultdict(set)
    read = []
    for at, (i, url, html) in enumerate(rows):
        host, page = (url or "").split("/")[2] if url else "", ("p", i) if i is not None else ("r", url, html)
        blocks = pages.blocks_of(html)
        words = [w for _, t in blocks for w in t.split(" ")] if blocks else []
        read.append((i, host, page, blocks, words))
        if words:
            host_pages[host].add(page)
        for a in range(len(words) - least + 1):
            where[host, tuple(words[a : a + least])].add(page)
            if [r for r, t in blocks for _ in t.split(" ")][a : a + least] == ["main"] * least:
                inside[host, tuple(words[a : a + least])].add(page)
    out = Counter()
    for i, host, _, blocks, words in read:
        covered, common = [False] * len(words), [False] * len(words)
        for a in range(len(words) - least + 1):
            run = host, tuple(words[a : a + least])
            within = [r for r, t in blocks for _ in t.split(" ")][a : a + least] == ["main"] * least
            n = len(inside[run]) if within else 0
            for k in range(a, a + least):
                covered[k] |= len(where[run]) > 1
                common[k] |= n > pages.MAIN_SHARE * len(host_pages[host]) and n >= pages.MAIN_PAGES
        region = [r for r, t in blocks for _ in t.split(" ")]
        is_main, kept, at = "main" in region, [], 0
        few = 2 * sum(c for c, r in zip(common, region) if r == "main") < region.count("main")
        for r, t in blocks:
            own = t.split(" ")
            span = range(at, at + len(own))
            at += len(own)
            if is_main and r == "main" and not (few and all(common[k] for k in span)):
                kept.append(t)
            elif not is_main and r == "open" and (left := [w for w, k in zip(own, span) if not covered[k]]):
                kept.append(" ".join(left))
        out[i, "\n".join(kept)] += 1
    return out


def test_pages_against_brute_force(spark):
    rng = np.random.default_rng(20)
    notice = "<p>Sign up for our free weekly letter</p>"
    passage = "<p>these words stand in two articles only</p>"
    rows: list[tuple] = []
    for i in range(40):
        own = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))
        host = f"http://h{i % 2}.example/{i}"
        menu = "".join(f"<div>m{j}</div>" for j in range(6))
        if i % 5 == 4:
            rows.append((i, host, f"<body>{menu}<div>{own}</div><div>a b c d e f</div>"))
        else:
            rows.append((i, host, f"<body><nav>{menu}</nav><article><h1>t{i}</h1><p>{own}</p>{notice}{passage if i in (1, 3) else ''}</article>"))
    rows += [(50, "http://h0.example/x", rows[0][2]), (0, "http://h0.example/0", rows[0][2]), (None, "http://h1.example/", rows[4][2]), (51, None, "<p>x"), (52, "http://h0.example/", None), (53, "http://h2.example/", "<p>" + "long " * 3_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, k string, `cut.x` int")
    want = brute(rows, LEAST)
    texts = {i: t for i, t in want}
    assert "Sign up" not in texts[1] and "these words" in texts[1] and "m0" not in texts[4]
    for part_bytes in (1 << 20, 400):
        got = pages.main_texts(df, least=LEAST, part_bytes=part_bytes).collect()
        assert Counter((r["page_id"], r["text"]) for r in got) == want
        assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_attributes_are_read_one_by_one():
    def main(html: str) -> list[str]:
        return [t for r, t in pages.blocks_of(f"<article>{html}</article>") if r == "main"]

    assert main("<a href='/hidden-lake'>x</a>") == ["x"] and main("<p title='a hidden gem'>x") == ["x"]
    assert main("<a href='/x?id=menu'>x</a>") == ["x"] and main("<p data-grid='ads'>x") == ["x"]
    assert main("<p title=it's>x") == ["x"] and main("<math>1+2</math>") == ["1+2"] and main('<h1 class="article-header">x</h1>') == ["x"]
    assert main("<p class='ad'>x") == [] and main("<div hidden>x</div>") == [] and main("<div ROLE=search>x</div>y") == ["y"]


def text_of(html: str) -> str:
    blocks = pages.blocks_of(html)
    wanted = "main" if any(r == "main" for r, _ in blocks) else "open"
    return "\n".join(t for r, t in blocks if r == wanted)


def test_wrappers_hide_no_article():
    for wrapper in (
        '<div class="container with-sidebar">{}</div>', '<div id="page" class="has-header">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="page-header-fixed">{}</div>', '<div class="site-header"><p>Logo</p>{}</div>',
        '<form class="menu"><div>Go</div><div class="sidebar">{}</div></form>', '<div class="comments-on-law">{}</div>',
    ):
        for article in ("<article><p>The text.</p></article>", "<main><p>The text.</p></main>", '<div role="main"><p>The text.</p></div>', '<div class="post-content"><p>The text.</p></div>'):
            page = f"<body><nav>Home</nav>{wrapper.format(article)}<footer>(c)</footer></body>"
            assert text_of(page) == "The text.", page


def test_names_count_whole():
    article = '<article><p>One.</p>{}<p>Two.</p></article>'
    for kept in ('<section class="menu">Soup.</section>', '<div class="social-history">Soup.</div>', '<ol class="comments-on-law"><li>Soup.</li></ol>', '<div class="header">Soup.</div>', '<div class="adult-education">Soup.</div>'):
        assert text_of(article.format(kept)) == "One.\nSoup.\nTwo.", kept
    for gone in (
        '<div class="ad">x</div>', '<div class="ad-slot-3">x</div>', '<section class="comments">x</section>', '<div id="commentList">x</div>', '<ul class="share_buttons"><li>x</li></ul>', '<div class="newsletter-signup"><p>x</p></div>',
        '<div class="cookie-notice">x</div>', '<div class="related-posts">x</div>', '<aside>x</aside>', '<div class="left sidebar">x</div>', "<form>x</form>", '<nav class="page">x</nav>', '<section class="comments"><article>x</article></section>',
    ):
        assert text_of(article.format(gone)) == "One.\nTwo.", gone


def test_teasers_and_comments_are_no_main_text():
    own = "<article><p>Own.</p></article>"
    for other in ('<div class="sidebar"><article>Teaser.</article></div>', '<div class="widget"><article>Teaser.</article></div>', '<div class="comments"><article>First!</article></div>', "<aside><article>x</article></aside>"):
        assert text_of(f"<body>{other}{own}{other}</body>") == "Own."
    assert text_of('<body><div>Own.</div><div class="comments"><article>First!</article></div></body>') == "Own."


def test_the_array_decides_on_doubtful_parts_of_articles(spark):
    """The menu of a recipe stays; one that most pages of the host have goes, with the number of pages that the array changes."""
    rng = np.random.default_rng(21)
    common = '<div class="menu">Home News Sport Culture Travel Money Weather About</div>'
    rows = []
    for i in range(30):
        own = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40))
        recipe = f'<section class="menu">Soup of {own[:60]} and bread with butter today</section>'
        rows.append((i, f"http://{'a' if i % 2 else 'b'}.example/{i}", f"<article>{common if i % 2 else recipe}<p>{own}</p></article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part_bytes in (1 << 20, 500):
        got = {r["page_id"]: r["text"] for r in pages.main_texts(df, part_bytes=part_bytes).collect()}
        plain = {i: text_of(h) for i, _, h in rows}
        assert all(("Home News" in plain[i]) == (i % 2 == 1) and "Home News" not in got[i] for i in got)
        assert [i for i in got if got[i] != plain[i]] == list(range(1, 30, 2)) and all("Soup of" in got[i] for i in range(0, 30, 2))


class _Plain(HTMLParser):
    """A page's main text by the standard library's parser, for well-formed pages with an article: an independent reading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.off, self.blocks, self.held = 0, 0, [], ""

    def _close(self) -> None:
        if t := " ".join(self.held.split()):
            self.blocks.append(t)
        self.held = ""

    def handle_starttag(self, tag, attrs) -> None:
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).split()
        self.off += bool(self.off or tag in ("nav", "aside", "footer", "form", "script", "style") or set(names) & {"ad", "comments", "share"}) if tag != "br" else 0
        if tag in ("p", "div", "h1", "h2", "li", "ul", "article", "section", "br", "nav", "aside", "footer", "form"):
            self._close()
        self.depth += tag == "article"

    def handle_endtag(self, tag) -> None:
        if tag in ("p", "div", "h1", "h2", "li", "ul", "article", "section", "nav", "aside", "footer", "form"):
            self._close()
        self.depth -= tag == "article"
        self.off -= bool(self.off)

    def handle_data(self, data) -> None:
        if self.depth and not self.off:
            self.held += data


def test_the_reader_against_the_standard_library():
    rng = np.random.default_rng(22)
    words = ["soup", "a&amp;b", "&lt;i&gt;", "caf&eacute;", "&#8364;5", "x &nbsp; y", "<b>bold</b>", "<a href='/m'>link</a>", "\n\t", "<i class='menu'>kept</i>"]

    def piece(depth: int) -> str:
        text = " ".join(rng.choice(words, rng.integers(1, 6)))
        kind = rng.choice(["p", "h2", "div", "ul", "section", "br", "nav", "ad", "comments", "share", "script", "form"])
        inner = piece(depth - 1) if depth and rng.random() < 0.6 else text
        match kind:
            case "br":
                return f"{text}<br>{text}"
            case "ul":
                return f"<ul><li>{text}</li><li>{text}</li></ul>"
            case "script":
                return f"{text}<script>if (a < b) {{ '</p>' }}</script>"
            case "ad" | "comments" | "share":
                return f"<div class='{kind}'>{inner}</div>"
            case "p" | "h2":
                return f"<{kind}>{text}</{kind}>"
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(400):
        page = f"<html><body><nav>n</nav><article>{''.join(piece(3) for _ in range(4))}</article><footer>f</footer></body></html>"
        plain = _Plain()
        plain.feed(page)
        plain._close()
        assert text_of(page) == "\n".join(plain.blocks), page


def test_broken_markup_takes_time_in_proportion():
    for html in ("<i>" * 20_000 + "</b>" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<a x='" * 20_000, "<a " + "= " * 50_000):
        pages.blocks_of(html)
