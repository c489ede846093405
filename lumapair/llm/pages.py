"""Main text of web pages, with host-wide suffix arrays against boilerplate (operator 2).

A page is read as blocks of text, each with the region it stands in: `main` (article
or main element), `chrome` (menus, headers, footers, sidebars, notices, adverts,
forms, comments, by element, role or class) or `open` (neither). The token streams of
all blocks of a host's pages, whatever their region, are concatenated, and a suffix array
sorts all places by the next `least` tokens: places that stand together on distinct pages
start a repeated run, and tokens in such runs are covered, which is what the runs of
maximal length cover. What that decides:

* Chrome never is main text.
* A page without a main block keeps its open blocks, less every covered token.
* A block within an article goes if it is covered whole by runs that more than
  `MAIN_SHARE` of the host's pages have in their articles, `MAIN_PAGES` at least (unmarked notices, share
  lines), and such runs cover less than half of the article. Copies of articles and
  passages that some articles share are main text and stay.

Hosts of any size: pages are dealt into parts of a bounded number of tokens, each with
its own suffix array, in one shuffle of token hashes (24 bits each); texts are not
shuffled. Of a host with several parts, each part tells the hashes of its runs and where
the rows that they may concern have them; the numbers of pages are added over the parts.
Within articles only runs are told that reach the part's share of pages, less 4 standard
deviations of a random part, for `MAIN_SHARE` of the host; hosts with a page without a
main block are dealt once more and tell all their runs. The pages are read again at the
end, and joined with the few that lose something by a hash of the whole row.

Defined results for odd input: null html is empty and gives an empty text; a null url
has the host ''; broken markup is read as far as it goes, in time proportional to the
page (unclosed elements end with their region); texts of any length are read whole;
repeated rows of a page_id are one page for repetition, and each gives its row; of equal
blocks all or none go; an empty table gives an empty result; other columns are ignored,
whatever their names. Ids may be null.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumapair.session import materialize

#: Tokens that a repeated run has at least.
MIN_RUN = 8
#: Bytes of html that one part of a host holds, about.
PART_BYTES = 2 << 20
#: Share and number of a host's pages above which a run within articles is boilerplate.
MAIN_SHARE, MAIN_PAGES = 0.5, 3
#: Hosts in several parts, above which their table is not broadcast but joined by a shuffle.
BROADCAST_HOSTS = 20_000

_SKIPPED = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "title"}
_CHROME = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
#: Elements whose class may take them out of an article; headings and inline elements stay.
_CONTAINERS = set("address aside blockquote details div dl fieldset figure ol p section table ul".split())
_MAIN = {"article", "main"}
_BLOCKS = _CHROME | _MAIN | set("address blockquote body br center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stop at the end of a region even if they were never closed.
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
#: Parts of a class or id (between blanks, hyphens and underscores) that name what is not the article. A name counts if all its parts are of these lists and one is of the first three.
_DISCUSSION = set("comment comments disqus replies reply respond responses".split())
_OFFERS = set(
    "ad ads advert adverts advertisement advertisements advertising consent cookie cookies gdpr newsletter pager pagination popup promo promoted promotion related share sharing sponsor sponsored sponsors subscribe subscription".split()
)
_FRAME = set("banner breadcrumb breadcrumbs footer header masthead menu modal nav navbar navigation notice sidebar sidenav skip social toolbar topbar widget widgets".split())
_NEUTRAL = set(
    "area article articles bar blog block body bottom box button buttons col column container content desktop end entry facebook fb first fixed form global google group holder icons in inline inner item items large last latest left link "
    "links list main media mobile more new outer overlay page panel popular post posts primary reader readers right row secondary section signup site slot small sticky story text to top twitter unit user users window wp wrap wrapper".split()
)
#: Names that an article's own parts have too; within an article, what repeats over the host decides about them.
_DOUBTFUL = {"footer", "header", "menu"}
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article-?(?:body|content|text)|post-?(?:body|content)|entry-?content|main-?content|content-?body|story-?body)(?=$|[\s_-])", re.IGNORECASE)
# Attributes one by one: a name, and a value in quotes or up to the next blank. Nothing is tried twice.
_VALUE = r"(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+|)))?+"
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)" + _VALUE)
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*>?|\?[^>]*>?|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+" + re.sub(r"\((?!\?)", "(?:", _VALUE) + r")*+)(?:>|\Z))", re.DOTALL)
_SPACE = re.compile(r"\s+")

Block = tuple[str, str]


def _named(value: str, within: bool) -> str:
    """What a class or id says: `hard` or `soft` chrome, or nothing. Within an article doubtful names say nothing."""
    found = ""
    for name in value.split():
        parts = {p.lower().rstrip("0123456789") for p in _PARTS.split(name)} - {""}
        known = parts & (_DISCUSSION | _OFFERS | _FRAME)
        if not known or parts - known - _NEUTRAL or within and known <= _DOUBTFUL:
            continue
        if known - _FRAME:
            return "hard"
        found = "soft"
    return found


def _region(name: str, attrs: str, now: str) -> str:
    """The region within an element that opens in region `now`. `soft` is chrome by a name or a form, in which an article may still stand; `inner` is such an article."""
    if now == "chrome":
        return now
    if name in _CHROME and not (name == "header" and now in ("main", "inner")):
        if name != "form":
            return "chrome"
        now = "soft" if now in ("open", "soft") else "chrome"
    found = ""
    if attrs and attrs.strip(" /"):
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), entities.unescape(a or b or c)
            if key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return "chrome"
            if key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return "chrome"
            if key == "role" and value.lower() in ("main", "article"):
                found = value.lower()
            if key in ("class", "id"):
                within = now in ("main", "inner")
                if _MAIN_WORDS.search(value):
                    found = found or "article"
                elif name not in ("html", "body", "article", "main") and (not within or name in _CONTAINERS) and (says := _named(value, within)):
                    if says == "hard" or within:
                        return "chrome"
                    now = "soft"
    if name == "main" or found == "main":
        return "main"
    if name == "article" or found:
        return "inner" if now in ("soft", "inner") else "main"
    return now


def blocks_of(page: str | None) -> list[Block]:
    """(region, text) of the blocks of a page in order; texts have single blanks and are not empty."""
    page = page or ""
    out: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements and the region around each
    named: dict[str, int] = {}  # how many of them have a name
    places: list[int] = []  # places of the block elements among them
    region, at, n = "open", 0, len(page)

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((region, text))

    def leave(i: int) -> None:
        """End the element at place i and those within it."""
        nonlocal region
        region = stack[i][1]
        for name, _ in stack[i:]:
            named[name] -= 1
        del stack[i:]
        while places and places[-1] >= i:
            places.pop()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if named.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if name in _BLOCKS or stack[i][1] != region:
                    close()
                leave(i)
            elif name in _BLOCKS:
                close()
            continue
        if name in _SKIPPED:
            # Raw text to its end tag; without one, to the end of the page, but a head may lack its end.
            stop = re.compile(rf"</{re.escape(name)}\s*>" + ("|(?=<body\\b)" if name == "head" else ""), re.IGNORECASE)
            if name == "head":
                at = _end_of_head(page, at)
            elif end := stop.search(page, at):
                at = end.end()
            else:
                at = n
            continue
        inner = _region(name, m[3], region)
        if name in _BLOCKS or inner != region:
            close()
        if name in _VOID or m[3].endswith("/") and name not in _BLOCKS:
            continue
        if name == "p" and places and stack[places[-1]][0] == "p":  # a paragraph ends an open one
            leave(places[-1])
            inner = _region(name, m[3], region)
        if name in _BLOCKS:
            places.append(len(stack))
        named[name] = named.get(name, 0) + 1
        stack.append((name, region))
        region = inner
    close()
    # Articles within soft chrome are the page's text only if there is no other: else they are teasers.
    main = {"soft": "chrome", "inner": "chrome" if any(r == "main" for r, _ in out) else "main"}
    return [(main.get(r, r), t) for r, t in out]


def _end_of_head(page: str, at: int) -> int:
    """Where a head ends: behind its end tag, or at the body; raw texts in it are passed over."""
    look = re.compile(r"</head\s*>|(?=<body\b)|<(script|style|title|noscript)\b", re.IGNORECASE)
    while m := look.search(page, at):
        if not m[1]:
            return m.end()
        end = re.compile(rf"</{m[1]}\s*>", re.IGNORECASE).search(page, m.end())
        if end is None:
            return len(page)
        at = end.end()
    return len(page)


def run_pages(tokens: np.ndarray, page: np.ndarray, least: int = MIN_RUN, wanted: np.ndarray | None = None) -> np.ndarray:
    """For each place, on how many distinct pages the run of `least` tokens that starts there stands; 0 if it would reach into the next page. `wanted`: the places that count.

    tokens: numbers of all pages, one after the other; page: the page of each token, never
    falling. A suffix array to the depth `least`: ranks of places by the next 1, 2, 4, ... tokens.
    """
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if n < least:
        return out
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < least:
        step = min(depth, least - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1]
        depth += step
    ends = np.flatnonzero(np.append(page[1:] != page[:-1], True)) + 1
    places = np.flatnonzero(np.arange(n) + least <= ends[np.searchsorted(ends, np.arange(n), "right")])
    if wanted is not None:
        places = places[wanted[places]]
    if not len(places):
        return out
    suffixes = places[np.argsort(rank[places], kind="stable")]
    key, owner = rank[suffixes], page[suffixes]
    fresh = np.append(True, key[1:] != key[:-1])
    # Equal keys stand together, in page order.
    edges = np.flatnonzero(fresh)
    distinct = np.add.reduceat((fresh | np.append(True, owner[1:] != owner[:-1])).astype(np.int64), edges)
    out[suffixes] = np.repeat(distinct, np.diff(np.append(edges, len(suffixes))))
    return out


def covered_by(starts: np.ndarray, least: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a run of `least` tokens from one of the places where starts is true."""
    change = np.zeros(len(starts) + least + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(change, at, 1)
    np.add.at(change, at + least, -1)
    return np.cumsum(change)[: len(starts)] > 0


_REGIONS = ("chrome", "main", "open")
_READ = pa.schema([("k", pa.int64()), ("page", pa.int64()), ("host", pa.string()), ("tokens", pa.binary()), ("blocks", pa.list_(pa.int32()))])
_READ_DDL = "k long, page long, host string, tokens binary, blocks array<int>"
#: What a part tells: a row's cut; a run's number of pages; a place of a run in a row; a row's blocks; its pages, and whether one has no main block.
_DONE, _COUNT, _PLACE, _BLOCKS_OF, _FACTS = range(5)
_TOLD = pa.schema([("what", pa.int32()), ("k", pa.int64()), ("list", pa.list_(pa.int32())), ("host", pa.string()), ("main", pa.bool_()), ("h", pa.int64()), ("n", pa.int64())])
_TOLD_DDL = "what int, k long, list array<int>, host string, main boolean, h long, n long"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to their token hashes and blocks (3 x number of tokens + place of the region in _REGIONS)."""
    known: dict[str, bytes] = {}
    for b in batches:
        tokens, blocks = [], []
        for page in b["html"].to_pylist():
            found = blocks_of(page)
            words = [t.split(" ") for _, t in found]
            blocks.append([3 * len(w) + _REGIONS.index(r) for w, (r, _) in zip(words, found)])
            if len(known) > 200_000:
                known.clear()
            tokens.append(b"".join([known.get(w) or known.setdefault(w, xxhash.xxh64_digest(w)[:3]) for ws in words for w in ws]))
        yield pa.RecordBatch.from_arrays([b["k"], b["page"], b["host"], pa.array(tokens, pa.binary()), pa.array(blocks, pa.list_(pa.int32()))], schema=_READ)


class _Part:
    """The streams of a part's rows, one after the other; rows of a page stand together and are one page."""

    def __init__(self, rows: list[dict], least: int) -> None:
        self.rows, self.least = rows, least
        raw = np.frombuffer(b"".join(r["tokens"] for r in rows), np.uint8).reshape(-1, 3).astype(np.int64)
        own = raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]
        sizes = [len(r["tokens"]) // 3 for r in rows]
        self.ends = np.cumsum([n + 1 for n in sizes])
        # A separator of its own ends each row, so that no run reaches from one row into the next.
        self.tokens = np.insert(own, np.cumsum(sizes), -1 - np.arange(len(rows)))
        numbers: dict[int, int] = {}
        self.page = np.repeat([numbers.setdefault(r["page"], len(numbers)) for r in rows], [n + 1 for n in sizes])
        region = [np.concatenate([np.repeat(np.array(r["blocks"], np.int64) % 3, np.array(r["blocks"], np.int64) // 3), [-1]]) for r in rows]
        self.region = np.concatenate(region).astype(np.int64)
        self.pages = len(numbers)

    def _whole(self, bad: np.ndarray) -> np.ndarray:
        """Places from which a run holds no bad token."""
        padded = np.append(bad, np.ones(self.least, bool))
        return ~np.lib.stride_tricks.sliding_window_view(padded, self.least).any(axis=1)[: len(bad)]

    def starts(self, main: bool) -> np.ndarray:
        """Number of pages of the run that starts at each place, over all runs or over those within main blocks."""
        bad = self.region != _REGIONS.index("main") if main else self.tokens < 0
        return run_pages(self.tokens, self.page, self.least, self._whole(bad))

    def hashes(self) -> np.ndarray:
        """Hash of the run of `least` tokens from each place."""
        one = np.append(self.tokens, np.zeros(self.least, np.int64)).astype(np.uint64)
        h = np.zeros(len(self.tokens), np.uint64)
        for i in range(self.least):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[i : i + len(h)]
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _cut(blocks: list[int], starts: np.ndarray, least: int) -> list[int]:
    """Ranges of tokens that a row loses to the runs which begin at starts."""
    sizes, regions = np.array(blocks, np.int64) // 3, np.array(blocks, np.int64) % 3
    region = np.repeat(regions, sizes)
    covered, main = covered_by(starts, least), region == _REGIONS.index("main")
    if not main.any():
        gone = covered & (region == _REGIONS.index("open"))
    else:
        gone = np.zeros(len(region), bool)
        if 0 < 2 * (covered & main).sum() < main.sum():
            at = 0
            for size, r in zip(sizes.tolist(), regions.tolist()):
                gone[at : at + size] = r == _REGIONS.index("main") and covered[at : at + size].all()
                at += size
    return np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()


def _told(what: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, what) if f.name == "what" else columns.get(f.name, [None] * n), f.type) for f in _TOLD], schema=_TOLD)


def _each_part(rows: list[dict], least: int, open_round: bool) -> Iterator[pa.RecordBatch]:
    """What a part has to tell. Of a host in several parts: first about runs within articles, and in an open round about all runs."""
    part, host = _Part(rows, least), rows[0]["host"]
    one_part = rows[0]["parts"] == 1
    has_open = any(all(b % 3 != _REGIONS.index("main") for b in r["blocks"]) for r in rows)
    none = np.zeros(len(part.tokens), np.int64)
    n_main = none if open_round else part.starts(True)
    n_any = part.starts(False) if open_round or one_part and has_open else none
    if one_part:
        told_main, told_any = (n_main > MAIN_SHARE * part.pages) & (n_main >= MAIN_PAGES), n_any > 1
    else:
        told_main, told_any = n_main > max(0.0, MAIN_SHARE * part.pages - 2.1 * part.pages**0.5), n_any > 0
        h = part.hashes()
        if not open_round:
            yield _told(_FACTS, host=[host], main=[has_open], n=[part.pages])
        for main, told, n in ((True, told_main, n_main), (False, told_any, n_any)):
            runs, first = np.unique(h[told], return_index=True)
            yield _told(_COUNT, host=[host] * len(runs), main=[main] * len(runs), h=runs, n=n[told][first])
    start = 0
    for r, end in zip(rows, part.ends.tolist()):
        main = any(b % 3 == _REGIONS.index("main") for b in r["blocks"])
        starts = (told_main if main else told_any)[start : end - 1]
        if starts.any():
            if one_part:
                if cut := _cut(r["blocks"], starts, least):
                    yield _told(_DONE, k=[r["k"]], list=[cut])
            else:
                at = np.flatnonzero(starts)
                yield _told(_BLOCKS_OF, k=[r["k"]], list=[r["blocks"]])
                yield _told(_PLACE, k=[r["k"]] * len(at), host=[r["host"]] * len(at), main=[main] * len(at), h=h[start + at], n=at)
        start = end


def _parts(least: int, open_round: bool):
    """Rows sorted by (host, part) to what their parts tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if rows and (rows[0]["host"], rows[0]["part"]) != (row["host"], row["part"]):
                    yield from _each_part(rows, least, open_round)
                    rows = []
                rows.append(row)
        if rows:
            yield from _each_part(rows, least, open_round)

    return run


def _cuts(least: int):
    """Rows of split hosts (k, blocks, places of runs) to their cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blocks, places in zip(b["blocks"].to_pylist(), b["places"].to_pylist()):
                starts = np.zeros(sum(x // 3 for x in blocks), bool)
                starts[places] = True
                out.append(_cut(blocks, starts, least))
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(out, pa.list_(pa.int32()))], ["cut_k", "cut"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages and what they lose to their texts."""
    for b in batches:
        out = []
        for page, cut in zip(b["html"].to_pylist(), b["cut"].to_pylist()):
            blocks = blocks_of(page)
            wanted = "main" if any(r == "main" for r, _ in blocks) else "open"
            if not cut:
                out.append("\n".join([t for r, t in blocks if r == wanted]))
                continue
            kept, at = [], 0
            gone = {i for s, e in zip(cut[::2], cut[1::2]) for i in range(s, e)}
            for r, t in blocks:
                words = t.split(" ")
                if r == wanted and (left := [w for i, w in enumerate(words, at) if i not in gone]):
                    kept.append(" ".join(left))
                at += len(words)
            out.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_RUN, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of pages: id_col, url, text, n_chars."""
    named = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    base = named.withColumn("k", F.xxhash64("page_id", "url", "html"))
    page = F.when(F.col("page_id").isNull(), F.col("k")).otherwise(F.xxhash64("page_id"))
    streams = base.select("k", page.alias("page"), host_of(F.col("url")).alias("host"), "html").mapInArrow(_streams, _READ_DDL)
    streams = streams.where(F.octet_length("tokens") > 0)
    sizes = base.groupBy(host_of(F.col("url")).alias("host")).agg((F.floor(F.sum(F.octet_length("html").cast("long")) / part_bytes) + 1).alias("parts"))
    # Hosts in one part need no table; the others are few, as each fills a part.
    large = materialize(sizes.where("parts > 1"), "hosts")
    known = F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = streams.join(known, "host", "left").withColumn("part", F.pmod(F.xxhash64("page"), parts)).select("host", "part", "page", "k", "tokens", "blocks", parts.alias("parts"))

    def tell(rows: DataFrame, open_round: bool) -> DataFrame:
        return materialize(rows.repartition("host", "part").sortWithinPartitions("host", "part", "page", "k").mapInArrow(_parts(least, open_round), _TOLD_DDL), "runs")

    told = tell(dealt, False)
    facts = materialize(told.where(F.col("what") == _FACTS).groupBy("host").agg(F.sum("n").alias("host_pages"), F.bool_or("main").alias("open")), "host-pages")
    if not facts.where("open").isEmpty():
        told = told.union(tell(dealt.join(facts.where("open").select("host"), "host", "left_semi"), True))
    # Of a host in several parts: the runs that enough pages have, at the places where rows have them.
    counts = told.where(F.col("what") == _COUNT).groupBy("host", "main", "h").agg(F.sum("n").alias("pages")).join(facts.select("host", "host_pages"), "host")
    enough = F.when(F.col("main"), (F.col("pages") > MAIN_SHARE * F.col("host_pages")) & (F.col("pages") >= MAIN_PAGES)).otherwise(F.col("pages") > 1)
    places = told.where(F.col("what") == _PLACE).select("host", "main", "h", "k", F.col("n").cast("int").alias("at"))
    places = places.join(counts.where(enough).select("host", "main", "h"), ["host", "main", "h"]).groupBy("k").agg(F.collect_set("at").alias("places"))
    blocks = told.where(F.col("what") == _BLOCKS_OF).groupBy("k").agg(F.first("list").alias("blocks"))
    split = blocks.join(places, "k").mapInArrow(_cuts(least), "cut_k long, cut array<int>").where(F.size("cut") > 0)
    done = told.where(F.col("what") == _DONE).groupBy(F.col("k").alias("cut_k")).agg(F.first("list").alias("cut"))
    cuts = materialize(done.union(split), "cuts")
    found = base.join(cuts, F.col("k") == F.col("cut_k"), "left").select("page_id", "url", "html", "cut").mapInArrow(_texts, "page_id long, url string, text string")
    return found.select(F.col("page_id").alias(id_col), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
