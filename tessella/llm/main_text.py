"""Main text of web pages: page structure, and the repeats of each host.

A page becomes a row of blocks, each with a place: inside the article, inside a
part that is never article text (menus, headers, footers, adverts, forms ...),
or undecided.  Two kinds of repeats over all pages of a host go:

* Runs of ``RUN`` tokens or more that stand on two distinct pages go from
  undecided blocks, and their unique runs stay.  Only the first ``RUN`` tokens of
  a suffix matter, so a host's suffix array is partitioned by their hash.
* A whole block of ``RUN`` tokens or more goes from text that pages mark as their
  article if it stands in ``MANY`` distinct articles of the host and in half of
  all.  Articles do quote and copy each other: an article that such blocks make
  up for more than half keeps them.

Pages are parsed once and packed in chunks.  Each chunk sends its distinct hashes
(with the host's mixed in), and the ones that are repeats come back to it, so
neither chunks nor partitions bear on the result and no host is ever gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, stored
from .pretoken import mixed
from .runs import covered

RUN = 8
MANY = 10
#: A chunk ends at so many pages or characters of text.
PAGES = 2000
CHUNK = 2_000_000
#: Most hosts whose hashes go to every task (8 bytes each); beyond it the pages of all hosts send their windows.
OPEN_HOSTS = 500_000
ARTICLE, BOILER, OPEN = 0, 1, 2

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
_DROP = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "audio", "video", "canvas", "map", "fieldset"}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form", "toolbar"}
_DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "gdpr", "login", "search",
}
_MAIN_WORDS = {"article", "articlebody", "entry", "post", "story", "content", "main", "maincontent"}
#: Elements that end when another of their kind begins, or their parent ends.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _role(tag: str, attrs: str, in_article: bool) -> int | None:
    """What an element says about its content: ARTICLE, BOILER, or nothing."""
    if tag in _DROP or tag == "header" and not in_article:
        return BOILER
    words: set[str] = set()
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, value in _NAMES.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return BOILER
            if name == "role":
                if value in _DROP_ROLES:
                    return BOILER
                if value in ("main", "article"):
                    words.add("main")
            else:
                words.update(re.split(r"[^a-z0-9]+", value))
        if words & _DROP_WORDS and tag not in ("html", "body", "article", "main"):
            return BOILER
        if words & _DROP_WORDS and tag == "article" and words & {"comment", "comments", "related", "promo", "ad", "sponsored"}:
            return BOILER
    if tag in ("article", "main"):
        return ARTICLE
    if words & {"articlebody", "main"} or tag in ("div", "section") and words & _MAIN_WORDS:
        return ARTICLE
    return None


def blocks(html: str) -> list[tuple[int, str]]:
    """(place, text) of every block of a page, in page order, empty ones left out.

    Where a page has article elements, only they are its article; else its main
    element, else parts named like one.
    """
    found: list[tuple[int, int, str]] = []  # place, rank of the article mark, text
    stack: list[tuple[str, int | None, int]] = []
    parts: list[str] = []
    boiler = 0
    marks: list[int] = []
    at = 0

    def text(raw: str) -> None:
        if raw:
            parts.append(raw)

    def end_block() -> None:
        if parts:
            joined = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if joined:
                found.append((BOILER if boiler else ARTICLE if marks else OPEN, min(marks, default=9), joined))

    def leave(k: int) -> None:
        nonlocal boiler
        for _, role, mark in stack[k:]:
            if role == BOILER:
                boiler -= 1
            elif role == ARTICLE:
                marks.remove(mark)
        del stack[k:]

    while (m := _TAG.search(html, at)) is not None:
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag not in _INLINE:
                end_block()
            if k >= 0 and not (tag in _INLINE and any(s[0] not in _INLINE for s in stack[k + 1 :])):
                leave(k)
            continue
        if tag not in _INLINE:
            if tag == "br":
                text(" ")
                continue
            end_block()
        if tag in _RAW:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                at = stop.end() if stop else len(html)
            continue
        if tag in _VOID:
            continue
        if closes := _CLOSES.get(tag):
            k = len(stack) - 1
            while k >= 0 and (stack[k][0] in _INLINE or stack[k][0] in closes):
                k -= 1
            if any(s[0] in closes for s in stack[k + 1 :]):
                leave(k + 1)
        role = _role(tag, m[3], bool(marks))
        mark = 0 if tag == "article" else 1 if tag == "main" else 2
        if role == BOILER:
            boiler += 1
        elif role == ARTICLE:
            marks.append(mark)
        stack.append((tag, role, mark))
    text(html[at:])
    end_block()
    best = min((r for place, r, _ in found if place == ARTICLE), default=9)
    if best == 9:
        return [(place, t) for place, _, t in found]
    # outside the page's own article nothing is article text
    return [(ARTICLE if place == ARTICLE and r <= best else BOILER, t) for place, r, t in found]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


Page = tuple[int, list[tuple[int, str]]]  # hash of the host, blocks

_PLACE = np.random.default_rng(20240909).integers(0, 1 << 63, RUN, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _hash(text: str, seed: int = 0) -> int:
    """64 bits, signed."""
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8, salt=seed.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = _hash(word)
        return value


def _windows(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(hash, is whole, page) of the window at each token of the pages laid end to end, and the first token of each block.

    A window is whole if it ends on its page.
    """
    names, values, spans, sizes = _Words(), [], [0], []
    for _, page in pages:
        before = len(values)
        for _, t in page:
            values += [names[w] for w in t.split()]
            spans.append(len(values))
        sizes.append(len(values) - before)
    n = len(values)
    owner = np.repeat(np.arange(len(pages)), sizes)
    stop = np.cumsum(np.asarray(sizes, np.int64))[owner] if n else np.empty(0, np.int64)
    v = np.concatenate([np.asarray(values, np.int64).view(np.uint64), np.zeros(RUN, np.uint64)])
    sums = mixed(np.asarray([h for h, _ in pages], np.int64).view(np.uint64))[owner]
    for k in range(RUN):
        sums += v[k : k + n] * _PLACE[k]
    return mixed(sums).view(np.int64), stop - np.arange(n) >= RUN, owner, spans


def is_open(page: Page) -> bool:
    return any(place == OPEN for place, _ in page[1])


def distinct_windows(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window hashes of some pages; whether each stands on two of them, and on one with undecided blocks."""
    key, whole, owner, _ = _windows(pages)
    key, owner = key[whole], owner[whole]
    if not len(key):
        return key, np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    undecided = np.asarray([is_open(p) for p in pages])[owner]
    several = np.minimum.reduceat(owner, edges) < np.maximum.reduceat(owner, edges)
    return key[edges], several, np.logical_or.reduceat(undecided, edges)


def block_key(host: int, text: str) -> int:
    return _hash(text, host)


def article_blocks(page: Page) -> tuple[int, set[int]] | None:
    """(hash of the article, hashes of its distinct blocks of ``RUN`` tokens or more); None without an article."""
    texts = [t for place, t in page[1] if place == ARTICLE]
    if not texts:
        return None
    return _hash("\n".join(texts)), {block_key(page[0], t) for t in texts if len(t.split()) >= RUN}


def main_text_of(pages: list[Page], repeats: np.ndarray) -> list[str]:
    """Main texts of pages, given the hashes of their repeats (windows and article blocks)."""
    known = set(repeats.tolist())
    undecided = [p for p in pages if known and is_open(p)]
    gone, spans = np.zeros(0, bool), [0]
    if undecided:
        key, whole, _, spans = _windows(undecided)
        gone = covered(np.flatnonzero(whole & np.isin(key, repeats)), RUN, len(key))
    out, at = [], 0
    for page in pages:
        kept: list[str] = []
        if known and is_open(page):
            for place, t in page[1]:
                if place == OPEN:
                    left = [w for w, g in zip(t.split(), gone[spans[at] : spans[at + 1]].tolist(), strict=True) if not g]
                    kept += [" ".join(left)] if left else []
                elif place == ARTICLE:
                    kept.append(t)
                at += 1
        else:
            kept = [t for place, t in page[1] if place != BOILER]
            if known:
                unique = [t for t in kept if len(t.split()) < RUN or block_key(page[0], t) not in known]
                if 2 * sum(map(len, unique)) >= sum(map(len, kept)):
                    kept = unique
        out.append(" ".join(kept))
    return out


def extract(pages: list[list[tuple[int, str]]]) -> list[str]:
    """Main texts of all pages of one host, from their blocks."""
    held = [(0, page) for page in pages]
    key, several, _ = distinct_windows(held)
    articles: dict[int, set[int]] = dict(filter(None, map(article_blocks, held)))
    counts: dict[int, int] = {}
    for keys in articles.values():
        for k in keys:
            counts[k] = counts.get(k, 0) + 1
    site = [k for k, c in counts.items() if c >= MANY and 2 * c >= len(articles)]
    return main_text_of(held, np.concatenate([key[several], np.asarray(site, np.int64)]))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of parsed pages: part, the hosts of pages with undecided blocks, pages as a compressed Arrow stream."""
    part = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0

    def finish() -> pa.RecordBatch:
        nonlocal part, size
        hosts = {p[2] for p in held if is_open((0, p[3]))}
        names = ("page_id", "url", "host", "places", "texts")
        types = (kind, pa.string(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.large_string()))
        cells = zip(*((i, u, h, [p for p, _ in b], [t for _, t in b]) for i, u, h, b in held), strict=True)
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], list(names))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows)
        out = [pa.array([part]), pa.array([sorted(hosts)], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        part, size = part + 1, 0
        held.clear()
        return pa.RecordBatch.from_arrays(out, ["part", "open_hosts", "pages"])

    for batch in batches:
        kind = batch.column("page_id").type
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            found = blocks(html or "")
            held.append((page, url, _hash(host_of(url)), found))
            size += sum(len(t) for _, t in found)
            if len(held) >= PAGES or size >= CHUNK:
                yield finish()
    if held:
        yield finish()


def _unpack(cell: pa.Scalar) -> tuple[pa.RecordBatch, list[Page]]:
    rows = pa.ipc.open_stream(cell.as_buffer()).read_next_batch()
    cols = (rows.column(c).to_pylist() for c in ("host", "places", "texts"))
    return rows, [(h, list(zip(p, t, strict=True))) for h, p, t in zip(*cols, strict=True)]


def _article_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, host, article, key) of the blocks of each article; a row without a key for each article."""
    for batch in batches:
        for part, cell in zip(batch.column("part").to_pylist(), batch.column("pages"), strict=True):
            out = set()
            for page in _unpack(cell)[1]:
                if found := article_blocks(page):
                    out.update((part, page[0], found[0], k) for k in (None, *found[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["part", "host", "article", "key"])


def _window_rows(hosts: np.ndarray | None):
    """(part, key, several, undecided) of the distinct windows of a chunk; of these hosts only, if given."""
    wanted = None if hosts is None else set(hosts.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cell in zip(batch.column("part").to_pylist(), batch.column("pages"), strict=True):
                key, several, undecided = distinct_windows([p for p in _unpack(cell)[1] if wanted is None or p[0] in wanted])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), part, np.int64)), *map(pa.array, (key, several, undecided))], ["part", "key", "several", "undecided"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell, keys in zip(batch.column("pages"), batch.column("keys"), strict=True):
            rows, pages = _unpack(cell)
            repeats = keys.values.to_numpy() if keys.is_valid else np.empty(0, np.int64)
            texts = main_text_of(pages, repeats)
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (code points).

    Null html is empty; pages with a null url are a host of their own; repeated
    rows count as distinct pages (of one article) and all stay, also with a null id.
    Pages of any length are parsed whole; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    packed = stored(rows.mapInArrow(_pack, "part long, open_hosts array<long>, pages binary"), "pages")
    backs = []

    # whole blocks that half of a host's articles share
    of_articles = stored(packed.select("part", "pages").mapInArrow(_article_rows, "part long, host long, article long, key long"), "articles")
    blocks_ = of_articles.where("key IS NOT NULL").select("host", "key", "article").distinct()
    blocks_ = blocks_.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= MANY)
    totals = of_articles.where("key IS NULL").select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    site = materialize(blocks_.join(totals, "host").where("2 * n >= articles").select("key").distinct())
    if not site.isEmpty():
        backs.append(of_articles.select("part", "key").distinct().join(site, "key").select("part", "key"))

    # windows on two pages of a host with undecided blocks
    hosts = [r[0] for r in packed.select(F.explode("open_hosts").alias("host")).distinct().limit(OPEN_HOSTS + 1).collect()]
    if hosts:
        wanted = np.asarray(hosts, np.int64) if len(hosts) <= OPEN_HOSTS else None
        found = packed.select("part", "pages").mapInArrow(_window_rows(wanted), "part long, key long, several boolean, undecided boolean")
        same = Window.partitionBy("key")
        found = found.withColumn("repeated", (F.count("*").over(same) > 1) | F.max("several").over(same))
        backs.append(found.where("repeated AND undecided").select("part", "key"))

    if backs:
        keys = backs[0].unionByName(backs[1]) if len(backs) > 1 else backs[0]
        keys = keys.groupBy("part").agg(F.collect_list("key").alias("keys"))
        packed = packed.select("part", "pages").join(keys, "part", "left")
    else:
        packed = packed.withColumn("keys", F.lit(None).cast("array<long>"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return packed.select("pages", "keys").mapInArrow(_finish, f"page_id {kind}, url string, text string, n_chars long")
