"""Main text of web pages: boilerplate is what suffixes of most distinct pages of a host share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chosen, each_text, numbered, written

#: Tokens in a row that pages of a host must share before these count as boilerplate.
SHARED_RUN = 6
#: The distinct pages of a host that must share a run, and the part of all its distinct pages that they must be.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: The part of a block's tokens that must lie in shared runs for the block to go; a heading whose first words follow
#: a shared block everywhere stays.
LEAST_COVERED = 0.8
#: The part of an article that shared blocks may be; beyond it, pages are copies of an article, not a frame around it.
MOST_SHARED = 0.5
#: Suffixes that a task holds before it judges those of its largest host.
HELD = 1 << 21

#: Element names by what they do.
HIDDEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video",
          "button", "select", "textarea", "dialog"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
          "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "svg", "template"}
FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "popup", "promo", "related", "respond", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "dialog", "alert", "form"}

BLOCK = "array<struct<text:string,main:boolean,furniture:boolean,tokens:int>>"


def _compiled():
    import re
    import sys

    store = sys.__dict__.setdefault("_repolumen_llm", {})
    if "html" not in store:
        store["html"] = (
            re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL),
            re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""),
            re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+"))
    return store["html"]


def blocks_of(html: str) -> list[tuple[str, bool, bool]]:
    """(text, inside the article or main element, inside furniture) of the text blocks of a page, in order.

    Hidden elements and comments are left out, references decoded, white space made one blank. A ``br`` is white
    space. Elements that are never closed end with what holds them; the page head, and headers that belong to the
    article itself, are told by where they stand.
    """
    from html import unescape

    tags, attributes, words = _compiled()
    stack: list[tuple[str, bool, bool, bool]] = []  # name, hidden, main, furniture
    hidden = main = furniture = False
    made: list[tuple[str, bool, bool]] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            made.append((text, main, furniture))

    at, size = 0, len(html)
    while at < size:
        m = tags.search(html, at)
        end = m.start() if m else size
        if end > at and not hidden:
            parts.append(html[at:end])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if not hidden and any(s[0] in BLOCKS for s in stack[depth:]):
                    flush()
                _, hidden, main, furniture = stack[depth]
                del stack[depth:]
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            if name in BLOCKS:
                flush()
            elif name == "br" and not hidden:
                parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                _, hidden, main, furniture = stack.pop()
        stack.append((name, hidden, main, furniture))
        values = {a[0].lower(): a[1] or a[2] or a[3] for a in attributes.findall(m[3])} if m[3] else {}
        labels = {w.lower() for w in words.findall(f"{values.get('class', '')} {values.get('id', '')}")}
        role = values.get("role", "").lower()
        inside = main and not furniture
        if name in HIDDEN or "hidden" in m[3].split() or values.get("aria-hidden") == "true":
            hidden = True
        if name in FURNITURE and not (name == "header" and inside) or role in FURNITURE_ROLES:
            furniture = True
        if labels & FURNITURE_WORDS and name not in ("html", "body", "article", "main") and not (name[:1] == "h" and name[1:].isdigit()):
            furniture = True
        if name in ("article", "main") or role in ("main", "article"):
            main = True
        if name in RAW:
            close = _closing(html, name, at)
            at = close if close >= 0 else size
    flush()
    return made


def _closing(html: str, name: str, at: int) -> int:
    import re

    m = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
    return m.start() if m else -1


def _pages(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_()), ("furniture", pa.bool_()), ("tokens", pa.int32())]))
    for batch in batches:
        found = [[{"text": t, "main": a, "furniture": f, "tokens": t.count(" ") + 1} for t, a, f in blocks_of(h.decode("utf-8", "replace"))]
                 for h in each_text(batch.column(batch.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], "blocks"])


def host_of(url: Column) -> Column:
    """The host of a page's address, in lower case; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _starts(codes, host: int, run: int):
    """A 64-bit hash of the host and the first ``run`` tokens of each suffix of a stream that has so many."""
    import numpy as np

    if len(codes) < run:
        return np.zeros(0, np.uint64)
    codes = codes.view(np.uint64)
    mixed = np.full(len(codes) - run + 1, host, np.int64).view(np.uint64)
    for k in range(run):
        mixed = (mixed ^ codes[k:len(codes) - run + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _streams(batch):
    """(host, codes) of the rows of an Arrow batch whose last two columns they are."""
    codes = batch.column(batch.num_columns - 1)
    values, ends = codes.values.to_numpy(zero_copy_only=False), codes.offsets.to_numpy()
    for i, host in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
        yield host, values[ends[i]:ends[i + 1]]


def _common(run: int, share: float):
    """A task's suffix starts that at least ``share`` of the pages in some group of a host's pages have.

    What is on that part of all pages is on it in one of the groups at least, however they are formed.
    """
    def work(batches):
        import math

        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def judged(host):
            pages = held.pop(host)
            sizes.pop(host)
            found, n = np.unique(np.concatenate(pages), return_counts=True)
            found = found[n >= math.ceil(share * len(pages))]
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["start"])

        for batch in batches:
            for host, codes in _streams(batch):
                found = np.unique(_starts(codes, host, run))
                held.setdefault(host, []).append(found)
                sizes[host] = sizes.get(host, 0) + len(found)
                if sum(sizes.values()) >= HELD:
                    yield judged(max(sizes, key=sizes.get))
        for host in list(held):
            yield judged(host)
    return work


def _suffixes(run: int):
    """(row, host, start, at, first): every suffix of a task's pages, and whether it is its page's first of that start."""
    def work(batches):
        import numpy as np
        import pyarrow as pa

        names = ["row", "host", "start", "at", "first"]
        for batch in batches:
            for row, (host, codes) in zip(batch.column(0).to_pylist(), _streams(batch), strict=True):
                found = _starts(codes, host, run).view(np.int64)
                first = np.zeros(len(found), bool)
                first[np.unique(found, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), row)), pa.array(np.full(len(found), host)), pa.array(found),
                     pa.array(np.arange(len(found), dtype=np.int32)), pa.array(first)], names=names)
    return work


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = SHARED_RUN,
              least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_covered: float = LEAST_COVERED,
              most_shared: float = MOST_SHARED) -> DataFrame:
    """(key, url, text): the main text of every page, blocks joined by line ends; other columns are left out.

    All tokens of a page, across its blocks, are a stream of its host; equal streams of a host count once. Neighbours
    in the host's suffix array share ``run`` tokens exactly if they start with the same ones, so suffixes are grouped
    by these (64-bit hashes), and no host's suffixes are ordered in one task. A run that at least ``least_pages`` and
    ``least_share`` of the host's distinct pages have is boilerplate and covers its tokens. A task first judges the
    groups of pages that it holds: a run short of that share in every group is short of it in the host, so only the
    others are counted over all pages.

    A block goes if at least ``least_covered`` of its tokens are covered. So short blocks go only within a longer
    shared run. Besides, the article element (or main element) is what stays where there is one, without furniture
    inside it, and elsewhere all that is no furniture by its markup. Where shared blocks are more than ``most_shared``
    of an article, or all of a page without one, such pages are copies of each other, and these blocks stay.
    Null and empty pages, and an empty table, give empty texts; pages without an address are one host.
    """
    source = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    schema = f"key {pages.schema[key].dataType.simpleString()}, url string, blocks {BLOCK}"
    parsed = source.mapInArrow(_pages, schema).withColumn("row", F.monotonically_increasing_id())
    parsed = written(parsed, "blocks").withColumn("host", F.xxhash64(host_of(F.col("url"))))
    texts = F.transform("blocks", lambda b: b["text"])

    # one page of each text of a host, of hosts that have enough of them
    marked, mark = numbered(parsed)
    distinct = marked.groupBy("host", F.sha2(F.array_join(texts, "\n"), 256).alias("digest")).agg(
        F.min(F.struct("row", mark)).alias("one"))
    distinct = written(distinct.select("host", "one.*"), "distinct")
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    hosts = written(hosts, "hosts")

    def streams(df):
        codes = F.transform(F.flatten(F.transform("blocks", lambda b: F.split(b["text"], " "))), lambda w: F.xxhash64(w))
        return df.select("row", "host", codes.alias("codes"))

    judged = chosen(marked, mark, distinct.join(hosts, "host", "left_semi").select(mark))
    likely = written(streams(judged).drop("row").mapInArrow(_common(run, least_share), "start bigint").distinct(), "likely")
    hits = streams(parsed).mapInArrow(_suffixes(run), "row bigint, host bigint, start bigint, at int, first boolean")
    hits = written(hits.join(likely, "start", "left_semi"), "hits")
    counted = hits.filter("first").join(distinct.select("row"), "row", "left_semi").groupBy("host", "start").count()
    shared = counted.join(hosts, "host").filter((F.col("count") >= least_pages) & (F.col("count") >= least_share * F.col("pages")))
    covering = written(hits.join(shared.select("start"), "start", "left_semi").groupBy("row").agg(
        F.sort_array(F.collect_list("at")).alias("starts")), "covering")

    joined = parsed.select("key", "url", "blocks", "row").join(covering, "row", "left").select("key", "url", "blocks", "starts")
    schema = f"key {pages.schema[key].dataType.simpleString()}, url string, text string"
    return joined.mapInArrow(_texts(run, least_covered, most_shared), schema).toDF(key, url, "text")


def kept_blocks(blocks: list[dict], starts: list[int], run: int, least_covered: float, most_shared: float) -> list[str]:
    """The texts of a page's main blocks, where the runs at ``starts`` in its stream of tokens are boilerplate."""
    import numpy as np

    ends = np.cumsum([b["tokens"] for b in blocks])
    # how many of the tokens before each place are covered
    edges = np.zeros(ends[-1] + 1, np.int64) if blocks else np.zeros(1, np.int64)
    np.add.at(edges, np.array(starts, np.int64), 1)
    np.add.at(edges, np.array(starts, np.int64) + run, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    has_main = any(b["main"] and not b["furniture"] for b in blocks)
    mine = [(b, covered[end] - covered[end - b["tokens"]] >= least_covered * b["tokens"]) for b, end in zip(blocks, ends, strict=True)
            if not b["furniture"] and (b["main"] or not has_main)]
    total = sum(b["tokens"] for b, _ in mine)
    gone = sum(b["tokens"] for b, shared in mine if shared)
    copies = gone > most_shared * total if has_main else gone == total
    return [b["text"] for b, shared in mine if copies or not shared]


def _texts(run: int, least_covered: float, most_shared: float):
    def work(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = ["\n".join(kept_blocks(b, starts or [], run, least_covered, most_shared))
                         for b, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["key", "url", "text"])
    return work
