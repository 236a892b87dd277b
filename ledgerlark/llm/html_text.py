"""Main text of web pages by differencing each page with its nearest page of the same host.

A page is cut into text lines (its blocks). Pages are put in order of host and URL path; a page's nearest page is the
neighbour on either side, on the same host, that shares more leading path segments (the one before on a tie). Lines of
the two are aligned by longest common subsequence, and shared lines are deleted. Copies and near copies (pages whose
shared lines hold most of the characters of both) tell nothing about each other: then the other neighbour is compared.

Differencing alone is not right in two cases, where the markup decides: lines of elements that hold no article text
(navigation, scripts, forms, adverts, comments and the like) go whether they are shared or not, and lines of an
<article> or <main> stay although other pages quote them. It decides on all other lines of every page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from .store import cut, unused
from .url_filters import _PATH, host

BROADCAST_ROWS = 50_000
PART_ROWS = 100_000
#: Pages are near copies if shared lines hold more than this share of the characters of both.
NEAR_COPY = 0.9

# Names of elements and of classes, ids and roles.
RAW = "script|style|noscript|template|iframe|svg|textarea|select|canvas|object"
NOT_ARTICLE = frozenset("head title nav header footer aside form menu dialog button label fieldset audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = frozenset("p li dt dd".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related respond share sharing"
    " sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: In an article, where class names also describe its parts, only these count as parts of a name, and not beside the others.
REMARKS = frozenset("advert advertisement comment comments cookie disqus newsletter signup sponsored".split())
NO_REMARK = frozenset("closed count disabled enabled free no not off on open without".split())
SITE_HEADER = frozenset("header masthead site-header page-header main-header top-header global-header".split())

#: A comment, a declaration, or a tag; quantifiers never give back, so a search takes linear time.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?>[^>\"'=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+)>",
    re.S,
)
_RAW_NAMES = frozenset(RAW.split("|"))
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in _RAW_NAMES}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _hides(name: str, attributes: str, article: bool) -> bool:
    """Whether an element holds no article text by its name or attributes. In an article, a class or id counts as a whole, and few words as parts of it."""
    if name in NOT_ARTICLE:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[^a-z0-9]+", word)
                if word in SITE_HEADER or word in BOILERPLATE or not (REMARKS if article else BOILERPLATE).isdisjoint(parts) and not (article and not NO_REMARK.isdisjoint(parts)):
                    return True
    return False


def _tokens(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "" or "/", tag name or "", attributes) for each piece of markup; raw elements have no name."""
    at, last = 0, source.rfind(">") + 1  # no tag ends after it
    while at < last and (found := _TOKEN.search(source, at, last)):
        before, name, end = source[at : found.start()], (found[2] or "").lower(), found.end()
        if name in _RAW_NAMES and not found[1] and not found[3].endswith("/"):  # up to its own end tag
            close = _RAW_END[name].search(source, end)
            end, name = close.end() if close else len(source), ""
        elif not name and source.startswith("<!--", found.start()) and not source.endswith("-->", 0, end):
            end = len(source)  # an open comment
        yield before, found[1] or "", name, found[3] or ""
        at = end
    open_tag = re.search(r"<[A-Za-z/!?]", source[at:])  # never closed
    yield source[at : at + open_tag.start()] if open_tag else source[at:], "", "", ""


def lines(source: str | None) -> list[tuple[str, int]]:
    """(line, zone) of a page: zone 0 can hold no article text, 1 is open, 2 lies in an article.

    A hidden element inside a block leaves the block's line whole: what stood before it goes on after it. It ends with its own
    end tag, or at the latest with that of the block around it.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    outside: list[str] = []  # of the block around a hidden element, what stood before it
    hidden, depth, article, inner = "", 0, 0, 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, 0 if hidden else 2 if article else 1))
            held.clear()

    def show() -> None:
        nonlocal hidden
        flush()
        held.extend(outside)
        outside.clear()
        hidden = ""

    for before, slash, name, attributes in _tokens(source or ""):
        if before:
            held.append(before)
        if not name:
            continue
        if name in BLOCK:
            flush()
        if hidden:
            if hidden in IMPLIED and (name == hidden or (hidden == "p" and name in BLOCK)):
                depth = 0  # its end tag, or the next element, which ends it
            elif name == hidden and name not in VOID:
                depth += -1 if slash else 0 if attributes.endswith("/") else 1
            elif hidden not in BLOCK and name in BLOCK and name not in VOID:
                inner += -1 if slash else 1
                depth = 0 if inner < 0 else depth
            if depth > 0:
                continue
            around, own = inner < 0, name == hidden
            show()
            if around:
                flush()
            if slash and name not in ("article", "main"):
                continue
            if own and name not in IMPLIED and name not in BLOCK:
                continue
        if name in ("article", "main"):
            article = max(0, article + (-1 if slash else 1))
        elif not slash and name not in VOID and not attributes.endswith("/") and _hides(name, attributes, article > 0):
            outside.extend(held)
            held.clear()
            hidden, depth, inner = name, 1, 0
    show()
    flush()
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski's method)."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    places = defaultdict(list)
    for j in range(len(b) - high - 1, low - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(low, len(a) - high):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(low), *middle[::-1], *range(len(a) - high, len(a))]


def shared_lines(page: tuple[list[int], list[int]], others: list[tuple[list[int], list[int]]]) -> list[int]:
    """Places of the page's lines (hashes, lengths) that it shares with the first of the others that is no near copy."""
    own, sizes = page
    for lines_, sizes_ in others:
        found = common(own, lines_)
        held = sum(sizes[k] for k in found)
        if held <= NEAR_COPY * max(sum(sizes), sum(sizes_)):
            return found
    return []


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def _in_order(hashed: DataFrame) -> DataFrame:
    """hashed with at: the place of each row in the order of host and path, counted over all rows without gathering them."""
    by = ["host", "path", "h", "g"]
    n = max(1, -(-hashed.count() // PART_ROWS))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = [pa.array([part] * len(batch), pa.int32()), pa.array(range(first, first + len(batch)), pa.int64())]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "part", "k"])
            first += len(batch)

    schema = StructType([*hashed.schema.fields]).add("part", IntegerType()).add("k", LongType())
    dealt = cut(hashed.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(number, schema), "ordered")
    sizes = dealt.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each PART_ROWS pages
    return dealt.join(F.broadcast(before), "part").withColumn("at", F.col("k") + F.col("before")).drop("part", "k", "before")


def _shared(pages: DataFrame, html: str, h: str, g: str, url: str) -> DataFrame:
    """h, g (hashes of a page's columns) and shared: the places of lines that differencing deletes, where there are any."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1), "/+$", "")
    slim = pages.select(F.col(h).alias("h"), F.col(g).alias("g"), html, host(F.col(url)).alias("host"), path.alias("path")).where("host <> ''")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [lines(x) for x in batch[html].to_pylist()]
            hashes = [[_hash(line) for line, _ in found] for found in every]
            sizes = [[len(line) for line, _ in found] for found in every]
            open_ = [any(zone == 1 for _, zone in found) for found in every]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]
            yield pa.record_batch(
                [*[batch[c] for c in ("h", "g", "host", "path")], *map(pa.array, (hashes, sizes, open_), kinds)],
                names=["h", "g", "host", "path", "lines", "sizes", "open"],
            )

    schema = "h long, g long, host string, path string, lines array<bigint>, sizes array<int>, open boolean"
    ordered = _in_order(cut(slim.mapInArrow(hashed, schema).dropDuplicates(["h", "g"]), "lines"))
    page = F.struct("host", F.split("path", "/").alias("steps"), "lines", "sizes")
    offered = ordered.select(page.alias("other"), F.explode(F.array(F.struct((F.col("at") + 1).alias("at"), F.lit(0).alias("side")), F.struct((F.col("at") - 1).alias("at"), F.lit(1).alias("side")))).alias("x"))
    offered = offered.select("other", "x.at", "x.side")
    steps = F.split("path", "/")
    together = F.expr("size(filter(sequence(1, least(size(steps), size(other.steps))), i -> slice(steps, 1, i) = slice(other.steps, 1, i)))")
    asked = ordered.where("open").withColumn("steps", steps)
    pairs = (
        asked.join(offered, "at").where("host = other.host and lines <> other.lines")
        .groupBy("h", "g", "lines", "sizes")
        .agg(F.array_sort(F.collect_list(F.struct((-together).alias("apart"), "side", F.col("other.lines").alias("lines"), F.col("other.sizes").alias("sizes")))).alias("others"))
    )  # two others at most

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["lines"].to_pylist(), batch["sizes"].to_pylist(), batch["others"].to_pylist())
            found = [shared_lines((a, b), [(x["lines"], x["sizes"]) for x in others]) for a, b, others in rows]
            yield pa.record_batch([batch["h"], batch["g"], pa.array(found, pa.list_(pa.int32()))], names=["h", "g", "shared"])

    return pairs.mapInArrow(align, "h long, g long, shared array<int>").where("size(shared) > 0")


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """All columns of pages but html, and text, n_chars (its code points).

    A null or empty page has an empty text. A page without a URL, or alone on its host, is compared with none. Repeated
    rows stay; existing columns text and n_chars are replaced, others of any name stay.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    h, g, gone = (unused(c, pages) for c in ("_h", "_g", "_gone"))
    pages = pages.select(*kept).withColumns({h: F.xxhash64(*[F.col(c) for c in (url, html)]), g: F.xxhash64(F.lit(1), *[F.col(c) for c in (html, url)])})
    shared = cut(_shared(pages, html, h, g, url), "shared").select(F.col("h").alias(h), F.col("g").alias(g), F.col("shared").alias(gone))
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    names = [c for c in kept if c != html]
    schema = StructType([pages.schema[c] for c in names]).add("text", StringType()).add("n_chars", LongType())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, some in zip(batch[html].to_pylist(), batch[gone].to_pylist()):
                drop = set(some or ())
                texts.append(" ".join(line for k, (line, zone) in enumerate(lines(source)) if zone == 2 or (zone == 1 and k not in drop)))
            columns = [batch[c] for c in names]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.join(shared, [h, g], "left").drop(h, g).mapInArrow(clean, schema)
