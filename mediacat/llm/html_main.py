"""The main text of web pages, by templates deduced from pages of the same host.

A page is read as a stream of tags and text blocks. Its tokens are the paths of its containers (tag and first class from
the body down) and its text blocks; each has an occurrence vector: how often it occurs in which page of the host.

1. *Equivalence classes.* Tokens of a host with equal vectors form a class; vectors are compared by sums of hashes of
   (page, count), so that they are never gathered. A class of containers is valid if it occurs in a fifth of the host's
   pages, one of text blocks if in half of them. Pages without text count for nothing. (A container stands for its two tags and a block for its words, so that each class
   has the two tokens that a class needs.)
2. *Nesting.* Containers of valid classes that occur equally often in each of their pages, and hold most of the free text
   of those pages, are slots. Slots nest by their paths. Of slots in each other one is a main slot: an article before
   others, one that occurs once before one that repeats, the deepest. Slots beside each other, as of two layouts, are all
   main slots; the body only if there is no other.
3. *Own text.* Blocks of valid classes, however often they occur in a page, are the template's own text if more than two
   pages have them.
4. *Extraction.* From each page the blocks of the main slots are taken, in page order, with all that is nested in them,
   but those in elements for menus, headers, footers, sidebars, notices, adverts, forms and comments. Names tell such
   elements only as a whole, and within an article only adverts, forms and comments; an article's own header is part of
   it, and names never leave a page with an article empty. The template's own text is left out unless it is in an
   article, or nothing else would remain. A page without a main slot gives its articles, or else its body.

Character references are decoded, white space becomes one space, blocks are joined by line feeds.

Scripts, styles and their like end at their closing tag, or with the page. Other elements whose content is left out, as
buttons and objects, hold what lies up to their own closing tag; where that is missing (their parent ends, or an article
or main element begins before it), they hold what lies up to the next block.

Rows: null html is empty and gives an empty text; a null url is a host of its own; rows that repeat are extracted alike;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import materialize

#: The share of its pages' free text that a slot holds, and of a host's pages that a valid class of containers and of text occurs in.
MAIN_SHARE, SLOT_SHARE, VALID_SHARE = 0.6, 0.2, 0.5
#: Templates of at most so many bytes in all are broadcast.
BROADCAST_BYTES = 16 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Elements that hold text alone, up to their closing tag; then elements that hold markup and are left out.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
_SKIPPED = frozenset("noscript template svg select math object button datalist audio video canvas".split())
#: Those that no start tag of their kind can be within, and those that articles can be within.
_NEVER_NESTED, _MAY_HOLD_ARTICLES = frozenset(("button", "select", "noscript")), frozenset(("noscript", "template"))
_CONTAINERS = frozenset("body div section article main nav header footer aside form table tbody thead tr td ul ol dl figure center fieldset dialog menu details".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address figcaption th caption summary option legend head html".split())
_VOID = frozenset("hr br img input meta link".split())
_LEFT_OUT = frozenset("nav header footer aside form dialog menu fieldset".split())
#: Of these an article or main element within is taken for one that follows, the closing tag being lost.
_NEVER_HOLD_ARTICLES = frozenset("nav header form menu fieldset".split())
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Words that name what is no part of an article, and those that say nothing about it. A name counts only as a whole: each of
#: its parts is one of these words, at least one of the former kind (``cookie-notice``, but not ``related-work``).
_WITHIN_ARTICLES = frozenset(
    "ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion comment comments reply replies respond disqus discussion "
    "newsletter subscribe subscription signup login share sharing shares".split()
)
_AROUND_ARTICLES = _WITHIN_ARTICLES | frozenset(
    "banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead "
    "header topbar toolbar social related recommended recommendations search skip toc complementary contentinfo".split()
)
_OF_ARTICLES = frozenset("comment comments reply replies teaser teasers related ad ads advert adverts advertisement promo sponsored".split())
_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons card cards center container content footer form global group header holder icons in inner item items left link links list main media message outer "
    "page panel post posts primary right row secondary section site slot small space span text thread top unit up user wrap wrapper zone reader".split()
)


def _names(attributes: str) -> list[str]:
    """The class, id and role names of a tag."""
    return " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).split() if "=" in attributes else []


def named_by(names: list[str], words: frozenset) -> bool:
    for name in names:
        parts = [x for x in re.split(r"[-_]+|\d+", name.lower()) if x]
        if any(x in words for x in parts) and all(x in words or x in _NEUTRAL for x in parts):
            return True
    return False


class Block:
    """``out`` is why a block is left out: the tag, ``name``, ``hidden`` or nothing."""

    __slots__ = ("path", "text", "out", "article")

    def __init__(self, path: str, text: str, out: str, article: bool):
        self.path, self.text, self.out, self.article = path, text, out, article


def _tags(page: str) -> list[tuple[int, int, str, str, str]]:
    """Tags and comments in order: start, end, slash of a closing tag, name, attributes; raw elements are one, up to their end."""
    tags, found = [], _TAG.search(page)
    while found:
        at, tag = found.end(), (found[2] or "").lower()
        if tag in _RAW and not found[1] and not found[3].endswith("/"):
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
        tags.append((found.start(), at, found[1] or "", tag, found[3] or ""))
        found = _TAG.search(page, at)
    return tags


def _closed(tags: list[tuple[int, int, str, str, str]]) -> dict[int, int]:
    """For each skipped element that is closed within its parent: the places of its tags."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    count: dict[str, int] = defaultdict(int)
    skipped: list[int] = []  # places in opened

    def pop_to(size: int) -> None:
        for tag, _ in opened[size:]:
            count[tag] -= 1
        del opened[size:]
        while skipped and skipped[-1] >= size:
            skipped.pop()

    for k, (_, _, closing, tag, attributes) in enumerate(tags):
        if tag not in _BLOCKS and tag not in _SKIPPED or tag in _VOID:
            continue
        if closing:
            if count[tag]:
                i = len(opened) - 1
                while opened[i][0] != tag:
                    i -= 1
                if tag in _SKIPPED:
                    ends[opened[i][1]] = k
                pop_to(i)
            continue
        if tag in ("article", "main", "body"):
            for j, i in enumerate(skipped):
                if opened[i][0] not in _MAY_HOLD_ARTICLES:
                    pop_to(skipped[j])
                    break
        elif tag in _SKIPPED:
            if attributes.endswith("/"):
                continue
            if tag in _NEVER_NESTED and count[tag]:
                pop_to(next(i for i in skipped if opened[i][0] == tag))
            skipped.append(len(opened))
        opened.append((tag, k))
        count[tag] += 1
    return ends


def read_page(page: str) -> list[Block]:
    """The text blocks of a page in order, each with the path of its container."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, str, bool]] = []  # tag, path, why it is left out, in an article
    parts: list[str] = []
    own_out = ""  # why the block that is open, and is no container, is left out

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, path, out, article = stack[-1] if stack else ("", "", "", False)
            blocks.append(Block(path, text, out or own_out, article))

    def why_left_out(tag: str, names: list[str], attributes: str, article: bool) -> str:
        if tag in _LEFT_OUT and not (tag == "header" and article):  # an article's own header holds its title and lead
            return tag
        words = _OF_ARTICLES if tag in ("article", "main") else _WITHIN_ARTICLES if article else _AROUND_ARTICLES
        if names and tag != "body" and named_by(names, words):
            return "name"
        return "hidden" if attributes and tag not in ("article", "main") and _HIDDEN.search(attributes) else ""

    tags = _tags(page)
    ends = _closed(tags) if any(x[3] in _SKIPPED for x in tags) else {}
    at, k, unclosed = 0, 0, ""  # the skipped element that is open and never closed
    while k < len(tags):
        start, end, closing, tag, attributes = tags[k]
        if not unclosed:
            parts.append(page[at:start])
        at = end
        if tag == "br":
            parts.append(" ")
        elif tag in _SKIPPED:
            if closing:
                unclosed = "" if unclosed == tag else unclosed
            elif k in ends:
                k = ends[k]
                at = tags[k][1]
            elif not attributes.endswith("/"):
                unclosed = tag
        elif tag in _BLOCKS:
            flush()
            own_out = unclosed = ""
            if tag in _CONTAINERS and closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag in _CONTAINERS:
                _, path, out, article = stack[-1] if stack else ("", "", "", False)
                own = tag in ("article", "main")
                names = _names(attributes)
                kept_out = "" if own and out in _NEVER_HOLD_ARTICLES else out
                stack.append((tag, f"{path}>{tag}" + (f".{names[0]}" if names else ""), kept_out or why_left_out(tag, names, attributes, article), article or own))
            elif not closing and attributes:
                own_out = why_left_out(tag, _names(attributes), attributes, bool(stack) and stack[-1][3])
        k += 1
    if not unclosed:
        parts.append(page[at:])
    flush()
    return blocks


def text_token(block: Block) -> str:
    return f"{block.path}\n{zlib.crc32(block.text.encode('utf-8', 'replace')):08x}{len(block.text)}"


def _containers(path: str) -> list[str]:
    steps = path.split(">")
    return [">".join(steps[:i]) for i in range(2, len(steps) + 1)]


TOKENS = "host string, token string, is_text boolean, pages long, occurrences long, vector long, chars long, page_chars long, least long, most long"


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence vectors, summed over the pages of a batch; the empty token occurs once in each page that has text."""
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page_key", "html")), strict=True):
            blocks = read_page(page or "")
            if not blocks:
                continue
            count: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            count["", False] = [1, sum(len(x.text) for x in blocks if not x.out)]
            seen: list[str] = []
            for block in blocks:
                inside = _containers(block.path)
                for path in inside:
                    if path not in seen:
                        count[path, False][0] += 1
                    if not block.out:
                        count[path, False][1] += len(block.text)
                seen = inside
                count[text_token(block), True][0] += 1
            for token, (n, chars) in count.items():
                s = sums.setdefault((host, *token), [0, 0, 0, 0, 0, n, n])
                s[0] += 1
                s[1] += n
                s[2] += zlib.crc32(f"{key} {n}".encode())
                s[3] += chars
                s[4] += count["", False][1]
                s[5], s[6] = min(s[5], n), max(s[6], n)
        rows = [(*k, *v) for k, v in sums.items()]
        types = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in TOKENS.split(", ")])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def classes(pages: DataFrame) -> DataFrame:
    """Valid classes of each host: host, tokens (token, is_text, chars), pages, occurrences, page_chars, least and most (a page's occurrences), host_pages."""
    read = pages.select(host(F.col("url")).alias("host"), F.xxhash64(F.col("page_id"), F.col("url")).alias("page_key"), F.col("html").cast("string").alias("html"))
    total = lambda c: F.sum(c).alias(c)
    tokens = read.mapInArrow(_page_tokens, TOKENS).groupBy("host", "token", "is_text").agg(*map(total, ("pages", "occurrences", "vector", "chars", "page_chars")), F.min("least").alias("least"), F.max("most").alias("most"))
    is_page = (F.col("token") == "") & ~F.col("is_text")
    grouped = tokens.groupBy("host", "pages", "occurrences", "vector", "page_chars", "least", "most").agg(F.max(F.when(is_page, F.col("chars"))).alias("host_chars"), F.collect_list(F.struct("token", "is_text", "chars")).alias("tokens"))
    whole = grouped.where("host_chars is not null").select("host", F.col("pages").alias("host_pages"))
    return grouped.join(whole, "host").where(F.col("pages") >= SLOT_SHARE * F.col("host_pages")).drop("vector", "host_chars")


def templates(pages: DataFrame) -> DataFrame:
    """Per host: main (the path of the first main slot), slots (of all), own_text (tokens of the template's own blocks)."""
    steps = lambda x: F.size(F.split(x["token"], ">"))
    is_article = lambda x: x["token"].rlike(r">(article|main)(\.[^>]*)?$").cast("int")
    holds = lambda x: ~x["is_text"] & (x["token"] != "") & (x["chars"] > 0) & (x["chars"] >= MAIN_SHARE * F.col("page_chars")) & (F.col("least") == F.col("most"))
    once = lambda x: ((F.col("most") == 1) & (steps(x) > 2)).cast("int")
    slot = lambda x: F.struct(is_article(x).alias("article"), once(x).alias("once"), steps(x).alias("depth"), x["token"].alias("path"))
    found = classes(pages).select(
        "host",
        F.transform(F.filter("tokens", holds), slot).alias("slots"),
        F.transform(F.filter("tokens", lambda x: x["is_text"] & (F.col("pages") > 2) & (F.col("pages") >= VALID_SHARE * F.col("host_pages"))), lambda x: x["token"]).alias("own_text"),
    )
    gathered = found.groupBy("host").agg(F.flatten(F.collect_list("slots")).alias("slots"), F.array_sort(F.flatten(F.collect_list("own_text"))).alias("own_text"))
    rank = lambda x: F.struct(x["article"], x["once"], x["depth"])
    nested = lambda x, y: x["path"].startswith(F.concat(y["path"], F.lit(">"))) | y["path"].startswith(F.concat(x["path"], F.lit(">")))
    best = F.filter("slots", lambda x: ~F.exists("slots", lambda y: nested(x, y) & (rank(y) > rank(x))))
    paths = F.transform(F.sort_array(best, asc=False), lambda x: x["path"])
    return gathered.select("host", F.get(paths, 0).alias("main"), paths.alias("slots"), "own_text")


def main_text(page: str, slots: list[str], own_text: frozenset) -> str:
    """The blocks of the main slots, or else of articles, or else of the body.

    If names leave nothing, those within articles do not count.
    """
    read = read_page(page)
    blocks = [x for x in read if not x.out] or [x for x in read if x.article and x.out == "name"]
    below = tuple(x + ">" for x in slots)
    within = [x for x in blocks if x.path in slots or x.path.startswith(below)]
    kept = within or [x for x in blocks if x.article] or [x for x in blocks if x.path.startswith(">body")] or blocks
    free = [x for x in kept if x.article or text_token(x) not in own_text]
    return "\n".join(x.text for x in free or kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, slots, owns = (batch.column(c).to_pylist() for c in ("html", "slots", "own_text"))
        texts = [main_text(p or "", s or [], frozenset(o or ())) for p, s, o in zip(pages, slots, owns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    found = materialize(templates(pages), "templates")
    texts = F.aggregate(F.concat("slots", "own_text"), F.lit(0), lambda n, x: n + F.octet_length(x))
    size = found.agg(F.sum(F.octet_length("host") + texts)).first()[0] or 0
    # Few templates go to all tasks, and pages stay where they are; many are joined by host.
    met = read.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("page_id", "url", "html", "slots", "own_text")
    return met.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
