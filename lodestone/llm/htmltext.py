"""Main text of web pages, by wrappers inferred from the pages of a host.

A wrapper is a union-free regular expression over tags: nested elements that are required, optional or repeated, with
constant text or text slots. It is inferred by aligning a host's pages one after another: an element that only one
side has becomes optional, neighbours with equal tags, or runs of unlike ones that follow each other again, become a
repeated group, unequal texts become a slot. Wrappers align with each other as pages do, so partitions infer their own
and these are merged, first by host and salt, then by host. From a host's wrapper follows its content region: the
elements that hold most of the text outside of links that varies from page to page; elements that a tag or name marks
as content say how far the region reaches, unless the wrapper has most of that text elsewhere. Pages are then read
against their host's wrapper: of the region's text, what stands in the same required element on all pages of a host of
SEVERAL or more is template and left out, whether the element is single or one of a repeated group.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shuffle_width, small, sub_batches

SALTS = 32
#: Elements below so many levels count as their text, but for the outermost that names mark as content.
DEPTH = 40
#: Hosts that a task keeps wrappers of before it hands them on.
HELD_HOSTS = 4096
#: Unlike elements that a repeated group has at most.
GROUP = 4
#: Pages of a host from which on text that all have counts as its template's.
SEVERAL = 3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)
# HTML's element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label map mark object q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# What is no content, by tag, by role, and by the first or last word of a class or id.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg button select option textarea title head menu input".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply respond share sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HOLDERS = {"header": "article", "footer": "blockquote"}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
CONTENT = ("article", "main", "content", "post", "entry", "story", "body")
_OPEN = re.compile(r"(?:^|\s)open(?=[\s=/]|$)", re.I)
_WORDS = re.compile(r"[^0-9a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _kind(tag: str, attributes: str, titled: bool = False) -> tuple[str, bool]:
    """(label, whether it is no content). The label is the tag, with class, id and role where it has them.

    titled: this is an article's own header, which holds its title, or a quotation's footer, which says whose it is.
    """
    if not attributes or attributes.isspace():
        return tag, (tag in DROPPED or tag == "dialog") and not titled
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    # a name is about its ends: `comment-list` and `site-header`, but not `story-comments-policy`, is no content
    names = [[w.lower() for w in _WORDS.split(x) if w] for k in ("class", "id", "role") for x in found.get(k, "").split()]
    words = {w for x in names for w in x}
    named = any(x and (x[0] in NOISE or x[-1] in NOISE) for x in names) and not titled or found.get("role", "").strip().lower() in ROLES
    closed = tag == "dialog" and not _OPEN.search(attributes)
    noise = tag in DROPPED and not titled or closed or named and tag not in ("body", "html", "article", "main") or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    # numbers in names tell pages apart, not parts of a page
    return tag + "".join(f".{w}" for w in sorted(words) if not w.isdigit()), noise


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """('open', label, noise), ('close', label, noise), ('text', decoded text, within a link), ('break', '', False).

    Tags that are missing at the end of an element are supplied, stray ends are passed over. Inline elements that
    aren't noise give no event but for br, which is white space.
    """
    stack: list[tuple[str, str, bool]] = []
    at, n, links = 0, len(page), 0

    def pop(to: int) -> Iterator[tuple[str, str, bool]]:
        nonlocal links
        while len(stack) > to:
            tag, label, noise = stack.pop()
            links -= tag == "a"
            if label:
                yield "close", label, noise

    def top(names: set[str], stop: set[str]) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                return None
        return None

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", html.unescape(page[at:]), links > 0
            break
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), links > 0
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag or not (m[4] or m[7]):
            continue  # a comment or declaration, or a tag that the page's end cuts off
        if m[1] or m[5]:
            i = top({tag}, {"html"} if tag != "p" else {"html", "table"})
            if i is not None:
                yield from pop(i)
            continue
        if tag in ENDS_P and (i := top({"p"}, {"table", "button", "article", "section", "div", "td", "li", "body"})) is not None:
            yield from pop(i)
        if tag in CLOSES and (i := top(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "body"})) is not None:
            yield from pop(i)
        label, noise = _kind(tag, m[3] or "", tag in HOLDERS and any(x[0] == HOLDERS[tag] for x in stack))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            yield "text", " ", False
        elif tag in VOID:
            if tag == "hr":
                yield "break", "", False
        elif tag in INLINE and not noise:
            stack.append((tag, "", False))
            links += tag == "a"
        else:
            yield "open", label, noise
            stack.append((tag, label, noise))
            links += tag == "a"
    yield from pop(0)


# ------------------------------------------------------------------ wrappers
# A node is [label, modifier, children, text, weight]: modifier "" (required), "?", "+" or "*"; text: its own constant
# text, "" for none, None for a slot; weight: characters outside of links seen in it, slots or constants. Then digests
# of the own texts that it has on all pages, pages (of the root), and whether pages differ in its own texts. A repeated
# group of unlike elements is a node without text whose label is those of its members in brackets.


def _digest(x: str) -> str:
    return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _names(label: str) -> list[str]:
    """Those of CONTENT that mark an element of this label."""
    if label.startswith("("):
        return []
    tag, *words = label.split(".")
    return [x for x in CONTENT if tag == x and x in ("article", "main") or tag not in ("html", "body") and x in words]


def page_wrapper(page: str) -> list:
    """The page itself as a wrapper: noise left out, repeats folded."""
    root = ["", "", [], "", 0, [], 1, 0]
    path, deep, skip = [root], 0, 0
    below = 0  # elements passed over above the outermost named one below DEPTH
    for what, x, flag in events(page):
        if what == "open":
            if skip or flag:
                skip += 1
            elif len(path) == DEPTH + 1 and not below and _names(x):
                below, deep = deep + 1, 0
                path.append([x, "", [], "", 0, [], 1, 0])
                path[-2][2].append(path[-1])
            elif len(path) > DEPTH:
                deep += 1
            else:
                path.append([x, "", [], "", 0, [], 1, 0])
                path[-2][2].append(path[-1])
        elif what == "close":
            if skip:
                skip -= 1
            elif deep:
                deep -= 1
            else:
                node = path.pop()
                if below and len(path) == DEPTH + 1:
                    deep, below = below - 1, 0
                node[2], node[5] = fold(node[2]), [_digest(node[3])] if node[3] else []
        elif what == "text" and not skip and (own := " ".join(x.split())):
            path[-1][3] = f"{path[-1][3]} {own}".strip()
            path[-1][4] += 0 if flag else len(own)
    for node in reversed(path):
        node[2], node[5] = fold(node[2]), [_digest(node[3])] if node[3] else []
    return _short(root)


def _short(node: list) -> list:
    """Long constants by their digest: whether two are equal is all that matters."""
    if node[3] and len(node[3]) > 24:
        node[3] = f"#{_digest(node[3])}"
    for c in node[2]:
        _short(c)
    return node


def _either(a: str, b: str) -> str:
    """The modifier that allows what either does."""
    return {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[(a in "?*" and a != "") or (b in "?*" and b != ""), a in ("+", "*") or b in ("+", "*")]


def merge(a: list, b: list, same: bool = False) -> list:
    """The wrapper of all that either describes; both have the same label. same: they are of one page."""
    x, y = set(a[5]), set(b[5])
    return [a[0], _either(a[1], b[1]), align(a[2], b[2], same), a[3] if a[3] == b[3] else None, a[4] + b[4], sorted(x | y if same else x & y), a[6] + b[6], int(a[7] or b[7] or not same and x != y)]


def fold(nodes: list) -> list:
    """Neighbours with one label become a repeated group, then runs of unlike elements that follow each other again."""
    out: list = []
    for x in nodes:
        if out and out[-1][0] == x[0]:
            m = merge(out[-1], x, True)
            m[1] = "+"
            out[-1] = m
        else:
            out.append(x)
    labels = [x[0] for x in out]
    runs = {}
    i = 0
    while i < len(out):
        k = next((k for k in range(2, GROUP + 1) if labels[i : i + k] == labels[i + k : i + 2 * k]), 0)
        if k:
            runs[f"({' '.join(labels[i : i + k])})"] = labels[i : i + k]
            while labels[i : i + k] == labels[i + k : i + 2 * k]:
                i += k
        i += max(k, 1)
    return gather(out, runs) if runs else out


def gather(nodes: list, runs: dict[str, list[str]]) -> list:
    """Puts the members of each of runs (label of a repeated group: labels of its members), where they follow each
    other, into the group; neighbours that are the same group become one."""
    out: list = []
    i = 0
    while i < len(nodes):
        x, step = nodes[i], 1
        for label, members in runs.items():
            if [m[0] for m in nodes[i : i + len(members)]] == members:
                x, step = [label, "+", nodes[i : i + len(members)], "", 0, [], 1, 0], len(members)
                break
        if x[0] in runs and out and out[-1][0] == x[0]:
            # what only some pages have doesn't make a text one of all pages
            whole = not any(m[1] in ("?", "*") for m in (out[-1], x, *out[-1][2], *x[2]))
            out[-1] = merge(out[-1], x, whole)
        else:
            out.append(x)
        i += step
    return out


def _optional(x: list) -> list:
    return [x[0], _either(x[1], "?"), *x[2:]]


def align(a: list, b: list, same: bool = False) -> list:
    """Aligns two sequences of elements by their longest common subsequence of labels; the rest is optional. What one
    side has as a repeated group of unlike elements, the other has as one too, be it once."""
    runs = {x[0]: [m[0] for m in x[2]] for x in a + b if x[0].startswith("(")}
    if runs:
        a, b = gather(a, runs), gather(b, runs)
    p, q = [x[0] for x in a], [x[0] for x in b]
    if p == q:
        return [merge(x, y, same) for x, y in zip(a, b, strict=True)]
    # equal ends needn't be searched for
    head = next(i for i in range(min(len(p), len(q)) + 1) if i in (len(p), len(q)) or p[i] != q[i])
    if head:
        return _folded([merge(x, y, same) for x, y in zip(a[:head], b[:head], strict=True)] + align(a[head:], b[head:], same), same)
    tail = next(i for i in range(min(len(p), len(q)) + 1) if i in (len(p), len(q)) or p[-1 - i] != q[-1 - i])
    if tail:
        ends = [merge(x, y, same) for x, y in zip(a[-tail:], b[-tail:], strict=True)]
        return _folded(align(a[:-tail], b[:-tail], same) + ends, same)
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if p[i] == q[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and p[i] == q[j]:
            out.append(merge(a[i], b[j], same))
            i, j = i + 1, j + 1
        elif j == len(q) or i < len(p) and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return _folded(out, same)


def _folded(nodes: list, same: bool) -> list:
    """Neighbours that alignment has put together become a repeated group."""
    folded: list = []
    for x in nodes:
        if folded and folded[-1][0] == x[0]:
            optional = folded[-1][1] in ("?", "*") and x[1] in ("?", "*")
            m = merge(folded[-1], x, same)
            m[1] = "*" if optional else "+"
            folded[-1] = m
        else:
            folded.append(x)
    return folded


def _weight(node: list) -> int:
    return (node[4] if node[3] is None else 0) + sum(map(_weight, node[2]))


def _heavy(wrapper: list) -> list[list]:
    """The path from the root to the smallest element with nine tenths of the varying text outside of links."""
    path, total = [wrapper], _weight(wrapper)
    while total:
        child = max(path[-1][2], key=_weight, default=None)
        if child is None or child[0].startswith("(") or child[0].split(".")[0] == "p" or _weight(child) * 10 < total * 9:
            break
        path.append(child)
    return path


def region(wrapper: list) -> list[str]:
    """The labels of the elements that hold the content.

    Where no element is named as content, or the named ones hold less than half of the varying text and none of them
    lies about or within the smallest element that has nine tenths of it, that element holds the content, together
    with the headings beside it and beside the elements about it that all pages have and that vary. Of several names,
    the first of CONTENT counts whose elements hold half or more of what those of any other name do. A single page,
    or copies of one, vary in nothing: there the first name counts.
    """
    found: dict[str, list[list]] = {}

    def walk(node: list, inside: set[str]) -> None:
        for name in _names(node[0]):
            if name not in inside:
                found.setdefault(name, []).append(node)
                inside = inside | {name}
        for c in node[2]:
            walk(c, inside)

    walk(wrapper, set())
    path, total = _heavy(wrapper), _weight(wrapper)
    heavy = path[-1]
    apart = heavy[0].split(".")[0] not in ("", "html", "body")
    if found:
        held = {name: sum(map(_weight, nodes)) for name, nodes in found.items()}
        best = next(x for x in CONTENT if x in held and 2 * held[x] >= max(held.values()))
        if not apart or 2 * held[best] >= total or _named(heavy):
            return sorted({x[0] for x in found[best]})
    if not apart:
        return []
    titles = {c[0] for node in path[:-1] for c in node[2] if c[0].split(".")[0] in ("h1", "h2") and c[3] is None and c[1] not in ("?", "*")}
    return sorted(titles | {heavy[0]})


def _named(node: list) -> bool:
    return bool(_names(node[0])) or any(map(_named, node[2]))


def template(wrapper: list, labels: list[str]) -> list[str]:
    """Digests of path and own text of what all pages have in elements that all have; none where the pages of a host
    are few, or don't differ within the region, as copies of one page."""
    out: set[str] = set()
    differ = False

    def walk(node: list, path: str, inside: bool) -> None:
        nonlocal differ
        inside = inside or node[0] in labels
        optional = node[1] in ("?", "*")
        differ |= inside and (optional or bool(node[7]))
        if not optional:
            out.update(_digest(path + t) for t in node[5])
            for c in node[2]:
                walk(c, path if c[0].startswith("(") else f"{path}{c[0]}/", inside)

    walk(wrapper, "/", not labels)
    return sorted(out) if differ and wrapper[6] >= SEVERAL else []


def main_text(page: str, labels: frozenset[str], constant: frozenset[str] = frozenset()) -> str:
    """Blocks within the elements so labelled (without any on the page: within the whole page), noise and the host's
    template text (see template) left out."""
    blocks: list[tuple[bool, str]] = []
    # elements as page_wrapper has them: path, own text, its blocks
    nodes: list[tuple[str, list[str], list[int]]] = [("/", [], [])]
    deep, dropped = 0, set()
    now: list[str] = []
    skip, inside, opened, seen = 0, 0, [], False

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            nodes[-1][2].append(len(blocks))
            blocks.append((inside > 0, text))

    def leave() -> None:
        path, own, mine = nodes.pop()
        if mine and _digest(path + _digest(" ".join(own))) in constant:
            dropped.update(mine)

    for what, x, noise in events(page):
        if what == "text":
            if not skip:
                now.append(x)
                if constant and (own := " ".join(x.split())):
                    nodes[-1][1].append(own)
            continue
        if skip:
            skip += (what == "open") - (what == "close")
            continue
        flush()
        if what == "open":
            if noise:
                skip = 1
            else:
                hit = x in labels
                seen |= hit
                inside += hit
                opened.append(hit)
                if constant and len(nodes) <= DEPTH:
                    nodes.append((f"{nodes[-1][0]}{x}/", [], []))
                else:
                    deep += 1
        elif what == "close" and opened:
            inside -= opened.pop()
            if deep:
                deep -= 1
            else:
                leave()
    flush()
    while nodes:
        leave()
    return "\n".join(t for i, (within, t) in enumerate(blocks) if (within or not seen) and i not in dropped)


# ------------------------------------------------------------------ distributed


def host_of(column: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[^:]*://([^/?#]*)", 1)), F.lit(""))


def _rows(held: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch({"host": pa.array(held, pa.string()), "wrapper": pa.array([json.dumps(w) for w in held.values()], pa.string())})


def _infer(batches):
    held: dict[str, list] = {}
    for batch in batches:
        for part in sub_batches(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                w = page_wrapper(page or "")
                held[host] = merge(held[host], w) if host in held else w
                if len(held) > HELD_HOSTS:
                    yield _rows(held)
                    held = {}
    yield _rows(held)


def _merge_sorted(batches):
    """Merges neighbours of one host; a task holds one wrapper at a time."""
    host, now = None, None
    for batch in batches:
        for h, w in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if h == host:
                now = merge(now, json.loads(w))
            else:
                if now is not None:
                    yield _rows({host: now})
                host, now = h, json.loads(w)
    if now is not None:
        yield _rows({host: now})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one row per host of pages (url, html), inferred from all its pages."""
    n = shuffle_width(pages.sparkSession)
    partial = pages.select(host_of().alias("host"), "html").mapInArrow(_infer, "host string, wrapper string")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    salted = salted.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_merge_sorted, "host string, wrapper string")
    return salted.repartition(n, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge_sorted, "host string, wrapper string")


def _regions(batches):
    for batch in batches:
        out = []
        for w in map(json.loads, batch.column("wrapper").to_pylist()):
            labels = region(w)
            out.append(json.dumps([labels, template(w, labels)]))
        yield pa.record_batch({"h": batch.column("host"), "region": pa.array(out, pa.string())})


def _extract(batches):
    known: dict[str, list[frozenset[str]]] = {}
    for batch in batches:
        for part in sub_batches(batch, "html"):
            texts = []
            for page, labels in zip(part.column("html").to_pylist(), part.column("region").to_pylist(), strict=True):
                if labels not in known:
                    known[labels] = [frozenset(x) for x in json.loads(labels)]
                texts.append(main_text(page or "", *known[labels]))
            yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages (page_id integer, url and html strings).

    Null html is empty, and a page without content has the empty text. Pages whose url is null or has no host share
    a wrapper. White space is what Unicode calls so, after decoding character references. Repeated rows get a row
    each; other columns are ignored; an empty table gives no rows.
    """
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    regions = cut(wrappers(thin).mapInArrow(_regions, "h string, region string"))
    size = regions.agg(F.coalesce(F.sum(F.length("h") + F.length("region") + 32), F.lit(0))).first()[0]
    both = thin.withColumn("host", host_of()).join(small(regions, 1, size), F.col("host") == F.col("h"))
    return both.select("page_id", "url", "html", "region").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
