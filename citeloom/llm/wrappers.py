"""Main text of web pages by wrappers: union-free regular expressions inferred by aligning the pages of a host."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import bounded_batches, materialize, table
from citeloom.shipping import ship_package

#: Elements deeper than this do not extend a path, but for boilerplate, which is told apart at any depth; their text stays.
MAX_DEPTH = 100
#: A slot with one and the same text on this many pages of differing main texts, and on this share of the host's, is template.
CONSTANT_PAGES, CONSTANT_SHARE = 2, 0.9
#: On a host of this many pages, a class, id or container on one page only, or on fewer than one in a hundred, is the page's own.
MANY_PAGES = 2
#: Articles are teasers beside a container that holds so many times their text.
OUTWEIGHS = 3
#: Rows, or items of wrappers, that a task holds before it passes them on.
HELD, HELD_ITEMS = 100_000, 20_000
#: A table of what is known of the hosts is broadcast up to this many bytes.
BROADCAST_BYTES = 16 << 20
#: Partial wrappers of a host are merged in this many groups before they meet.
SALTS = 32

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas are text of the block that they stand in.
INLINE |= frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object textarea select title xmp canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
BOILERPLATE_TAGS = frozenset("head nav footer aside form button menu dialog address".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promotion recommended related replies reply "
    "search sharing sidebar signup sponsor sponsored subscribe subscription toolbar widget".split()
)
#: What may stand beside them in a name of several parts (site-footer, related-posts).
PLAIN_PARTS = frozenset("0 area bar block body bottom box button buttons container form global inner item items left link links list main outer page popup post posts article articles right secondary site slot top unit wrap wrapper".split())
#: Comments may be articles of their own inside the article.
COMMENTS = frozenset("comment comments reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MAIN_WORDS = frozenset("articlebody article-body article_body entry-content post-content post-body main-content story-body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def head_of(name: str, attributes: str) -> str:
    """The token of an element: its name and what class, id, role and itemprop say."""
    if not attributes or "=" not in attributes:
        return name
    said = names_in(attributes)
    return f"{name}[{' '.join(sorted(said))}]" if said else name


def names_in(attributes: str) -> set[str]:
    said = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower().split()
        said.update(f"{m[1].lower()[0]}={re.sub(r'[0-9]+', '0', v).replace('/', '_')}" for v in value)
    return said


def parse(html: str) -> list:
    """The block tree of a page: [head, kids], a kid being such a node or a text (text, characters in links)."""
    root = ["", []]
    stack, text, links, in_link, at = [root], [], 0, 0, 0
    deep: list[tuple[str, bool]] = []  # open elements below MAX_DEPTH, and whether they are on the stack
    extra: Counter[str] = Counter()  # their names
    low = None

    def flush() -> None:
        nonlocal links
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                stack[-1][1].append((said, min(links, len(said))))
            text.clear()
        links = 0

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if in_link:
                links += len(piece)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end = name.lower(), m[1] or m[4]
        if name in RAW:
            if end:
                continue
            if name not in VOID and not (m[3] or m[6] or "").endswith("/"):
                low = html.lower() if low is None else low
                low = low if len(low) == len(html) else html
                close = low.find(f"</{name}", at)
                stop = html.find(">", close) if close >= 0 else -1
                at = stop + 1 if stop >= 0 else len(html) if name in ("script", "style") or close >= 0 else at
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if end else 1
            elif name == "br":
                text.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if end:
            if extra[name]:
                last = None
                while last != name:
                    last, marked = deep.pop()
                    extra[last] -= 1
                    if marked:
                        stack.pop()
                continue
            for i in range(min(len(stack) - 1, MAX_DEPTH), 0, -1):
                if stack[i][0].partition("[")[0] == name:
                    del stack[i:]
                    deep.clear()
                    extra.clear()
                    break
            continue
        in_link = 0
        if deep:
            pass
        elif name in CLOSES_P and len(stack) > 1 and stack[-1][0].partition("[")[0] == "p":
            stack.pop()
        elif name in IMPLIED:
            closed, scope = IMPLIED[name]
            for i in range(len(stack) - 1, 0, -1):
                tag = stack[i][0].partition("[")[0]
                if tag in scope:
                    break
                if tag in closed and not any(stack[j][0].partition("[")[0] in closed for j in range(1, i) if stack[j][0].partition("[")[0] not in scope and all(stack[k][0].partition("[")[0] not in scope for k in range(j, i))):
                    del stack[i:]
                    break
        head = head_of(name, m[3] if m[2] else m[6])
        if len(stack) > MAX_DEPTH:
            marked = not any(hidden for _, hidden in deep[-1:]) and is_boilerplate(head, any(is_main(x[0]) for x in stack[1 : MAX_DEPTH + 1]))
            deep.append((name, marked))
            extra[name] += 1
            if not marked:
                continue
        node = [head, []]
        stack[-1][1].append(node)
        stack.append(node)
    if at < len(html):
        text.append(html[at:].partition("<")[0] if re.match(r"[^<]*<[/a-zA-Z!]", html[at:]) else html[at:])
    flush()
    return root


# An item of a wrapper is [head, flags, pages, kids]. A slot has the head "#", and for kids [characters, characters in links,
# hash of the text (None if it differs)]; a repeated group has the head "(", and its members for kids. Flags: 1 optional, 2 repeated. On each level a head occurs once, so a chain of heads names a slot.
SLOT, GROUP, OPTIONAL, REPEATED = "#", "(", 1, 2


def wrapper_of(tree: list) -> list:
    """The wrapper of one page."""
    out: list = []
    where: dict[str, int] = {}
    for kid in tree[1]:
        if isinstance(kid, tuple):
            item = [SLOT, 0, 1, [len(kid[0]), kid[1], _hash(kid[0])]]
        else:
            item = wrapper_of(kid)
        at = where.get(item[0])
        if at is None:
            where[item[0]] = len(out)
            out.append(item)
            continue
        if at < len(out) - 1:  # it recurs after others: all since then are a repeated group
            out = grouped(out, at, len(out) - 1)
            where.update((h, at) for h in _heads(out[at]))
        out[at] = merge(out[at], item, True)
        out[at][1] |= REPEATED
    return [tree[0], 0, 1, out]


def _heads(item: list) -> list[str]:
    return [k[0] for k in item[3]] if item[0] == GROUP else [item[0]]


def grouped(items: list, first: int, last: int) -> list:
    """``items`` with those from ``first`` to ``last`` as one repeated group of optional members."""
    members = [k for x in items[first : last + 1] for k in (x[3] if x[0] == GROUP else [x])]
    return [*items[:first], [GROUP, REPEATED, max(k[2] for k in members), [[k[0], k[1] | OPTIONAL, *k[2:]] for k in members]], *items[last + 1 :]]


def merge(a: list, b: list, same_page: bool = False) -> list:
    """One item for what two items accept that have a head in common."""
    pages = max(a[2], b[2]) if same_page else a[2] + b[2]
    if GROUP in (a[0], b[0]):
        members = {k[0]: [k[0], k[1] | OPTIONAL, *k[2:]] for k in (a[3] if a[0] == GROUP else [a])}
        for k in b[3] if b[0] == GROUP else [b]:
            members[k[0]] = merge(members[k[0]], k, same_page) if k[0] in members else [k[0], k[1] | OPTIONAL, *k[2:]]
        return [GROUP, REPEATED, pages, list(members.values())]
    if a[0] == SLOT:
        (n, k, c), (o, j, d) = a[3], b[3]
        return [SLOT, a[1] | b[1], pages, [n + o, k + j, c if c == d else None]]
    return [a[0], a[1] | b[1], pages, align(a[3], b[3], same_page)]


def align(x: list, y: list, same_page: bool = False) -> list:
    """Two levels as one that accepts both.

    Items with the same head are matched and merged; those that only one side
    has become optional; where matches cross, or a group meets several items,
    all between them become one repeated group. Space is linear in the items.
    """
    if [k[0] for k in x] == [k[0] for k in y] and not any(k[0] == GROUP for k in x):
        return [merge(a, b, same_page) for a, b in zip(x, y, strict=True)]
    while True:
        at = {h: j for j, item in enumerate(y) for h in _heads(item)}
        met = [sorted({at[h] for h in _heads(item) if h in at}) for item in x]
        wide = next((m for m in met if len(m) > 1), None)
        if wide:
            y = grouped(y, wide[0], wide[-1])
            continue
        pairs = [(i, m[0]) for i, m in enumerate(met) if m]
        crossed = next(((a, b) for a, b in zip(pairs, pairs[1:], strict=False) if b[1] <= a[1]), None)
        if not crossed:
            break
        (i, j), (k, l) = crossed
        x = grouped(x, i, k)
        y = grouped(y, l, j) if l < j else y
    out, i, j = [], 0, 0
    for k, l in [*pairs, (len(x), len(y))]:
        out += [[z[0], z[1] | OPTIONAL, *z[2:]] for z in (*x[i:k], *y[j:l])]
        if k < len(x):
            out.append(merge(x[k], y[l], same_page))
        i, j = k + 1, l + 1
    return out


def expression(item: list) -> str:
    """The wrapper as a regular expression: elements, #-slots, groups, and ? + * behind them."""
    mark = ("", "?", "+", "*")[item[1]]
    if item[0] == SLOT:
        return SLOT + mark
    inside = " ".join(map(expression, item[3]))
    return f"({inside}){mark}" if item[0] == GROUP else f"<{item[0]}>{{{inside}}}{mark}" if item[0] else inside


def slots(item: list, path: str = "/", container: str = "/") -> Iterator[tuple]:
    """(path, container, pages, flags, characters, in links, hash) of each slot, by the chain of heads that leads to it."""
    for kid in item[3]:
        if kid[0] == SLOT:
            yield (path, container, kid[2], kid[1], *kid[3])
        elif kid[0] == GROUP:
            yield from slots(kid, path, container)
        else:
            yield from slots(kid, f"{path}{kid[0]}/", path)


@lru_cache(1 << 16)
def is_boilerplate(head: str, inside_main: bool) -> bool:
    """Whether an element says that it holds menus, forms, comments and the like.

    A class or id says so as a whole: it is such a word, or all its parts are
    such words and PLAIN_PARTS (has-sidebar or legal-news are neither). Words
    do not count on html, body and elements that is_main accepts.
    """
    name, _, said = head.partition("[")
    if name in ("html", "body"):
        return False
    if name in BOILERPLATE_TAGS and not (name == "address" and inside_main) or name == "header" and not inside_main:
        return True
    main = is_main(head)
    for s in said.rstrip("]").split():
        kind, _, value = s.partition("=")
        if kind == "r" and value in ROLES:
            return True
        if kind in "ci" and (inside_main and value in COMMENTS if main else _is_word(value)):
            return True
    return False


def _is_word(value: str) -> bool:
    parts = {p for p in re.split(r"[-_]+", value) if p}
    return value in BOILERPLATE_WORDS or bool(parts & BOILERPLATE_WORDS) and parts <= BOILERPLATE_WORDS | PLAIN_PARTS


def is_main(head: str) -> bool:
    name, _, said = head.partition("[")
    return name in ("article", "main") or any(s == "r=main" or s[2:] in MAIN_WORDS for s in said.rstrip("]").split())


class Block(NamedTuple):
    text: str
    links: int
    path: str
    container: str


def outline(html: str, common: frozenset[str]) -> tuple[bool, list[Block], list]:
    """Whether the main text of a page is in article or main elements; its blocks outside boilerplate; the tree they are in.

    If so, all blocks in such elements are returned, and no others. It is not
    where a container outside them holds OUTWEIGHS times their text, as
    teasers may be articles too. Paths and the tree spell the classes and ids in
    ``common``.
    """
    inside: list[Block] = []
    others: list[Block] = []
    order: dict[int, int] = {}
    heads: dict[str, str] = {}

    def visit(node: list, path: str, container: str, main: bool) -> list:
        kids: list = []
        for kid in node[1]:
            if isinstance(kid, tuple):
                (inside if main else others).append(block := Block(*kid, path, container))
                order[id(block)] = len(order)
                kids.append(kid)
            elif not is_boilerplate(kid[0], main):
                if kid[0] not in heads:
                    name, _, said = kid[0].partition("[")
                    kept = [x for x in said[:-1].split() if x in common]
                    heads[kid[0]] = f"{name}[{' '.join(kept)}]" if kept else name
                kids.append([heads[kid[0]], visit(kid, f"{path}{heads[kid[0]]}/", path, main or is_main(kid[0]))])
        return kids

    tree = ["", visit(parse(html), "/", "/", False)]
    if inside and others:
        outside: Counter[str] = Counter()
        for b in others:
            outside[b.container] += len(b.text) - 2 * b.links
        if max(outside.values()) > OUTWEIGHS * sum(len(b.text) for b in inside):
            return False, sorted(inside + others, key=lambda b: order[id(b)]), tree
    return bool(inside), inside or others, tree


def chosen(in_main: bool, page: list[Block], textual: frozenset[str] = frozenset(), template: frozenset[str] = frozenset()) -> list[Block]:
    """The main text among the blocks of a page.

    All of article and main elements. On pages without them the wrapper of the
    host decides: its template slots are left out; of the others, the
    containers count that hold more text than links, here or on the host
    (``textual``), and all within the heaviest one; all blocks if there is none.
    """
    if in_main:
        return page
    page = [b for b in page if b.path not in template]
    weight: Counter[str] = Counter()
    rest: Counter[str] = Counter(dict.fromkeys((b.container for b in page), 0))
    for b in page:
        weight[b.container] += max(len(b.text) - 2 * b.links, 0)
        rest[b.container] += len(b.text) - 2 * b.links
    top = max(sorted(weight), key=weight.__getitem__, default="/")
    kept = [b for b in page if rest[b.container] > 0 or b.container in textual or weight[top] > 0 and b.container.startswith(top)]
    return kept or page


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _known(sets: dict[str | None, frozenset[str]], said: str | None, by: str) -> frozenset[str]:
    if said not in sets:
        if len(sets) > 10_000:
            sets.clear()
        sets[said] = frozenset(said.split(by)) if said else frozenset()
    return sets[said]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], type=pa.string()), pa.array([k[1] for k in keys], type=pa.string()), pa.array([held[k] for k in keys], type=pa.int64())], names=["host", "name", "n"])

    held: Counter[tuple[str, str]] = Counter()
    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if text := html.as_py():
                held.update((host, x) for x in names_in(text))
                held[host, ""] += 1
                if len(held) > HELD:
                    yield rows()
                    held.clear()
    yield rows()


_WRAPPED = "host string, pages long, wrapper string"


def _wrapped(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=[x.split(" ")[0] for x in _WRAPPED.split(", ")])


def _size(item: list) -> int:
    return 1 + (0 if item[0] == SLOT else sum(map(_size, item[3])))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for the pages of a host that a task has seen: each page is aligned with it in turn.

    It is of the pages without article and main elements; the others are told by these.
    """

    def rows() -> pa.RecordBatch:
        return _wrapped([(h, n, json.dumps(w, separators=(",", ":"))) for h, (n, w) in held.items()])

    held: dict[str, tuple[int, list]] = {}
    items: Counter[str] = Counter()
    sets: dict[str | None, frozenset[str]] = {}
    for b in batches:
        for host, html, common in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            in_main, page, tree = outline(html.as_py() or "", _known(sets, common, " "))
            if in_main or not page:
                continue
            n, w = held.get(host, (0, None))
            own = wrapper_of(tree)
            w = own if w is None else merge(w, own)
            held[host] = n + 1, w
            items[host] = _size(w)
            if items.total() > HELD_ITEMS:
                yield rows()
                held.clear()
                items.clear()
    yield rows()


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = None
    for w in sorted(rows["wrapper"]):
        out = json.loads(w) if out is None else merge(out, json.loads(w))
    return pd.DataFrame({"host": [key[0]], "pages": [int(rows["pages"].sum())], "wrapper": [json.dumps(out, separators=(",", ":"))]})


_SLOTS = "host string, pages long, path string, container string, n long, flags long, chars long, links long, said long"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
    for b in batches:
        rows = [(host, pages, *s) for host, pages, w in zip(*[c.to_pylist() for c in b.columns], strict=True) for s in slots(json.loads(w))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=[x.split(" ")[0] for x in _SLOTS.split(", ")])


_STANDING = "host string, main_text long, slot int"


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main text of each page without article and main elements, by its hash, beside each of the listed slots that the page has, and beside -1."""

    def rows() -> pa.RecordBatch:
        columns = [[r[i] for r in held] for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["host", "main_text", "slot"])

    held: set[tuple[str, int, int]] = set()
    names: dict[str | None, frozenset[str]] = {}
    for b in batches:
        for host, html, common, constant in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            in_main, page, _ = outline(html.as_py() or "", _known(names, common, " "))
            if in_main or not page:
                continue
            main_text = _hash("\n".join(x.text for x in chosen(in_main, page)))
            here = {x.path for x in page}
            held.update((host, main_text, i) for i, path in enumerate(constant.split("\n")) if path in here)
            held.add((host, main_text, -1))
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str | None, frozenset[str]] = {}
    paths: dict[str | None, frozenset[str]] = {}
    for b in batches:
        texts = []
        for html, common, textual, template in zip(b.column(2), *(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            in_main, page, _ = outline(html.as_py() or "", _known(names, common, " "))
            texts.append("\n".join(x.text for x in chosen(in_main, page, _known(paths, textual, "\n"), _known(paths, template, "\n"))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _broadcast(df: DataFrame) -> DataFrame:
    """A broadcast hint if the strings of ``df`` (cheap to read) have at most BROADCAST_BYTES; else ``df``."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 for c, t in df.dtypes if t == "string"), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), "html")


def common_names(hosted: DataFrame) -> DataFrame:
    """(host, common): classes, ids, roles and itemprops that are not a single page's own, in one string."""
    counts = hosted.select("host", "html").mapInArrow(_names, "host string, name string, n long").groupBy("host", "name").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "names")
    pages = counts.where("name = ''").select("host", F.col("n").alias("pages"))
    shared = counts.where("name <> ''").join(_broadcast(pages), "host").where(_shared(F.col("n")))
    return shared.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("common"))


def _shared(n: Column) -> Column:
    return (F.col("pages") < MANY_PAGES) | (n >= F.greatest(F.lit(2), F.col("pages") / 100))


def infer_wrappers(hosted: DataFrame, common: DataFrame) -> DataFrame:
    """(host, pages, wrapper) of the pages without article and main elements; the wrapper is JSON that ``expression`` shows.

    Every task aligns its pages of a host, one after another; these partial
    wrappers are merged in SALTS groups and then together, so a hot host sends
    a row for each task, not its pages. A wrapper has an item for each chain
    of heads that is not a single page's own, which bounds it whatever the
    number of pages.
    """
    ship_package(hosted.sparkSession)
    bounded_batches(hosted.sparkSession)
    partial = hosted.join(_broadcast(common), "host", "left").select("host", "html", "common").mapInArrow(_partial, _WRAPPED)
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    once = salted.groupBy("host", "salt").applyInPandas(_merged, _WRAPPED)
    return once.groupBy("host").applyInPandas(_merged, _WRAPPED)


def template_slots(hosted: DataFrame, common: DataFrame, constant: DataFrame) -> DataFrame:
    """(host, path) of those ``constant`` slots (host, and paths in one string) that stand on nearly all of a host's differing main texts.

    All pages of these hosts are counted: each differing main text once (by a
    hash of 64 bits), and once for each slot that a page with this main text
    has. What is shuffled are such pairs, of pages without article and main
    elements on hosts that have constant slots.
    """
    listed = hosted.join(_broadcast(constant.join(common, "host", "left")), "host").select("host", "html", "common", "constant")
    counts = materialize(listed.mapInArrow(_standing, _STANDING).distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n")), "standing")
    differing = counts.where("slot < 0").select("host", F.col("n").alias("main_texts"))
    most = F.col("n") >= F.greatest(F.col("main_texts") * CONSTANT_SHARE, F.lit(CONSTANT_PAGES))
    paths = constant.select("host", F.posexplode(F.split("constant", "\n")).alias("slot", "path"))
    return counts.where("slot >= 0").join(differing, "host").where(most).join(paths, ["host", "slot"]).select("host", "path")


def layouts(hosted: DataFrame) -> DataFrame:
    """(host, common, textual, template): names that paths spell, containers with more text than links, template slots.

    They are read off the wrapper of the host. A slot is template if it has
    one text on pages of so many differing main texts that copies of a page
    do not make it so, and only beside a larger slot that varies; the
    differing main texts of hosts with constant slots are counted in a second
    look at all their pages. What comes out for a host is bounded, as is the
    wrapper.
    """
    common = materialize(common_names(hosted), "common")
    found = materialize(infer_wrappers(hosted, common).mapInArrow(_slots, _SLOTS), "slots")
    largest = found.groupBy("host").agg(F.max_by(F.col("said").isNotNull(), F.struct("chars", "path")).alias("fixed"))
    by_container = found.groupBy("host", F.col("container").alias("path")).agg(F.max("pages").alias("pages"), F.max("n").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    textual = by_container.where("chars > 2 * links").where(_shared(F.col("n"))).select("host", F.col("path").alias("textual"), F.lit(None).cast("string").alias("template"))
    constant = found.where(F.col("said").isNotNull() & (F.col("n") >= CONSTANT_PAGES)).join(largest, "host").where("NOT fixed")
    constant = materialize(constant.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("path")), "\n").alias("constant")), "constant")
    template = template_slots(hosted, common, constant).select("host", F.lit(None).cast("string").alias("textual"), F.col("path").alias("template"))
    chosen_paths = textual.union(template).groupBy("host").agg(*[F.array_join(F.array_sort(F.collect_set(c)), "\n").alias(c) for c in ("textual", "template")])
    return common.join(chosen_paths, "host", "full_outer")


def extract(pages: DataFrame, aligned: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Main text is what is inside the article and main elements of a page and
    not inside menus, headers, footers, sidebars, forms, notices, adverts or
    comments. On pages that have no such elements, or only teasers in them, the host's wrapper tells
    what the pages have in common and what varies: text that stands on nearly
    all differing pages is template and goes, containers that hold links
    rather than text on the host go, the rest is main text. Without
    ``aligned`` each such page is read by itself.

    Pages without a host (null or relative url) count as one host. A null or
    empty html gives an empty text and 0; a very long page is parsed once, in
    time and space linear in its length; of two containers of one weight the
    first by its path is the heaviest; repeated rows are each returned, and
    copies of a page count once for what is template; an empty table gives no
    rows; columns other than page_id, url and html, whatever their names, are
    not read.
    """
    ship_package(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    hosted = _hosted(pages)
    known = layouts(hosted) if aligned else hosted.select("host", *[F.lit(None).cast("string").alias(c) for c in ("common", "textual", "template")]).distinct()
    joined = hosted.join(_broadcast(materialize(known, "layouts")), "host", "left")
    return joined.select("page_id", "url", "html", "common", "textual", "template").mapInArrow(_read, "page_id long, url string, text string, n_chars long")


def op10_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
