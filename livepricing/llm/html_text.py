"""Main text of web pages by equivalence classes of their tokens: a nested template, and its slots.

1. Every page is cut into tokens: tags and text runs, each with its role (the path of containers
   it stands in). Per host, a token's occurrence vector says how often each page holds it; it is
   kept as a sum of hashes of (page content, count), so tokens with equal vectors meet in one
   group without any page list. Equal pages of a host count once.
2. Tokens with equal vectors form a class. A class is valid if it has ``min_size`` tokens and
   stands on ``min_pages`` pages and on ``support`` of the host's pages (several kinds of pages
   each have theirs; the share bounds a host's template by the size of its pages).
3. The containers of valid classes nest by their paths into a template; the blocks between their
   tags are its slots. From the page the template is descended into each container that holds
   ``share`` of the text around it, summed over the pages where it stands, and does not leave the
   main heading behind (text of links, and text that is the same on every page, has no mass).
   HTML's own elements are evidence: article and main elements weigh ``BELIEF`` times, named
   boilerplate a ``BELIEF``-th, navigation, footers and the like nothing. Names alone decide
   nothing here. The containers passed are the host's main containers; a page uses the deepest
   it has, the earlier of two.
4. A page's text is what stands in its main container, whatever that and its surroundings are
   called; articles in it (or the one around it) are preferred to the rest of it. Boilerplate
   elements and names inside still fall away, as do text runs of valid classes that stand on
   ``repeat`` of the host's pages, ten at least.

Containers of one path are one role (a list of teasers, or of comments, is one slot).
A page without a main container of its host, and a host of fewer than ``min_pages`` pages, has only
the page's own evidence: the blocks inside an article or main element (else: the body outside
boilerplate containers).

A class name names boilerplate if it is made of such words alone (``cookie-notice``, ``ad-slot``;
not ``follow-up`` or ``legal-analysis``); headings and the ids of running text name nothing, and
a section's id names comments only. Omitted end tags close as HTML says. Character references
are decoded once, white space inside a block becomes one blank, blocks are joined by one blank
in page order.

A null html has no text; a null or unreadable url is a host of its own (the empty one); repeated
pages each give a row; an empty table gives an empty result. Texts of any length are whole.
A hot host is pre-aggregated per task before the shuffle, and pages only meet the main containers
and the repeated runs of their host.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .scratch import Scratch

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|[^<]+|<", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN_ATTR = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

# HTML element names.
RAW = {"script", "style", "template", "textarea", "title", "iframe", "svg", "canvas", "annotation"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr", "img", "object", "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac",
          "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "mspace", "mpadded"}
#: Elements whose end tags may be left out.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html"}
#: What a start tag closes if it is open; any block closes an open p.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
CLOSES |= {x: {"thead", "tbody", "tfoot", "tr", "td", "th"} for x in ("thead", "tbody", "tfoot")} | {f"h{i}": {f"h{j}" for j in range(1, 7)} for i in range(1, 7)}
SCOPE = {"ul", "ol", "menu", "dl", "table", "select"}
IN_HEAD = {"base", "link", "meta"}
DROP_TAGS = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "head", "fieldset"} | RAW
MAIN_TAGS = {"article", "main"}
# Words of boilerplate names, and words that may stand beside them.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "reactions"}
OTHERS = COMMENTS | {"related", "recommended", "recommendations", "sponsor", "sponsored", "promo", "promos", "promotion", "widget", "sidebar", "aside"}
NAMES = OTHERS | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "nav", "navbar",
    "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "widgets", "share", "sharing",
    "social", "follow", "footer", "masthead", "copyright", "legal", "disclaimer", "search", "skip", "hidden", "siteheader", "pageheader"}
BESIDE = {"site", "page", "main", "list", "box", "bar", "block", "area", "section", "container", "wrap", "wrapper", "inner", "outer", "button",
          "buttons", "icons", "links", "link", "items", "item", "form", "slot", "unit", "top", "bottom", "left", "right", "thread", "posts",
          "post", "articles", "stories", "text", "message", "us", "content", "primary", "secondary", "global", "header", "to", "of", "the"}
#: Elements of running text: an id on them is an anchor.
ANCHORS = {"p", "li", "dt", "dd", "td", "th", "tr", "tbody", "table", "figure", "blockquote", "pre"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: has-sidebar and the like say what a page has; they name no container.
PROPERTY = re.compile(r"(?<!\S)(?:has|no|with|without|hide|show|is)[_-]\S*", re.I)
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "dialog", "alert", "menu", "menubar"}
FORM_ROLES = {"search", "form"}


def host(url: Column) -> Column:
    at = F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#\s]*@)?([^/?#\s]*)", 1)
    return F.coalesce(F.lower(at), F.lit(""))


#: Why a block is dropped: bits. BY_NAME and BY_FORM end at an article or main inside.
BY_TAG, BY_NAME, BY_FORM, BY_OTHERS = 1, 2, 4, 8


#: What a container is, as evidence for the slots.
PLAIN, MAIN, BY_WORDS, NEVER = 2, 3, 4, 5
BELIEF = 8


class Box:
    """A container: its path and role, why it is boilerplate itself (``bad``), with all around it
    (``drop``; 0: it is not), and the main element it stands in."""

    __slots__ = ("name", "path", "role", "up", "main", "bad", "drop", "kind")

    def __init__(self, name: str, path: str, up: Box | None, main: str, bad: int, drop: int, kind: int):
        self.name, self.path, self.up, self.main, self.bad, self.drop, self.kind = name, path, up, main, bad, drop, kind
        self.role = _signed(xxh64_intdigest("<" + path))


class Block:
    """One block of text, whole, with the container it stands in, the number of characters in
    links, and whether it is a main heading."""

    __slots__ = ("box", "text", "links", "head")

    def __init__(self, box: Box, text: str, links: int, head: bool):
        self.box, self.text, self.links, self.head = box, text, links, head

    def bad_below(self, main: int) -> int | None:
        """Why the containers between this block and the container ``main`` are boilerplate;
        None if it does not stand in it."""
        bad, box = 0, self.box
        while box is not None and box.role != main:
            bad, box = bad | box.bad, box.up
        return None if box is None else bad


def _names(attrs: str) -> tuple[str, str, str]:
    """(class names, id, role) of a tag's attributes."""
    classes, ids, role = [], [], ""
    for k, *v in ATTR.findall(attrs):
        value = v[0] or v[1] or v[2]
        if k.lower() == "class":
            classes.append(value)
        elif k.lower() == "id":
            ids.append(value)
        elif k.lower() == "role":
            role = value.strip().lower()
    return " ".join(classes), " ".join(ids), role


def named(names: str, words: set = NAMES) -> bool:
    """Whether one of the names is made of boilerplate words, of ``words`` among them."""
    for name in PROPERTY.sub("", names).lower().split():
        parts = [x for x in re.split(r"[\W\d_]+", name.replace("site-header", "siteheader").replace("page-header", "pageheader")) if x]
        if all(x in NAMES or x in BESIDE for x in parts) and any(x in words for x in parts):
            return True
    return False


def boilerplate_name(element: str, classes: str, ids: str) -> int:
    """BY_NAME and BY_OTHERS, as the names of an element say."""
    if element in HEADINGS or not classes and not ids:
        return 0
    anchor = element in ANCHORS
    bad = BY_NAME if named(classes) or not anchor and named(ids, COMMENTS if element == "section" else NAMES) else 0
    return bad | BY_OTHERS if bad and (named(classes, OTHERS) or not anchor and named(ids, OTHERS)) else bad


def parse(page: str | None) -> tuple[list[Block], list[Box], list[str]]:
    """(blocks, containers in page order, other tag tokens with their paths)."""
    blocks: list[Block] = []
    tags: list[str] = []
    stack = [Box("", "", None, "", 0, 0, PLAIN)]  # the page, then the open containers
    boxes = [*stack]
    buf: list[str] = []
    linked, links, head = False, 0, False

    def flush():
        nonlocal links
        if buf:
            text = " ".join(html_lib.unescape("".join(buf)).split())
            if text:
                blocks.append(Block(stack[-1], text, min(links, len(text)), head))
            buf.clear()
        links = 0

    pos, page = 0, page or ""
    while m := TOKEN.match(page, pos):
        pos = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                buf.append(m[0])
                links += len(m[0]) if linked else 0
            elif m[0].startswith("<![CDATA["):
                buf.append(html_lib.escape(m[0][9:-3]))
            continue
        name, closing, attrs = name.lower(), m[1], m[3]
        if name in RAW or name == "noscript" and not stack[-1].main:
            if not closing and not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            if name not in ("svg", "canvas", "iframe", "noscript", "annotation"):
                flush()
            continue
        if name in INLINE:
            if name == "a":
                linked = not closing
            continue
        if name == "br":
            buf.append(" ")
            continue
        flush()
        if name == "h1":
            head = not closing
        if not closing:
            if stack[-1].name == "head" and name not in IN_HEAD:
                stack.pop()
            shut = CLOSES.get(name, set()) | {"p"}
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].name not in LOOSE:
                    break
                if stack[n].name in shut:
                    del stack[n:]
        up = stack[-1]
        path = up.path
        if closing:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].name == name:
                    del stack[n:]
                    break
                if name in LOOSE and stack[n].name in SCOPE and name not in ("body", "html"):
                    break
            tags.append(f"{path}|/{name}")
            continue
        classes, ids, role = _names(attrs)
        names = f"{classes} {ids}".strip()
        own = name in MAIN_TAGS or role == "main"
        main, drop = up.main, up.drop
        kind = "main" if own and name != "article" else name
        if own and main != "article" and (not main or kind == "article"):
            # names and forms around the main element are the page's layout
            drop &= ~(BY_NAME | BY_FORM | (BY_OTHERS if kind == "main" else 0))
        bad = 0
        # a header belongs to the article it stands in, else to the site
        if name in DROP_TAGS or name == "header" and not main or role in DROP_ROLES or HIDDEN_ATTR.search(attrs):
            bad |= BY_TAG
        if name == "form" or role in FORM_ROLES:
            bad |= BY_FORM
        if not own and name not in ("body", "html"):
            bad |= boilerplate_name(name, classes, ids)
        if name in VOID or attrs.rstrip().endswith("/") or name in LOOSE and not bad and not own:
            tags.append(f"{path}|{name} {names}".rstrip())
            continue
        main = main if main == "article" or not own else kind
        stack.append(Box(name, f"{path}/{name}.{names}" if names else f"{path}/{name}", up, main, bad, drop | bad,
                         NEVER if bad & (BY_TAG | BY_FORM) else MAIN if own else BY_WORDS if bad else PLAIN))
        boxes.append(stack[-1])
    flush()
    return blocks, boxes, tags


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Role of the page itself.
PAGE = _signed(xxh64_intdigest("<"))


def run_role(b: Block) -> int:
    return _signed(xxh64_intdigest(f"{b.box.path} {b.text}"))


def roles(blocks: list[Block], tags: list[str]) -> dict[int, tuple[int, int]]:
    """Role -> (count on the page, 1 if a text run) of text runs and of tags that hold no slot."""
    out = {_signed(xxh64_intdigest("<" + t)): (n, 0) for t, n in Counter(tags).items()}
    out.update({r: (n, 1) for r, n in Counter(map(run_role, blocks)).items()})
    return out


def slots(blocks: list[Block], boxes: list[Box]) -> dict[int, list[int]]:
    """Role of each container -> [count, characters outside links, main headings, hash of its
    texts, role around it, place, kind, characters and headings of the container around it]."""
    out: dict[int, list[int]] = {}
    for at, box in enumerate(boxes):
        known = out.setdefault(box.role, [0, 0, 0, 0, box.up.role if box.up else 0, at, box.kind, 0, 0])
        known[0] += 1
    for b in blocks:
        box, h = b.box, xxh64_intdigest(b.text)
        while box is not None:
            known = out[box.role]
            known[1] += len(b.text) - b.links
            known[2] += b.head
            known[3] = (known[3] + h) & ((1 << 64) - 1)
            box = box.up
    for known in out.values():
        known[3] = _signed(known[3])
        known[7:] = out[known[4]][1:3] if known[4] else known[1:3]
    return out


SLOT = ("role", "n", "chars", "heads", "text", "up", "at", "kind", "around", "heads_around")


TOKEN_FIELDS = ("role", "pages", "chars", "heads", "same", "up", "at", "kind", "around", "heads_around")


def _tokens(batches):
    lists = lambda rows, c: pa.array([[x[c] for x in r] for r in rows], pa.list_(pa.int64()))
    for batch in batches:
        plain, held = [], []
        for page in batch.column(2).to_pylist():
            blocks, boxes, tags = parse(page)
            plain.append([(r, *x) for r, x in roles(blocks, tags).items()])
            held.append([(r, *x) for r, x in slots(blocks, boxes).items()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(lists(plain, c) for c in range(3)), *(lists(held, c) for c in range(len(SLOT)))],
                                         names=["host", "content", "t_role", "t_n", "t_run", *(f"s_{x}" for x in SLOT)])


def classes(pages: DataFrame, support: float, min_pages: int, min_size: int) -> DataFrame:
    """host, of (its pages), pages, size and tokens of each class with enough pages: its
    containers and text runs. Only hashes of tokens are shuffled, and the counts per token are
    partial aggregates."""
    arrays = ", ".join(f"{x} array<long>" for x in ("t_role", "t_n", "t_run", *(f"s_{x}" for x in SLOT)))
    per_page = (pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("content"), "html")
                .mapInArrow(_tokens, f"host string, content long, {arrays}").dropDuplicates(["host", "content"]))
    zip_of = lambda cols: F.arrays_zip(*cols)
    plain = F.transform(zip_of(["t_role", "t_n", "t_run"]), lambda x: F.struct(
        x.t_role.alias("role"), x.t_n.alias("n"), *((x.t_run if c == "kind" else F.lit(0).cast("long")).alias(c) for c in SLOT[2:])))
    held = F.transform(zip_of([f"s_{c}" for c in SLOT]), lambda x: F.struct(*(x[f"s_{c}"].alias(c) for c in SLOT)))
    # one row without a role counts the page
    page = F.array(F.struct(F.lit(None).cast("long").alias("role"), *(F.lit(0).cast("long").alias(c) for c in SLOT[1:])))
    rows = per_page.select("host", "content", F.explode(F.concat(plain, held, page)).alias("x")).select(
        "host", "x.*", F.xxhash64("content", "x.n").alias("h"))
    per = rows.groupBy("host", "role").agg(
        F.count("*").alias("pages"), F.sum(F.expr("h & 4294967295")).alias("low"), F.sum(F.expr("shiftrightunsigned(h, 32)")).alias("high"),
        *(F.sum(c).alias(c) for c in ("chars", "heads", "at", "around", "heads_around")),
        (F.min("text") == F.max("text")).alias("same"), F.max("up").alias("up"), F.max("kind").alias("kind"))
    total = per.where("role is null").select("host", F.col("pages").alias("of"))
    often = per.where("role is not null").join(total, "host").where((F.col("pages") >= support * F.col("of")) & (F.col("pages") >= min_pages))
    token = F.struct(*TOKEN_FIELDS)
    return often.groupBy("host", "of", "pages", "low", "high").agg(
        F.count("*").alias("size"), F.collect_list(F.when(F.col("kind") > 0, token)).alias("tokens"))


def main_slots(tokens: list, valid: set[int], share: float) -> list[int]:
    """Roles of the main containers, the deepest first: those of ``valid`` classes on the descent
    from the page into containers that hold ``share`` of the text around them."""
    boxes = {t["role"]: t for t in tokens if t["kind"] >= PLAIN}
    kids: dict[int, list[int]] = {}
    for r, t in boxes.items():
        kids.setdefault(t["up"], []).append(r)

    def holds(t) -> bool:
        if t["kind"] == NEVER or t["same"] and t["pages"] > 1 or 2 * t["heads"] < t["heads_around"]:
            return False
        weight = t["chars"] * BELIEF if t["kind"] == MAIN else t["chars"] / BELIEF if t["kind"] == BY_WORDS else t["chars"]
        return weight > 0 and weight >= share * (weight + t["around"] - t["chars"])

    found, level = [], [PAGE]
    while level:
        level = [r for at in level for r in kids.get(at, []) if holds(boxes[r])]
        found += [sorted((boxes[r]["at"] / boxes[r]["pages"], r) for r in level if r in valid)]
        level = [r for r in level if boxes[r]["kind"] != MAIN]
    return [r for rows in reversed(found) for _, r in rows]


def _decide(share: float, repeat: float, repeat_pages: int, min_size: int):
    def run(batches):
        for pdf in batches:
            mains, runs = [], []
            for of, tokens in zip(pdf["of"], pdf["tokens"]):
                valid = {t["role"] for t in tokens if t["size"] >= min_size}
                mains.append(main_slots(list(tokens), valid, share))
                runs.append([t["role"] for t in tokens if t["kind"] == 1 and t["role"] in valid and t["pages"] >= max(repeat * of, repeat_pages)])
            yield pd.DataFrame({"host": pdf["host"], "mains": mains, "runs": runs})
    return run


def templates(pages: DataFrame, support: float = 0.1, min_pages: int = 3, min_size: int = 3, share: float = 0.5, repeat: float = 0.8,
              repeat_pages: int = 10) -> DataFrame:
    """host, mains (roles of its main containers, the deepest first), runs (roles of its repeated texts)."""
    found = classes(pages, support, min_pages, min_size)
    tokens = F.transform("tokens", lambda t: F.struct(*(t[c].alias(c) for c in TOKEN_FIELDS), F.col("size").alias("size")))
    # a run below its bar never reaches the host's row
    bar = F.greatest(F.col("of") * repeat, F.lit(float(repeat_pages)))
    kept = F.filter(tokens, lambda t: (t["kind"] >= PLAIN) | (t["pages"] >= bar))
    return (found.groupBy("host", "of").agg(F.flatten(F.collect_list(kept)).alias("tokens"))
            .mapInPandas(_decide(share, repeat, repeat_pages, min_size), "host string, mains array<long>, runs array<long>"))


def main_text(page: str | None, runs: set[int], mains: list[int] = ()) -> str:
    """Text of the main container, given the host's repeated runs and main containers."""
    blocks, boxes, _ = parse(page)
    here, found = {box.role for box in boxes} if mains else (), []
    for main in mains:
        if main in here:
            below = [b.bad_below(main) for b in blocks]
            if found := [b for b, bad in zip(blocks, below) if bad == 0]:
                break
    if found:
        chosen = found
        if any(b.box.main for b in found):
            # the article around the main container, or articles in it, before the rest of it
            chosen = [b for b, bad in zip(blocks, below) if b.box.main and (bad == 0 or not b.box.drop)]
    else:
        kept = [b for b in blocks if not b.box.drop]
        # an only article is the main element whatever its containers are called, and a form that
        # holds all the text is the page
        chosen = ([b for b in kept if b.box.main] or [b for b in blocks if b.box.main and b.box.drop == BY_OTHERS] or kept
                  or [b for b in blocks if b.box.drop == BY_FORM])
    return " ".join(b.text for b in chosen if not runs or run_role(b) not in runs)


def extract(pages: DataFrame, **options) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages`` (page_id, url, html);
    options of ``templates``."""
    scratch = Scratch(pages.sparkSession)
    known = scratch.stage(templates(pages, **options), "html_templates")

    def run(batches):
        sets: dict = {}
        for pdf in batches:
            texts = []
            for h, page, runs, mains in zip(pdf["host"], pdf["html"], pdf["runs"], pdf["mains"]):
                if h not in sets:
                    if len(sets) >= 1000:
                        sets.clear()
                    sets[h] = (set(), []) if runs is None else (set(np.asarray(runs).tolist()), np.asarray(mains).tolist())
                texts.append(main_text(page, *sets[h]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    return p.join(known, "host", "left").select("page_id", "url", "host", "html", "runs", "mains").mapInPandas(
        run, "page_id long, url string, text string, n_chars long")
