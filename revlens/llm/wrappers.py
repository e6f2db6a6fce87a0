"""Main text of web pages by wrapper induction (operator 8).

A page becomes a tree of its block elements; runs of like siblings (paragraphs, list items) are one
node. Trees of pages of one host are aligned by simple tree matching. The wrapper of a host is the
aligned tree with, for every node, on how many pages it stood, whether its text was the same on all
of them (template) or varied (slot), and how much text and link text it held.

A wrapper's content is found once per host: an article or main element that holds a fair share of
the varying text, else the deepest node that holds most of it. A page's nodes are matched to the
wrapper, and the text below its content nodes, without elements of other roles (menus, headers,
footers, sidebars, notices, adverts, forms, comments), is the result, in page order.

Elements, roles and hidden elements are of another role for certain. A word of a class or id only
makes a candidate, and the host's wrapper decides by label: a candidate that holds the content (the
article or main element, or most of the varying text) is none, nor is a section of an article that
has the word in its id only, if its text varies or few pages have it.

Wrappers are learned from all pages: every task aligns the pages it reads and gives one tree per
host, of at most ``MOST_NODES`` nodes; trees of a host are then aligned with each other. A hot host
thus sends as many small trees as there are tasks. Pages meet their wrapper by a broadcast while all
wrappers together are small, else in a join salted by page, so a hot host's pages stay spread.

Defined results: a null or empty html, and a page without content, give an empty text; a null or
odd url counts as host ''; a single page of a host is its own wrapper; repeated rows are kept; an
empty table gives no rows; where every page of a host is the same, nothing varies, and the rule is
applied to all of its text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, known_id, null_id, slices, stored

#: Nodes of a wrapper beyond which those seen on one page only are left out.
MOST_NODES = 400
#: Elements nested deeper than this are taken as part of the element at that depth.
MOST_DEPTH = 150
#: A semantic container must hold this share of a host's text, another node that share.
SEMANTIC_SHARE, OTHER_SHARE = 0.25, 0.7
#: Wrappers of up to so many bytes in all are broadcast; beyond that pages are joined, each host's
#: dealt to SALTS tasks.
BROADCAST_BYTES, SALTS = 16 << 20, 16

# Elements and their parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var td th br wbr img".split()) | frozenset(
    "object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
    "mmultiscripts mtable mtr mtd semantics annotation".split())
#: An opening tag of the key ends an open element of the values, up to the nearest of the stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}

# Roles that are not main text, by element, by word of class or id, and by role.
OTHER_TAGS = frozenset("nav footer aside form button dialog menu head".split())
OTHER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert nav navbar navigation menu menus sidebar aside footer footnote breadcrumb "
    "breadcrumbs comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe subscription signup login popup modal overlay pagination pager widget widgets toolbar "
    "search skip".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu "
                        "menubar toolbar".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
#: Of OTHER_WORDS, those of text by readers and advertisers, which can be longer than the article.
FOREIGN_WORDS = frozenset(
    "comment comments commentlist disqus reply replies respond ad ads adbox advert adverts advertisement advertising "
    "sponsor sponsored promo promotion".split())
#: A name that begins or ends so says what an element has or how it looks, not what it is.
HAS_WORDS = frozenset("has no not with without hide show is supports".split())
STATE_WORDS = frozenset("enabled disabled open closed on off".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Kinds of ``other``: for certain, by a word of a class or id, by a word of a section's id only.
CERTAIN, NAMED, TITLED = 1, 2, 3
MAIN_TAGS = ("article", "main")
MAIN_WORDS = frozenset("article post entry story content main body text".split())

#: A quote opens an attribute's value only right after = and white space; elsewhere it is a sign like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   r"<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
WORDS = re.compile(r"[A-Za-z]+")


class Node:
    """A block element; ``parts`` are its texts and child nodes in order."""

    __slots__ = ("tag", "names", "other", "parts", "link_chars")

    def __init__(self, tag: str, names: str = "", other: int = 0) -> None:
        self.tag, self.names, self.other = tag, names, other
        self.parts: list[str | Node] = []
        self.link_chars = 0

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}"

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def own_text(self) -> str:
        return squeeze(" ".join(p for p in self.parts if isinstance(p, str)))


def squeeze(text: str) -> str:
    return " ".join(text.split())


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def role_words(names: str) -> set[str]:
    """Words of OTHER_WORDS in class names or ids that name a role: not "has-sidebar", "share-enabled"."""
    found = set()
    for name in names.lower().split():
        words = WORDS.findall(name)
        if len(words) == 1 or words and words[0] not in HAS_WORDS and words[-1] not in STATE_WORDS:
            found.update(w for w in words if w in OTHER_WORDS)
    return found


def is_other(tag: str, attrs: dict[str, str], in_main: bool) -> int:
    """Whether an element plays a role that is not main text: 0, CERTAIN, NAMED or TITLED."""
    named, own_id = attrs.get("class", ""), "" if tag in HEADINGS else attrs.get("id", "")
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get(
        "style", "").replace(" ", "").lower()
    header = not in_main and (tag == "header" or tag not in MAIN_TAGS and any(
        w.lower() in HEADER_WORDS for w in WORDS.findall(f"{named} {own_id}")))
    if tag in OTHER_TAGS or attrs.get("role", "").lower() in OTHER_ROLES or hidden or header:
        return CERTAIN
    if tag in ("html", "body", "main"):
        return 0
    if named and role_words(named):
        return NAMED
    if own_id and role_words(own_id):
        return TITLED if in_main and tag == "section" else NAMED
    return 0


def parse(source: str) -> Node:
    """The page's tree of block elements; lenient about missing and stray tags."""
    root = Node("root")
    stack, links, at, n = [root], 0, 0, len(source)
    opened: Counter[str] = Counter()  # open elements by name
    skipped: list[str] = []  # open elements below one of another role that are inline

    def say(text: str) -> None:
        if text:
            text = entities.unescape(text)
            stack[-1].parts.append(text)
            if links:
                stack[-1].link_chars += len(text)

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
            if node.parts is stack[k - 1].parts:  # below MOST_DEPTH: its end is that of a block
                node.parts.append(Node("end"))
                stack[k - 1].link_chars += node.link_chars
        del stack[k:]

    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at:m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
        if m[3] is None:
            continue
        tag, ends = m[3].lower(), bool(m[2])
        if tag in RAW:
            if not ends and not m[4].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else n
            continue
        if tag == "a":
            links = 0 if ends else 1
        attrs = attributes(m[4]) if m[4] and not ends else {}
        if tag in INLINE and not (attrs and is_other(tag, attrs, True)) and not (ends and tag in skipped):
            if tag in ("br", "td", "th", "wbr", "img"):
                say(" ")
            continue
        if ends:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    if tag in skipped:
                        skipped.remove(tag)
                    break
            continue
        if tag in INLINE:
            skipped.append(tag)
        elif stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in IMPLIED:
            ended, stops = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ended) else ():
                if stack[k].tag in stops:
                    break
                if stack[k].tag in ended:
                    close(k)
                    break
        in_main = any(opened[t] for t in MAIN_TAGS)
        own_id = "" if tag in HEADINGS else attrs.get("id", "")
        names = re.sub(r"\d+", "#", squeeze(attrs.get("class", "") + " " + own_id))
        node = Node(tag, names, is_other(tag, attrs, in_main))
        holds = tag not in VOID and not m[4].endswith("/")
        if len(stack) > MOST_DEPTH and (not node.other or stack[-1].other):
            # Its text is said to the element at that depth, as blocks; it is open until it is closed.
            node.parts, node.other = stack[-1].parts, stack[-1].other
            node.parts.append(Node("end"))
        else:
            stack[-1].parts.append(node)
        if holds:
            stack.append(node)
            opened[tag] += 1
            links = 0 if tag not in INLINE else links
    return root


class Slot:
    """A node of a wrapper."""

    __slots__ = ("label", "other", "pages", "digest", "varies", "chars", "links", "children")

    def __init__(self, label: str, other: int) -> None:
        self.label, self.other, self.pages, self.digest, self.varies = label, other, 1, 0, False
        self.chars, self.links = 0, 0
        self.children: list[Slot] = []

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def state(self) -> list:
        return [self.label, self.other, self.pages, self.digest, self.varies, self.chars, self.links,
                [c.state() for c in self.children]]

    @staticmethod
    def of(state: list) -> Slot:
        slot = Slot(state[0], state[1])
        slot.pages, slot.digest, slot.varies, slot.chars, slot.links = state[2:7]
        slot.children = [Slot.of(c) for c in state[7]]
        return slot


def digest_of(texts: list[str]) -> int:
    import zlib

    return zlib.crc32("\n".join(texts).encode("utf-8", "surrogatepass"))


def skeleton(nodes: list[Node]) -> tuple[Slot, list[list[Node]]]:
    """The tree of like siblings: a slot for ``nodes``, and per child slot the page's nodes."""
    first = nodes[0]
    slot = Slot(first.label, first.other)
    own = [n.own_text() for n in nodes]
    slot.chars, slot.links = sum(map(len, own)), sum(n.link_chars for n in nodes)
    slot.digest = digest_of(own) if slot.chars else 0
    groups: list[list[Node]] = []
    for node in nodes:
        at = 0
        for child in node.children():
            # Like siblings join the group of their label at or after the last one used.
            k = next((i for i in range(at, len(groups)) if groups[i][0].label == child.label), None)
            if k is None:
                groups.append([child])
                k = len(groups) - 1
            else:
                groups[k].append(child)
            at = k
    slot.children = [skeleton(g)[0] for g in groups]
    return slot, groups


def match(a: list[Slot], b: list[Slot], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two ordered lists of children: size and pairs of the best alignment."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    weight = [[tree_match(x, y, memo) for y in b] for x in a]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1],
                             best[i - 1][j - 1] + weight[i - 1][j - 1] if weight[i - 1][j - 1] else 0)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def tree_match(x: Slot, y: Slot, memo: dict) -> int:
    if x.label != y.label:
        return 0
    key = (id(x), id(y))
    if key not in memo:
        memo[key] = 1 + match(x.children, y.children, memo)[0]
    return memo[key]


def merge(into: Slot, other: Slot, memo: dict | None = None) -> Slot:
    """Align two trees of one label; unmatched nodes of either stay, in order."""
    memo = {} if memo is None else memo
    into.varies |= other.varies or into.digest != other.digest
    into.pages += other.pages
    into.chars += other.chars
    into.links += other.links
    _, pairs = match(into.children, other.children, memo)
    merged, i, j = [], 0, 0
    for p, q in [*pairs, (len(into.children), len(other.children))]:
        merged += into.children[i:p] + other.children[j:q]
        if p < len(into.children):
            merged.append(merge(into.children[p], other.children[q], memo))
        i, j = p + 1, q + 1
    into.children = merged
    return into


def pruned(slot: Slot) -> Slot:
    """A wrapper of at most MOST_NODES nodes, without its rarest ones."""
    least = 2
    while slot.size() > MOST_NODES and least <= slot.pages:
        drop_rare(slot, least)
        least *= 2
    return slot


def drop_rare(slot: Slot, least: int) -> None:
    slot.children = [c for c in slot.children if c.pages >= least]
    for c in slot.children:
        drop_rare(c, least)


def own_mass(slot: Slot, evidence: bool) -> int:
    """Characters of a slot's own text that speak for content: they vary and aren't links."""
    return max(0, slot.chars - 2 * slot.links) if slot.varies or not evidence or slot.pages == 1 else 0


def decided(wrapper: Slot) -> dict[str, bool]:
    """Whether candidates are of another role, by label."""
    evidence = any_varies(wrapper)
    masses: dict[int, int] = {}

    def mass(slot: Slot) -> int:
        """Text of a slot and below, without that for certain of another role and by others."""
        if id(slot) not in masses:
            masses[id(slot)] = own_mass(slot, evidence) + sum(
                mass(c) for c in slot.children if c.other != CERTAIN and not foreign(c))
        return masses[id(slot)]

    total = mass(wrapper)

    def holds(slot: Slot, in_article: bool) -> bool:
        """Whether a main element, or an article that is in no other, of a fair share is here."""
        tag = slot.label.split(".")[0]
        if (tag == "main" or tag == "article" and not in_article) and mass(slot) >= max(1, SEMANTIC_SHARE * total):
            return True
        return any(holds(c, in_article or tag == "article") for c in slot.children
                   if c.other != CERTAIN and not foreign(c))

    def elsewhere(slot: Slot, but: Slot) -> bool:
        """Whether such an element is outside ``but``, in no candidate."""
        if slot is but or slot is not wrapper and slot.other:
            return False
        tag = slot.label.split(".")[0]
        if tag in MAIN_TAGS and mass(slot) >= max(1, SEMANTIC_SHARE * total) and not below(slot, but):
            return True
        return any(elsewhere(c, but) for c in slot.children)

    out: dict[str, bool] = {}

    def decide(slot: Slot, in_article: bool) -> None:
        if slot.other in (NAMED, TITLED):
            rare = slot.other == TITLED and 2 * slot.pages < wrapper.pages
            if foreign(slot):
                other = not rare and mass(slot) <= 20 * total
            elif slot.other == TITLED:
                other = not rare and mass(slot) == 0
            else:
                other = not (holds(slot, in_article) or total and mass(slot) >= OTHER_SHARE * total
                             and not elsewhere(wrapper, slot))
            out[slot.label] = out.get(slot.label, True) and other
        for c in slot.children:
            decide(c, in_article or slot.label.startswith("article."))

    decide(wrapper, False)
    return out


def foreign(slot: Slot) -> bool:
    return slot.other in (NAMED, TITLED) and bool(role_words(slot.label.partition(".")[2]) & FOREIGN_WORDS)


def below(slot: Slot, wanted: Slot) -> bool:
    return slot is wanted or any(below(c, wanted) for c in slot.children)


def left_out(x: Node | Slot, roles: dict[str, bool]) -> bool:
    """Whether a node is of another role; sections that the wrapper doesn't know are rare ones."""
    return x.other == CERTAIN or x.other and roles.get(x.label, x.other == NAMED)


def content_path(wrapper: Slot) -> list[int]:
    """Where the content is: the way of child numbers from the root to the content slot."""
    evidence, roles = any_varies(wrapper), decided(wrapper)

    def mass(slot: Slot) -> int:
        if left_out(slot, roles):
            return 0
        return own_mass(slot, evidence) + sum(mass(c) for c in slot.children)

    total = mass(wrapper)
    best: list[tuple[int, list[int]]] = []

    def search(slot: Slot, way: list[int]) -> None:
        if left_out(slot, roles):
            return
        if is_main(slot.label) and mass(slot) >= SEMANTIC_SHARE * total:
            best.append((mass(slot) * (4 if slot.label.split(".")[0] in MAIN_TAGS else 1), way))
        for i, c in enumerate(slot.children):
            search(c, [*way, i])

    search(wrapper, [])
    tags = [b for b in best if b[1] and at(wrapper, b[1]).label.split(".")[0] in MAIN_TAGS]
    if tags or best:
        # The innermost container among those that hold the most.
        top = max(b[0] for b in tags or best)
        return max((b for b in tags or best if b[0] >= 0.9 * top), key=lambda b: len(b[1]))[1]
    way, slot = [], wrapper
    while total:
        k = next((i for i, c in enumerate(slot.children) if mass(c) >= OTHER_SHARE * total), None)
        # Stop above the paragraphs: a leaf's siblings are content too.
        if k is None or not slot.children[k].children:
            break
        way, slot = [*way, k], slot.children[k]
    return way


def any_varies(slot: Slot) -> bool:
    return slot.varies or any(any_varies(c) for c in slot.children)


def is_main(label: str) -> bool:
    tag, _, names = label.partition(".")
    words = {w.lower() for w in WORDS.findall(names)}
    return tag in MAIN_TAGS or tag in ("div", "section", "td") and bool(words & MAIN_WORDS)


def at(slot: Slot, way: list[int]) -> Slot:
    for i in way:
        slot = slot.children[i]
    return slot


def extract(source: str | None, wrapper: Slot, way: list[int], roles: dict[str, bool] | None = None) -> str:
    """Main text of a page under its host's wrapper; ``roles`` are the wrapper's ``decided``."""
    if not source:
        return ""
    root = parse(source)
    roles = decided(wrapper) if roles is None else roles
    found = [b for n in locate(root, wrapper, way) for b in blocks(n, roles)]
    if not found:  # the page is not of the host's common form
        own, _ = skeleton([root])
        roles = decided(own) | {label: other for label, other in roles.items() if not other}
        found = [b for n in locate(root, own, content_path(own)) for b in blocks(n, roles)]
    return "\n\n".join(found)


def locate(root: Node, wrapper: Slot, way: list[int]) -> list[Node]:
    """The page's nodes that align with the wrapper's content slot."""
    nodes = [root]
    for i in way:
        page, groups = skeleton(nodes)
        pairs = dict((q, p) for p, q in match(page.children, wrapper.children, {})[1])
        if i not in pairs:
            return []
        nodes, wrapper = groups[pairs[i]], wrapper.children[i]
    return nodes


def blocks(node: Node, roles: dict[str, bool]) -> list[str]:
    """Texts of the blocks below a node, without nodes of other roles."""
    if left_out(node, roles):
        return []
    out, run = [], []
    for p in node.parts:
        if isinstance(p, str):
            run.append(p)
        elif not (p.tag in INLINE and left_out(p, roles)):
            out += [squeeze("".join(run)), *blocks(p, roles)]
            run = []
    return [t for t in [*out, squeeze("".join(run))] if t]


def host_of():
    url = F.coalesce(F.col("url"), F.lit(""))
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (its tree as JSON), way (to the content slot)."""
    bound_batches(pages.sparkSession)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, Slot] = {}
        for pdf in slices(batches, text="html"):
            for host, source in zip(pdf["host"], pdf["html"], strict=True):
                if source:
                    tree = skeleton([parse(source)])[0]
                    trees[host] = pruned(merge(trees[host], tree)) if host in trees else tree
                    if len(trees) >= 5_000:  # hand on what was learned so far and go on
                        yield _rows(trees)
                        trees = {}
        yield _rows(trees)

    def joined(key, pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [Slot.of(json.loads(t)) for t in sorted(pdf["tree"])]
        wrapper = trees[0]
        for t in trees[1:]:
            wrapper = pruned(merge(wrapper, t))
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper.state())],
                             "way": [json.dumps(content_path(wrapper))]})

    return (pages.select(host_of().alias("host"), "html").mapInPandas(local, "host string, tree string")
            .groupBy("host").applyInPandas(joined, "host string, wrapper string, way string"))


def _rows(trees: dict[str, Slot]) -> pd.DataFrame:
    return pd.DataFrame({"host": list(trees), "tree": [json.dumps(t.state()) for t in trees.values()]},
                        dtype=object)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    own = pages.select(known_id("page_id"), "url", "html", host_of().alias("host"))
    wrappers = stored(learn_wrappers(pages), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # the pages stay where they are read
        met = own.join(F.broadcast(wrappers), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        every = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", salt).join(every, ["host", "salt"], "left").drop("salt")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[Slot, list[int], dict[str, bool]]] = {}
        for pdf in slices(batches, text="html"):
            out = []
            for host, source, wrapper, way in zip(pdf["host"], pdf["html"], pdf["wrapper"], pdf["way"], strict=True):
                if not source or not isinstance(wrapper, str):
                    out.append("")
                    continue
                if host not in known:
                    if len(known) > 1_000:
                        known.clear()
                    tree = Slot.of(json.loads(wrapper))
                    known[host] = tree, json.loads(way), decided(tree)
                out.append(extract(source, *known[host]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out,
                                "n_chars": [len(t) for t in out]})

    return (met.mapInPandas(texts, "page_id long, url string, text string, n_chars long")
            .withColumn("page_id", null_id("page_id")))
