"""Main text of web pages by consensus: containers are scored per page, and pages of a host vote on their path."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.workspace import store

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose text is not shown, skipped up to their end tag.
RAW = frozenset("script style noscript template iframe svg textarea title object canvas math".split())
#: Elements that are never part of an article.
SKIPPED = frozenset("head nav header footer aside form button select menu dialog input label fieldset".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that name what is not the article, if the element holds little of the page (DOUBTS).
DOUBTED_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments reply replies respond disqus discussion share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar skip search form".split()
)
#: Parts that name the same wherever they stand in a class or id.
DOUBTED_PARTS = re.compile("comment|cookie|advert|sidebar|newsletter|sponsor|breadcrumb|disqus|navbar|popup|footer|masthead")
#: Words beside those in one name that leave its sense as it is, and names that speak for an article.
NEUTRAL_WORDS = frozenset("list lists item items wrapper wrap box bar area section container block blocks inner outer left right top bottom site page post posts main content body text thread group row col column global primary secondary links icons buttons unit slot zone".split())
ARTICLE_WORDS = frozenset("article articles entry story content post main text body single blog".split())
COMMENT_WORDS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related".split())
#: How much of its own text the rest of the page must have for a doubted element to go: one whose name says nothing else, and
#: one whose name may mean something else ("with-sidebar", "entry promo").
PLAIN, VAGUE = 0.3, 1.5
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td blockquote center details".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left kind is closed by a start tag of the right kinds.
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPE = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
#: What a container further up gets of the text below it, and the weight of elements that name the article.
UPWARD, NAMED = 0.75, {"article": 2.0, "main": 1.6}


#: Elements that a start tag may close, and those that stop the search for them.
STOPS = frozenset(CLOSED_BY) | CONTAINERS | frozenset(t for tags in SCOPE.values() for t in tags)


def label_hash(above: int, label: str) -> int:
    """The signed 64-bit name of a path: of the path above it and the last label."""
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(label.encode("utf-8", "replace"), above % 2**64)
    return x - 2**64 if x >= 2**63 else x


class Node:
    """An open element. What it needs of those around it is handed down, so that depth costs nothing."""

    __slots__ = ("tag", "parent", "skipped", "inside", "link", "path", "container", "article", "stop", "place", "doubted", "doubt", "weight", "holds_article", "gone")

    def __init__(self, tag: str, label: str, parent: Node | None, skipped: bool, doubt: float = 0.0):
        self.tag, self.parent = tag, parent
        self.skipped = skipped or bool(parent and parent.skipped)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.link = tag == "a" or bool(parent and parent.link)
        self.path = label_hash(parent.path if parent else 0, label)
        self.container: Node | None = self if tag in CONTAINERS else parent and parent.container
        # the outermost article around, else the outermost main element
        around = parent and parent.article
        self.article: Node | None = around if around and around.tag == "article" else self if tag == "article" else around or (self if tag == "main" else None)
        self.stop: Node | None = self if tag in STOPS else parent and parent.stop
        self.place = -1
        # the nearest doubted element, this one or one around it; its own text, and whether an article stands in it
        self.doubt = doubt
        self.doubted: Node | None = self if doubt else parent and parent.doubted
        self.weight, self.holds_article, self.gone = 0, False, False


def doubt_of(tag: str, names: list[str], inside: bool) -> float:
    """0 where no name of an element speaks against it, else PLAIN or VAGUE."""
    words = COMMENT_WORDS if tag == "article" else DOUBTED_WORDS
    found, speaks_for = 0.0, False
    for name in names:
        parts = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if w]
        against = [w for w in parts if w in words or tag != "article" and DOUBTED_PARTS.search(w)]
        if against == ["header"] and (inside or any(w in ARTICLE_WORDS for w in parts)):
            continue  # it holds the title
        if against:
            found = max(found, VAGUE if any(w not in NEUTRAL_WORDS and w not in against for w in parts) else PLAIN)
        else:
            speaks_for |= any(w in ARTICLE_WORDS for w in parts)
    return VAGUE if found and speaks_for else found


def _opened(tag: str, attributes: str, parent: Node | None) -> Node:
    classes, names, skipped = "", [], tag in SKIPPED
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, given = m[1].lower(), m[2] or m[3] or m[4] or ""
            value = given.lower()
            if name == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "0", c) for c in value.split()}))
            if name in ("class", "id"):
                names += given.split()
            elif name == "role":
                skipped |= value in SKIPPED_ROLES
            elif name == "style":
                skipped |= "display:none" in value.replace(" ", "")
            else:
                skipped |= value != "false"
    inside = bool(parent and parent.inside)
    if inside and tag == "header":
        skipped = False
    doubt = doubt_of(tag, names, inside) if names and tag not in ("html", "body", "main") else 0.0
    return Node(tag, f"{tag}.{classes}" if classes else tag, parent, skipped, doubt)


def settle_doubts(doubted: list[Node], total: int) -> None:
    """Decide which doubted elements go, plain names first, from that with the least text on: one goes if what stays of the page outside it has
    enough text beside its own. So what holds most of a page stays, whatever it is called; so does one around an article or
    main element that is not doubted itself. `weight` is the text that stands in it and in no other doubted element."""
    up = lambda n: n.parent and n.parent.doubted
    place = {id(n): i for i, n in enumerate(doubted)}
    text, last = [n.weight for n in doubted], list(range(len(doubted)))
    for i in range(len(doubted) - 1, -1, -1):  # outer ones come first
        if (above := up(doubted[i])) is not None:
            at = place[id(above)]
            text[at], last[at] = text[at] + text[i], max(last[at], last[i])
            above.holds_article |= doubted[i].holds_article
    removed = [0] * (len(doubted) + 1)  # sums over ranges of places, each within the reach of its lowest bit

    def removed_up_to(i: int) -> int:
        found = 0
        while i:
            found, i = found + removed[i], i & (i - 1)
        return found

    for doubt in (PLAIN, VAGUE):
        for _, behind in sorted((t, -i) for i, t in enumerate(text) if doubted[i].doubt == doubt and not doubted[i].gone):
            i = -behind
            n, own = doubted[i], text[i] - removed_up_to(last[i] + 1) + removed_up_to(i)
            if not n.holds_article and total - own >= doubt * own:
                n.gone = True
                total -= own
                at = i + 1
                while own and at <= len(doubted):
                    removed[at] += own
                    at += at & -at
        for n in doubted:
            above = up(n)
            n.gone |= above is not None and above.gone


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """The shown blocks of a page in order: (innermost element, text with single spaces, characters inside links). In time
    linear in the page (but for the sorting of its doubted elements), however deep its elements."""
    opened_tags: dict[str, int] = {}
    pieces: list[list[tuple[str, Node]]] = []
    doubted: list[Node] = []
    node: Node | None = Node("html", "html", None, False)
    node = body = Node("body", "body", node, False)
    text: list[tuple[str, Node]] = []
    total, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal text
        if text:
            pieces.append(text)
            text = []

    def shown(raw: str) -> None:
        nonlocal total
        if node.skipped or not raw:
            return
        text.append((raw, node))
        if not raw.isspace():
            total += len(raw)
            if node.doubted is not None:
                node.doubted.weight += len(raw)

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # a tag that the end of the page cuts off
            shown(rest[: cut.start()] if cut else rest)
            break
        shown(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            shown(" ")
        elif m[1]:  # an end tag: up to the element that it closes, if one is open
            if tag in BLOCKS:
                flush()
            if opened_tags.get(tag):
                closed = True
                while closed:
                    opened_tags[node.tag] -= 1
                    closed, node = node.tag != tag, node.parent
        else:
            if tag in BLOCKS:
                flush()
            if tag in ("html", "body"):
                continue
            up = node.stop
            while up is not None and up is not body:
                if tag in CLOSED_BY.get(up.tag, ()):
                    while node is not up.parent:
                        opened_tags[node.tag] -= 1
                        node = node.parent
                    break
                if tag in SCOPE and up.tag in SCOPE[tag] or up.tag in CONTAINERS:
                    break
                up = up.parent.stop
            opened = _opened(tag, m[3] or "", node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
                node = opened
                opened_tags[tag] = opened_tags.get(tag, 0) + 1
                if opened.doubt:
                    doubted.append(opened)
                elif tag in ("article", "main") and opened.doubted is not None:
                    opened.doubted.holds_article = True
                elif tag == "h1" and opened.doubted is not None:
                    opened.doubted.doubt = VAGUE
    flush()
    settle_doubts(doubted, total)
    found: list[tuple[Node, str, int]] = []
    for block in pieces:
        kept = [(raw, x) for raw, x in block if x.doubted is None or not x.doubted.gone]
        whole = " ".join(html.unescape("".join(raw for raw, _ in kept)).split())
        if whole:
            owner = next(x for raw, x in kept if not raw.isspace())
            found.append((owner, whole, sum(len(raw) for raw, x in kept if x.link)))
    return found


def parsed(page: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
    """The containers of a page as (path, place of the one around or -1, score), outer ones first, and its shown blocks as
    (place of their container, text).

    A container's score is the text outside links below it: in full where it stands, less further up. What stands inside
    an article or main element counts for that element, title and parts together.
    """
    found = blocks(page)
    order: list[Node] = []

    def placed(node: Node) -> int:
        above = []
        while node is not None and node.place < 0:
            above.append(node)
            node = node.parent and node.parent.container
        for n in reversed(above):
            n.place = len(order)
            order.append(n)
        return above[0].place if above else node.place

    total: dict[int, float] = {}
    shown = []
    for owner, text, linked in found:
        shown.append((placed(owner.container), text))
        at = placed(owner.article or owner.container)
        total[at] = total.get(at, 0.0) + max(0, len(text) - 2 * linked)
    around = [n.parent.container.place if n.parent and n.parent.container else -1 for n in order]
    score = [total.get(i, 0.0) for i in range(len(order))]
    for i in range(len(order) - 1, 0, -1):
        score[around[i]] += UPWARD * score[i]
    return [(n.path, up, int(s * NAMED.get(n.tag, 1.0))) for n, up, s in zip(order, around, score)], shown


def best_path(containers: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """(path, score) of the path with the highest score in all; null without containers."""
    by_path: dict[int, int] = {}
    for path, _, score in containers:
        by_path[path] = by_path.get(path, 0) + score
    return max(by_path.items(), key=lambda x: (x[1], x[0]), default=None)


def main_text(containers: list[tuple[int, int, int]], shown: list[tuple[int, str]], winner: int | None, least: float = 0.3) -> str:
    """The blocks under the winning path; under the page's own best where the page lacks it or has little text there."""
    own = best_path(containers)
    if own is None:
        return ""
    there = [score for path, _, score in containers if path == winner]
    wanted = winner if there and sum(there) >= least * own[1] else own[0]
    inside: list[bool] = []
    for path, up, _ in containers:  # outer ones come first
        inside.append(path == wanted or up >= 0 and inside[up])
    return "\n".join(text for at, text in shown if inside[at])


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


PARSED = "containers array<struct<path:long,up:int,score:int>>, blocks array<struct<at:int,text:string>>, best long, best_score long"


def parse_pages(pages: DataFrame, url: str, page: str, key: str) -> DataFrame:
    """Every page parsed once: key, url, host, its containers and shown blocks, and the path it votes for."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        containers = pa.list_(pa.struct([("path", pa.int64()), ("up", pa.int32()), ("score", pa.int32())]))
        shown = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for part in range(0, batch.num_rows, 256):  # blocks of few pages at a time
                rows = batch.slice(part, 256)
                read = [parsed(t or "") for t in rows.column(3).to_pylist()]
                best = [best_path(c) or (None, None) for c, _ in read]
                arrays = [pa.array([[dict(zip(("path", "up", "score"), x)) for x in c] for c, _ in read], containers), pa.array([[dict(zip(("at", "text"), x)) for x in b] for _, b in read], shown)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), *arrays, *[pa.array([b[i] for b in best], pa.int64()) for i in range(2)]], names=[key, url, "host", "containers", "blocks", "best", "best_score"])

    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, pages.schema[url].dataType), T.StructField("host", T.StringType()), *T._parse_datatype_string(PARSED).fields])
    return pages.select(key, url, host_of(F.col(url)).alias("host"), page).mapInArrow(parse, schema)


def winning_paths(parsed_pages: DataFrame) -> DataFrame:
    """(host, path): the container path that most pages of the host score best; scores, then names, break ties."""
    counted = parsed_pages.where("best is not null").groupBy("host", "best").agg(F.count(F.lit(1)).alias("votes"), F.sum("best_score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("best", F.struct("votes", "score", "best")).alias("winner"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", key: str = "page_id") -> DataFrame:
    """Per page: key, url, text (blocks of the article joined by line feeds; empty if none), n_chars (code points).

    Pages are parsed once and stored as containers and blocks; the votes of each host fold before the shuffle, and the
    winners are stored, so that Spark broadcasts them while they are few and shuffles beyond. A null or empty html gives an
    empty text; pages without a readable host share one empty host; markup that the end of a page cuts off is left out;
    elements may nest as deep as they like; repeated rows get a row each; no rows give no rows; other columns are not read.
    """
    stored = store(parse_pages(pages, url, page, key), "pages")
    winners = store(winning_paths(stored), "winning-paths").withColumnRenamed("host", "_host")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = []
            for containers, shown, winner in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                texts.append(main_text([(c["path"], c["up"], c["score"]) for c in containers], [(b["at"], b["text"]) for b in shown], winner))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, pages.schema[url].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    joined = stored.join(winners, F.col("host") == F.col("_host"), "left").select(key, url, "containers", "blocks", "winner")
    return joined.mapInArrow(read, schema)
