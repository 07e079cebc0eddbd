"""Main text of web pages by template deduction: tokens with equal occurrence vectors on a host's pages make its template.

A token is an element in its place (the path of elements down to it) or a whole block of text in its place. Its
occurrence vector has its number on each page of the host. Tokens with the same vector form an equivalence class; a
class that is frequent and has several tokens is valid, and its elements belong to the template if the elements around
them do, so that classes nest. The slots between them hold what differs from page to page. From the top the template is
followed into the slot that holds most of the host's text, as long as one does, and the element around that slot holds
the article of each page of the host, whatever its name is. Pages without it (of another layout, or of hosts with few
pages) are read by their elements alone.

Pages whose text is the same, outside menus and the like, count as one, so that copies of an article do not make it a
template. A vector is kept as the exclusive or of a hash of (page, number) over the pages, beside the numbers of pages and
of occurrences: sums that Spark forms partially before the shuffle, whatever the size of a host.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import BROADCAST_ROWS, batches, materialise, texts

#: A class is frequent on this share of the host's pages, and on this many pages; a slot holds the article if it has this
#: share of the text around it; what text counts in an element that a page repeats (comments, lists of other articles).
FREQUENT, LEAST, MOSTLY, AGAIN = 0.5, 3, 0.6, 0.25

#: Fixed values from the HTML standard: elements without content, without a box of their own, without text to read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
UNREAD = frozenset("script style noscript template iframe svg math object canvas audio video head title textarea select option datalist button form nav footer aside dialog menu".split())
MAIN = frozenset(("article", "main"))
#: Elements that end an open one of the same kind, up to the container that holds them.
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
HOLDS = frozenset("ul ol dl table tbody thead div section article main aside nav header footer body blockquote".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words in class, id or role by which pages name what is not their text, and what is.
ASIDE = frozenset(
    "ad ads advert advertisement adverts advertising alert aside banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disclaimer discussion footer footnav gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup privacy promo promoted promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
CONTENT = frozenset("article articlebody main content maincontent post postbody entry story".split())
#: Elements that are part of a text and can't hold an article.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl tr td th pre address figure hr".split())
#: Words that leave the meaning of the word beside them as it is (comments-section, ad-box).
NEUTRAL = frozenset("area bar block body bottom box button buttons col column container content form group holder id inner item items left link links list outer panel region right row section slot top unit widget wrap wrapper".split())
#: After these words a class or id tells what a layout has or lacks, not what the element is (no-sidebar, page-with-menu).
LAYOUT = frozenset("no not without has have with hide".split())

TOKEN = regex.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*>""",
    regex.S | regex.I,
)
NAMES = regex.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
PIECE = regex.compile(r"[^\W_]+")
SPACE = regex.compile(r"\s+")


@dataclass
class Element:
    name: str
    path: int
    unread: bool
    named: bool
    main: bool
    wrapped: bool = False
    seen: dict[str, int] | None = None


@dataclass
class Block:
    """A run of text with the place that it stands in; holder is the innermost element that is not a paragraph.

    wrapped: in an article whose wrapper has a word of ASIDE; it is read if the page has no other article.
    """

    place: int
    holder: int
    aside: bool
    main: bool
    text: str
    linked: int
    wrapped: bool


@dataclass
class Page:
    """Numbers of tokens, what each stands in, the blocks, the elements that may hold an article (1; 2 if they say that
    they do; 3 for the frame of every page), and how many first headings stand below each element."""

    tokens: Counter = field(default_factory=Counter)
    parents: dict[int, int] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    holds: dict[int, int] = field(default_factory=dict)
    titles: Counter = field(default_factory=Counter)

    def above(self, place: int) -> list[int]:
        """The place and all around it, but for the page itself."""
        chain = []
        while place:
            chain.append(place)
            place = self.parents.get(place, 0)
        return chain


def _hash(*parts: object) -> int:
    return xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), 7) >> 1


def meaning(attributes: str) -> tuple[list[str], set[str], set[str], set[str]]:
    """(words of class, id and role; those that say what the element is; the first of each name; those of names that are
    of ASIDE and NEUTRAL words only)."""
    return names_mean(tuple(got[1] or got[2] or got[3] or "" for got in NAMES.finditer(attributes)))


@lru_cache(1 << 14)
def names_mean(names: tuple[str, ...]) -> tuple[list[str], set[str], set[str], set[str]]:
    """What the values of class, id and role mean; pages of a host share most of them."""
    words, means, first, alone = [], set(), set(), set()
    for name in names:
        for one in name.lower().split():
            parts = PIECE.findall(one)
            words += parts
            first.update(parts[:1])
            told = parts[: next((k for k, w in enumerate(parts) if w in LAYOUT), len(parts))]
            means.update(told)
            if all(w in ASIDE or w in NEUTRAL or w.isdecimal() for w in told):
                alone.update(told)
    return words, means, first, alone


def parse(source: str) -> Page:
    """The tokens of a page and its blocks of text; what is not closed is closed as the standard would."""
    page, stack = Page(), [Element("", 0, False, False, False)]
    pieces: list[str] = []
    linked = anchor = muted = 0
    mute = ""

    def flush() -> None:
        nonlocal linked, muted
        muted = 0
        text = SPACE.sub(" ", "".join(pieces)).strip()
        pieces.clear()
        if text:
            top = stack[-1]
            holder = next((e for e in reversed(stack) if e.name not in ENDS_P or e.name in HOLDS), stack[0])
            page.blocks.append(Block(top.path, holder.path, top.unread or top.named, top.main, text, min(linked, len(text)), top.wrapped and not top.unread))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if muted:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if anchor:
            linked += len(text.strip())

    def close(at: int) -> None:
        flush()
        del stack[at:]

    last = 0
    for token in TOKEN.finditer(source):
        if token.start() > last:
            add(source[last : token.start()])
        last = token.end()
        name = (token[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if muted:
                muted += (name == mute) * (-1 if token[2] else 1)
            elif not token[2] and "=" in token[4] and not ASIDE.isdisjoint(meaning(token[4])[3 if stack[-1].main else 1]):
                muted, mute = 1, name
            if name == "a":
                anchor = 0 if token[2] else 1
            continue
        if token[2]:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if at:
                close(at)
            else:
                flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        if name in ENDS_P and stack[-1].name == "p":
            stack.pop()
        ended = CLOSES.get(name)
        if ended:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ended:
                    close(k)
                    break
                if stack[k].name in HOLDS:
                    break
        words, means, first, alone = meaning(token[4]) if "=" in token[4] else ((), frozenset(), frozenset(), frozenset())
        up = stack[-1]
        # Siblings without class, id and role are told apart by their turn, but for the parts of a text.
        turn = []
        if not words and name not in PARTS:
            up.seen = up.seen or {}
            up.seen[name] = nth = up.seen.get(name, 0) + 1
            turn = [f"#{nth}"] if nth > 1 else []
        path = _hash(up.path, name, *sorted(set(words)), *turn)
        content = name in MAIN or not CONTENT.isdisjoint(means)
        # An article may be about a word of ASIDE, as a part of it may (related-work, alert-text); its header is a part of
        # it, and a quotation in it stays whatever its name.
        told = first if name in MAIN else (frozenset() if name == "blockquote" else alone) if up.main else means
        named = name not in ("html", "body") and not ASIDE.isdisjoint(w for w in told if w != "header" or not up.main)
        unread = up.unread or name in UNREAD or (name == "header" and not up.main)
        wrapped = not named and (up.wrapped or (up.named and content))
        page.tokens[path] += 1
        page.parents[path] = up.path
        page.holds[path] = 0 if name in PARTS else 3 if name in ("html", "body") else 2 if content else 1
        if name == "h1":
            page.titles.update(page.above(path))
        stack.append(Element(name, path, unread, up.named or named, up.main or content, wrapped))
    if last < len(source):
        add(source[last:])
    flush()
    if not any(b.main and not b.aside for b in page.blocks):
        for block in page.blocks:
            block.aside = block.aside and not block.wrapped
    for block in page.blocks:
        token = _hash(block.place, "#", block.text)
        page.tokens[token] += 1
        page.parents[token] = block.place
    return page


def host_of(url):
    """The host of a URL column, in lower case; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def body_of(page: Page) -> int:
    """A hash of a page's text: its blocks outside asides, or all where there is none."""
    own = [b for b in page.blocks if not b.aside] or page.blocks
    return _hash("body", *[part for b in own for part in (b.place, b.text)])


def masses(page: Page) -> Counter:
    """How much text stands in and below each element, without links and asides; less where its holder is repeated."""
    found: Counter = Counter()
    for b in page.blocks:
        if not b.aside:
            mass = (len(b.text) - b.linked) * (1 if page.tokens[b.holder] <= 1 else AGAIN)
            for at in page.above(b.place):
                found[at] += mass
            found[0] += mass
            found[_hash(b.place, "#", b.text)] += 0 if b.main else mass  # an article is no template, even if it is repeated
    return found


TOKENS = "host long, body long, token long, parent long, number int, holds int, titles int, mass double"


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row of TOKENS for each token of pages (host, html); token 0 stands for the page itself, holds is -1 for blocks."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.float64()], strict=True)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for k in range(0, whole.num_rows, 500):
                part = whole.slice(k, 500)
                rows: list[tuple] = []
                for host, source in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    page = parse((source or b"").decode("utf-8", "replace"))
                    body, mass = body_of(page), masses(page)
                    rows += [(host, body, t, page.parents[t], n, page.holds.get(t, -1), page.titles[t], float(mass[t])) for t, n in page.tokens.items()]
                    rows.append((host, body, 0, 0, 1, 3, 0, float(mass[0])))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield batches(dict(zip(names, columns, strict=True)), schema)

    return pages.select("host", "html").mapInArrow(run, TOKENS)


def decide(tokens: list[dict], total: int) -> tuple[int, list[int]]:
    """(main, repeated) of a host, from its frequent tokens: the element that holds the article (0 if none does), and
    the blocks of text that belong to the template."""
    classes: dict[tuple, list[dict]] = {}
    for t in tokens:
        if t["token"]:
            classes.setdefault((t["vector"], t["pages"], t["number"]), []).append(t)
    valid = [c for c in classes.values() if len(c) > 1]
    inside = {t["token"]: t for c in valid for t in c if t["holds"] >= 0}

    def nested(token: int) -> bool:
        while token:
            if token not in inside:
                return False
            token = inside[token]["parent"]
        return True

    template = {k: t for k, t in inside.items() if nested(k)}
    repeated = [t for c in valid if any(t["token"] in template for t in c) for t in c if t["holds"] < 0 and nested(t["parent"])]
    mass = {k: t["mass"] for k, t in template.items()} | {0: sum(t["mass"] for t in tokens if not t["token"])}
    for t in repeated:
        at = t["parent"]
        while True:
            mass[at] -= t["mass"]
            if not at:
                break
            at = template[at]["parent"]
    main = 0
    while True:
        titled = main and template[main]["holds"] < 3 and 2 * template[main]["titles"] >= total
        below = [t for t in template.values() if t["parent"] == main and t["holds"] and mass[t["token"]] > 0 and mass[t["token"]] >= MOSTLY * mass[main] and (t["holds"] == 3 or t["number"] == t["pages"])]
        below = [t for t in below if not titled or 2 * t["titles"] >= total]
        if not below:
            break
        main = max(below, key=lambda t: (mass[t["token"]], t["holds"], t["token"]))["token"]
    return main if main and template[main]["holds"] < 3 else 0, sorted(t["token"] for t in repeated)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, repeated): the element that holds the articles of each host, and its template's blocks of text.

    Tokens are counted over the host's pages, of which those with the same text count as one. Those on the share
    FREQUENT of the pages and on LEAST pages make the template: they are no more than a few pages have, however many
    pages the host has, so that one task can take a host's.
    """
    tokens = page_tokens(pages).groupBy("host", "token", "body").agg(*[F.max(c).alias(c) for c in ("parent", "holds", "titles", "number", "mass")])
    tokens = tokens.groupBy("host", "token").agg(
        *[F.max(c).alias(c) for c in ("parent", "holds")], *[F.sum(c).alias(c) for c in ("titles", "number", "mass")], F.count("*").alias("pages"), F.bit_xor(F.xxhash64("body", "number")).alias("vector")
    )
    tokens = materialise(tokens.where((F.col("pages") >= LEAST) | (F.col("token") == 0)), "tokens")
    totals = tokens.where("token = 0").select("host", F.col("pages").alias("total"))
    often = tokens.join(totals, "host").where((F.col("pages") >= FREQUENT * F.col("total")) & (F.col("total") >= LEAST))
    hosts = often.groupBy("host").agg(F.first("total").alias("total"), F.collect_list(F.struct("token", "parent", "holds", "titles", "number", "mass", "pages", "vector")).alias("tokens"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(host, *decide(sorted(tokens_, key=lambda t: t["token"]), total)) for host, total, tokens_ in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
            host, main, repeated = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, type=pa.int64()), pa.array(main, type=pa.int64()), pa.array(repeated, type=pa.list_(pa.int64()))], ["host", "main", "repeated"])

    return hosts.mapInArrow(run, "host long, main long, repeated array<long>")


def main_text(source: str, main: int = 0, repeated: frozenset | set = frozenset()) -> str:
    """The text of a page, given its host's template.

    Where the page has the template's main element, its blocks below it make the text, but for asides and for text that
    the template repeats. Elsewhere the blocks in an article or main element count if there are any, else those in
    holders whose text is mostly not links. Repeated text goes as well, but never all that an article has.
    """
    page = parse(source)
    own = [b for b in page.blocks if not b.aside]
    if main in page.tokens:
        inside = [b for b in own if main in page.above(b.place)]
        left = [b for b in inside if _hash(b.place, "#", b.text) not in repeated]
        # The repeated text of an article or main element stays if it has no other.
        kept = left if any(b.main for b in left) else [b for b in inside if b.main or b in left]
        if kept:
            return " ".join(b.text for b in kept)
    spared = not any(b.main and _hash(b.place, "#", b.text) not in repeated for b in own)
    left = [b for b in own if (spared and b.main) or _hash(b.place, "#", b.text) not in repeated]
    if any(b.main and not b.wrapped for b in left):
        left = [b for b in left if b.main]
    size: Counter = Counter()
    links: Counter = Counter()
    for b in left:
        size[b.holder] += len(b.text)
        links[b.holder] += b.linked
    return " ".join(b.text for b in left if b.main or 2 * links[b.holder] <= size[b.holder])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per page: the id and url columns and text, empty where there is none.

    A null html is empty; a null url or one without a host belongs to the host '' whose pages share a template like any
    other; hosts of fewer than LEAST pages have no template, and their pages are read by their elements alone. Repeated
    rows are pages of their own, an empty table gives none, other columns are not read. The table of templates is
    broadcast if counted to be small, else joined by host, where Spark splits a skewed host.
    """
    host = F.xxhash64(host_of(F.col(url_col)))
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    found = templates(keyed.select("host", "html")).checkpoint()
    known = found.withColumnRenamed("host", "__host")
    size = found.agg(F.sum(1 + F.size("repeated"))).first()[0] or 0
    if size <= 10 * broadcast_rows:
        known = F.broadcast(known)
    joined = keyed.join(known, F.col("host") == F.col("__host"), "left").select("id", "url", "host", "html", "main", "repeated")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[int, set]] = {}
        for whole in parts:
            for k in range(0, whole.num_rows, 200):
                part = whole.slice(k, 200)
                out = []
                for i, (where, source) in enumerate(zip(part.column(2).to_pylist(), texts(part.column(3)), strict=True)):
                    if where not in sets:
                        if len(sets) > 1000:
                            sets.clear()
                        sets[where] = (part.column(4)[i].as_py() or 0, set(part.column(5)[i].as_py() or ()))
                    out.append(main_text((source or b"").decode("utf-8", "replace"), *sets[where]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, type=pa.string())], ["id", "url", "text"])

    kind = dict(keyed.dtypes)["id"]
    return joined.mapInArrow(run, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op10_html(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
