"""HTML main text by equivalence classes of tokens: pages of a host share a template, and its slots hold the text.

A page's tokens are its elements, each named by the path of open elements, and its blocks of text, each with the path it
stands under. Tokens that occur equally often on every page of a host form a class; classes of at least two tokens
that nest in one place of another make the template, and what lies between are its slots.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot, small, text_or_empty, trimmed
from .words import slices

#: Elements by what they do.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CHROME = frozenset("nav header footer aside form head menu dialog button select option fieldset".split())
MAIN = frozenset(("article", "main"))
#: An open element of these is closed by the start of another of its group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The start of these closes an open paragraph, too.
ENDS_P = frozenset("address article aside blockquote dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Whole class or id names that mark what isn't main text, anywhere.
CHROME_EXACT = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner sidebar nav navigation menu breadcrumb breadcrumbs footer masthead cookie-notice cookie-banner notice popup modal"
    " newsletter subscribe comment comments comment-list commentlist disqus disqus_thread respond share sharing social related widget toolbar pagination pager".split()
)
#: Words of a class or id that mark it outside main slots.
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|nav\w*|menu|breadcrumbs?|header|footer|masthead|cookies?|consent|notices?|popup|modal"
    r"|newsletter|subscribe|comments?|commentlist|disqus|respond|share|sharing|social|related|widget|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: An open element of these keeps what is outside it from being closed by the start of another element.
_HOLDS = frozenset(("ul", "ol", "table", "dl", "div", "article", "section", "td"))

#: How an element is marked: not at all, by a word of its name, or by its tag or its whole name.
PLAIN, WEAK, STRONG = 0, 1, 2


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _marked(tag: str, name: str) -> int:
    if tag in CHROME or name and any(n in CHROME_EXACT for n in name.lower().split()):
        return STRONG
    return WEAK if name and CHROME_NAMES.search(name) else PLAIN


def pieces(page: str):
    """A page in one pass: ("text", text), ("tag", end, tag, attributes) and ("raw", tag) for an element whose inside isn't markup.

    Comments and declarations are left out. A ">" inside quotes doesn't end a tag; once a quote is found that nothing
    closes, quotes mean nothing on the rest of the page. A "<" that starts no tag is text. Time is linear in the page.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if start > at:
            yield "text", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
        elif start > last:
            at = start
            break
        elif m := _TAG.match(page, start):
            close = quotes and _ATTRIBUTES.match(page, m.end())
            quotes = bool(close)
            end = close.end() - 1 if close else page.find(">", m.end())
            tag, at = m[2].lower(), end + 1
            if tag in _RAW_END and not m[1]:
                found = _RAW_END[tag].search(page, at)
                at = found.end() if found else len(page)
                yield "raw", tag
            else:
                yield "tag", bool(m[1]), tag, page[m.end() : end]
        elif page[start + 1] in "!?/":
            at = page.find(">", start) + 1
        else:
            yield "text", "<"
            at = start + 1
    if at < len(page):
        yield "text", page[at:]


def walk(page: str):
    """What a page holds in order: ("open", path, depth, tag, mark, parent), ("close", depth), ("break",) and ("text", path, text).

    A path is a 64-bit hash of the open elements other than inline ones, with their class, id and role. Missing end tags
    are implied as browsers do for paragraphs, lists and tables; an end tag without its start is ignored. Where the open
    elements of each tag are is kept, so no step searches the stack.
    """
    stack: list[tuple[str, int]] = [("", 0)]
    places: dict[str, list[int]] = defaultdict(list)
    holds = [0]

    def cut(depth: int) -> None:
        while len(stack) > depth:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag in _HOLDS:
                holds.pop()

    for piece in pieces(page):
        if piece[0] == "text":
            yield "text", stack[-1][1], piece[1]
        elif piece[0] == "raw":
            yield ("text", stack[-1][1], " ") if piece[1] in ("svg", "noscript") else ("break",)
        elif (tag := piece[2]) == "br":
            yield "text", stack[-1][1], " "
        elif tag in INLINE:
            pass
        elif piece[1]:
            if places.get(tag):
                depth = places[tag][-1]
                cut(depth)
                yield "close", depth
            elif tag == "p":
                yield ("break",)
        else:
            closed = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else set())
            depth = max((places[t][-1] for t in closed if places.get(t)), default=0)
            # a holder that is itself closed by the tag doesn't protect itself
            if depth and depth >= holds[-1]:
                cut(depth)
                yield "close", depth
            attributes = piece[3]
            name = " ".join(filter(None, (g for x in _NAME.findall(attributes) for g in x))) if "=" in attributes else ""
            parent = stack[-1][1]
            path = _hash(parent.to_bytes(8, "little", signed=True), tag.encode(), name.encode(errors="replace"))
            depth = len(stack)
            yield "open", path, depth, tag, _marked(tag, name), parent
            if tag not in VOID and not attributes.endswith("/"):
                stack.append((tag, path))
                places[tag].append(depth)
                if tag in _HOLDS:
                    holds.append(depth)
            else:
                yield "close", depth


def tidy(run: list[str]) -> str:
    return " ".join(htmllib.unescape("".join(run)).split())


def block_token(path: int, text: str) -> int:
    return _hash(b"text", path.to_bytes(8, "little", signed=True), text.encode(errors="replace"))


def tokens(page: str) -> dict[int, list]:
    """token -> [times on the page, parent path, is an element, is an article or main element, mark, characters directly inside]."""
    found: dict[int, list] = {}
    run: list[str] = []
    under = 0

    def flush():
        if text := tidy(run):
            x = found.setdefault(block_token(under, text), [0, under, False, False, PLAIN, 0])
            x[0] += 1
            x[5] += len(text)
            if under in found:
                found[under][5] += len(text)
        run.clear()

    for e in walk(page):
        if e[0] == "text":
            if not run:
                under = e[1]
            run.append(e[2])
        else:
            flush()
            if e[0] == "open":
                x = found.setdefault(e[1], [0, e[5], True, e[3] in MAIN, e[4], 0])
                x[0] += 1
    flush()
    return found


#: On so many pages of different content a text is part of the template even inside an article.
SUPPORT = 8

#: Three sums of this many bits name an occurrence vector; so many of them add up to less than 63 bits.
LANE = 36
STATS = "host string, token long, parent long, element boolean, main boolean, mark int, pages long, chars long, a long, b long, c long"


def token_vectors(pages: DataFrame, held: int = 200_000) -> DataFrame:
    """(host, token, ...): on how many of its host's pages a token occurs, its characters, and its occurrence vector.

    The vector of how often a token occurs on each page is told by three sums, over all its occurrences, of a page's
    random numbers: equal vectors have equal sums, others don't but for chance. Sums are exact however rows are dealt and
    whatever a worker holds: it adds up to ``held`` tokens before it passes them on. The token 0 stands for the page.
    """

    def run(batches):
        seen: dict = {}

        def flush():
            keys, rows = list(seen), list(seen.values())
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
            cols += [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            cols += [pa.array([r[i] & (1 << LANE) - 1 for r in rows], pa.int64()) for i in (6, 7, 8)]
            seen.clear()
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in STATS.split(", ")])

        for b in slices(batches, 500, 3):
            for host, x, y, page in zip(*(c.to_pylist() for c in b.columns)):
                numbers = (x & (1 << LANE) - 1, y & (1 << LANE) - 1, (x >> LANE & (1 << 27) - 1) << 9 | y >> LANE & 511)
                found = tokens(page)
                found[0] = [1, 0, False, False, PLAIN, 0]
                for token, (times, parent, element, main, mark, chars) in found.items():
                    s = seen.setdefault((host, token), [parent, element, main, mark, 0, 0, 0, 0, 0])
                    s[4] += 1
                    s[5] += chars
                    for i, n in enumerate(numbers):
                        s[6 + i] += n * times
            if len(seen) > held:
                yield flush()
        if seen:
            yield flush()

    whole = F.xxhash64("page_id", "url", "html")
    rows = pages.select("host", whole.alias("x"), F.xxhash64(F.lit("other"), whole).alias("y"), "html").mapInArrow(trimmed(run), STATS)
    first = [F.min(c).alias(c) for c in ("parent", "element", "main", "mark")]
    lanes = [F.pmod(F.sum(c), F.lit(1 << LANE)).alias(c) for c in "abc"]
    return rows.groupBy("host", "token").agg(*first, F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), *lanes)


def deduce(rows: list[dict]) -> tuple[list[int], list[int], bool]:
    """The template of a host from its frequent tokens: (slots, fixed texts, whether article or main elements name the slots).

    A class holds at least two tokens of one occurrence vector, one of them an element. It is valid if the elements that
    it starts with all stand in the same class above, the place where it nests. The slots are elements of valid classes:
    the outermost article or main elements among them; without any, the innermost one that has most of the text which
    isn't fixed. Fixed texts are those of valid classes; inside slots that a tag names they count from SUPPORT pages on.
    """
    by_vector = defaultdict(list)
    at = {r["token"]: r for r in rows}
    for r in rows:
        by_vector[r["pages"], r["a"], r["b"], r["c"]].append(r)
    group = {r["token"]: k for k, own in by_vector.items() if len(own) > 1 and any(r["element"] for r in own) for r in own}
    above: dict[tuple, int] = {}

    def ancestor(token: int, without) -> int:
        """The nearest element above that is in a class other than ``without``, 0 if there is none."""
        way, up = [], at[token]["parent"]
        while up in at and (group.get(up) is None or group[up] == without):
            if (up, without) in above:
                up = above[up, without]
                break
            way.append(up)
            up = at[up]["parent"]
        up = up if up in at else 0
        for t in way:
            above[t, without] = up
        return up

    for k, own in sorted(by_vector.items(), key=lambda x: (-x[0][0], x[0])):
        if own[0]["token"] in group:
            places = {group.get(ancestor(r["token"], k)) for r in own if r["element"]}
            if len(places) > 1:
                for r in own:
                    del group[r["token"]]
                above.clear()
    fixed = sorted(t for t in group if not at[t]["element"])
    marked: dict[int, bool] = {}

    def beneath(token: int, test, known: dict) -> bool:
        """Whether an element, or one above it, passes the test."""
        way = []
        while token in at and token not in known:
            way.append(token)
            if test(at[token]):
                known[token] = True
                break
            token = at[token]["parent"]
        answer = known.get(token, False)
        for t in way:
            known[t] = answer
        return answer

    elements = sorted(t for t, r in at.items() if r["element"])
    chrome = {t for t in elements if beneath(t, lambda r: r["mark"] != PLAIN and not r["main"], marked)}
    inside: dict[int, bool] = {}
    main = [t for t in elements if at[t]["main"] and t in group and t not in chrome and not beneath(at[t]["parent"], lambda r: r["main"], inside)]
    if main:
        return main, [t for t in fixed if at[t]["pages"] >= SUPPORT], True
    text = {t: at[t]["chars"] for t in elements if t not in chrome}
    for t in fixed:
        if at[t]["parent"] in text:
            text[at[t]["parent"]] -= at[t]["chars"]
    depth: dict[int, int] = {}
    for t in elements:
        way = []
        while t in at and t not in depth:
            way.append(t)
            t = at[t]["parent"]
        n = depth.get(t, 0)
        for i, u in enumerate(reversed(way), 1):
            depth[u] = n + i
    total, under = sum(text.values()), defaultdict(int, text)
    for t in sorted(elements, key=depth.get, reverse=True):
        under[at[t]["parent"]] += under[t]
    fit = [t for t in elements if t in group and t not in chrome and total > 0 and under[t] >= 0.8 * total]
    return ([max(fit, key=lambda t: (depth[t], t))] if fit else []), fixed, False


def templates(vectors: DataFrame, least: float) -> DataFrame:
    """(host, of_, slots, fixed, by_tag): the template of each host, from its tokens on at least ``least`` of its pages,
    and on two. So many pages hold each of them that a host has at most 1 / least times the tokens of a page."""
    hosts = vectors.where(F.col("token") == 0).select("host", F.col("pages").alias("of_"))
    often = vectors.where((F.col("token") != 0) & (F.col("pages") > 1)).join(hosts, "host").where(F.col("pages") >= least * F.col("of_")).drop("of_")

    def run(t: pa.Table) -> pa.Table:
        slots, fixed, by_tag = deduce(t.drop(["host"]).to_pylist())
        return pa.table({"host": t["host"][:1], "slots": pa.array([slots], pa.list_(pa.int64())), "fixed": pa.array([fixed], pa.list_(pa.int64())), "by_tag": pa.array([by_tag])})

    found = often.groupBy("host").applyInArrow(run, "host string, slots array<long>, fixed array<long>, by_tag boolean")
    return hosts.join(found, "host", "left")


def extract(page: str, slots: set[int] = frozenset(), fixed: set[int] = frozenset()) -> str:
    """The text in a page's slots, without elements marked strongly.

    A page that has none of the host's slots uses its own article or main elements. One without those, too, gives what
    stands outside marked elements. Blocks that are fixed on the host go, unless nothing would stay.
    """
    events = list(walk(page))
    here = {e[1] for e in events if e[0] == "open"} & slots
    if not here:
        here = {e[1] for e in events if e[0] == "open" and e[3] in MAIN}
    blocks: list[tuple[str, bool]] = []
    run: list[str] = []
    out, into, under = 0, 0, 0

    def flush():
        if run and (text := tidy(run)):
            blocks.append((text, block_token(under, text) in fixed))
        run.clear()

    for e in events:
        if e[0] == "text":
            if not out and (into or not here):
                under = under if run else e[1]
                run.append(e[2])
            continue
        flush()
        if e[0] == "open":
            if e[1] in here and not into:
                into = e[2]
            elif not out and e[3] not in MAIN and (e[4] == STRONG or e[4] == WEAK and not into):
                out = e[2]
        elif e[0] == "close":
            out = 0 if out >= e[1] else out
            into = 0 if into >= e[1] else into
    flush()
    kept = [text for text, is_fixed in blocks if not is_fixed] or [text for text, _ in blocks]
    return "\n".join(kept)


def different(pages: DataFrame, work: Scratch) -> DataFrame:
    """One page of each content of a host: a page that is copied over a host says nothing about its template, and its
    text would look like a part of it. The content is what ``extract`` gives without a template.

    Rows that repeat a page are alike in every column, so none of them can be told from the others: they stay, as each
    page does if all are there twice, unless they come to more than a twentieth of the host's contents; then all go.
    Only digests are exchanged; what goes back to the pages are the keys of those that go, by broadcast where they are few.
    """

    def run(batches):
        for b in slices(batches, 500, 3):
            texts = pa.array([_hash(extract(page).encode(errors="replace")) for page in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], texts], names=["host", "x", "y", "content"])

    whole = F.xxhash64("page_id", "url", "html")
    keys = [whole.alias("x"), F.xxhash64(F.lit("other"), whole).alias("y")]
    contents = work.keep(pages.select("host", *keys, "html").mapInArrow(trimmed(run), "host string, x long, y long, content long"), "contents")
    rows = contents.groupBy("host", "content", "x", "y").agg(F.count("*").alias("n"))
    first = rows.groupBy("host", "content").agg(F.min(F.struct("x", "y", "n")).alias("first"))
    stay = first.join(first.groupBy("host").agg(F.count("*").alias("of_")), "host").where((F.col("first.n") == 1) | (20 * F.col("first.n") <= F.col("of_")))
    gone = work.keep(rows.select("x", "y").join(stay.select("first.x", "first.y"), ["x", "y"], "left_anti"), "copies")
    return pages.withColumns({"x": keys[0], "y": keys[1]}).join(small(gone, 1_000_000), ["x", "y"], "left_anti").select(*pages.columns)


def main_text(pages: DataFrame, least: float = 0.5, most_hosts: int = 20_000) -> DataFrame:
    """One row per page: page_id, url and the main text, its blocks joined by newlines.

    Tokens are counted exactly by host, their occurrence vectors make classes, valid classes the host's template, and the
    template's slots hold the text; ``deduce`` and ``extract`` say how. Class and id names count as words outside slots
    and by the whole name inside. A host with one page has no template. Templates are broadcast up to ``most_hosts``
    hosts; of more, those with very many pages are, and the others are joined by host. The result depends on the table
    alone, not on how its rows are dealt.

    Null and empty html give the empty text; a null url, or one without a host, belongs to the host ''. Null and repeated ids stay as they are; extra columns are ignored; an empty table
    gives an empty one.
    """
    work = Scratch(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"), host.alias("host"))
    found = work.keep(templates(work.keep(token_vectors(different(base, work)), "vectors"), least), "templates")

    def run(batches):
        held: dict = {}
        for b in slices(batches, 500, 3):
            out = []
            for host, page, slots, fixed in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                if host not in held:
                    if len(held) > 500:
                        held.clear()
                    held[host] = set(slots.as_py() or ()), set(fixed.as_py() or ())
                out.append(extract(page, *held[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    few = found.limit(most_hosts + 1).count() <= most_hosts
    x = base.join(small(found, most_hosts), "host", "left") if few else join_hot(base, found, "host", "of_", base.count())
    return x.select("page_id", "url", "host", "html", "slots", "fixed").mapInArrow(trimmed(run), "page_id long, url string, text string")
