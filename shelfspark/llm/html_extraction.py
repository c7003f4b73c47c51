"""Main text of web pages by a site style tree."""

from __future__ import annotations

import functools
import hashlib
import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.arrow_rows import text_rows, with_text_columns
from shelfspark.session import cut_lineage, table

#: A branch stays if its importance is at least this; how much of it presentation makes, the rest being content.
LEAST_IMPORTANCE, PRESENTATION = 0.3, 0.3
#: Pages that have a style node, from which a host's own entropies count; below, those of the node on all hosts do.
LEAST_PAGES = 4
#: Bytes of the style table (16 for a row) that are broadcast; a larger one is joined by host.
BROADCAST_BYTES = 32 << 20

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*|["'][^\s>]*))?)?)?""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "template", "textarea", "iframe", "title", "noembed", "noframes", "xmp")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul xmp".split())
#: An opening tag of the first kind ends an open element of the second kind.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCKS - {"p", "li", "dt", "dd", "tr", "td", "th", "option", "html", "body", "head"}}
#: Their own text is not read; an opening HTML tag of the second set ends them, as an unclosed <svg> does not hold the rest of a page.
UNREAD = frozenset("svg annotation annotation-xml".split())
BREAKOUT = (BLOCKS - {"title", "head", "html"}) | frozenset("b big br code em embed i img listing meta nobr ruby s small span strike strong sub sup tt u var".split())
SCOPES = frozenset("table ul ol dl select div section article main".split())
#: Roles of branches that are not an article's text: their presentation has no weight.
ASIDE_TAGS = frozenset("nav footer aside form button select dialog menu head search input".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
#: Class names: of lists of links, of the site's requests to readers, of text by others. A name is evidence: it weighs in
#: importance, and decides only with a second sign (``by_name``).
LINK_NAMES = frozenset("breadcrumb breadcrumbs menu nav navbar navigation pager pagination recommendations recommended related skip".split())
REQUEST_NAMES = frozenset("consent cookie cookies gdpr modal newsletter overlay popup promotion respond share sharebar sharing signup subscribe subscription".split())
FOREIGN_NAMES = frozenset("ad ads adsense adv advert advertisement advertising adverts commentlist comments disqus promo promobox sidebar sponsor sponsored".split())
PLAIN_NAMES = LINK_NAMES | REQUEST_NAMES | FOREIGN_NAMES
LOOSE_NAMES = frozenset("banner notice notices notification alert login social topbar footer header masthead comment replies reply toolbar widget widgets legal copyright disclaimer hidden".split())
#: Weights of names. With the first, texts that differ over a site's pages stay above LEAST_IMPORTANCE, whatever the layout.
NAME_WEIGHT, LOOSE_INSIDE = 0.55, 0.3
NO_KIND, LINKS, REQUEST, FOREIGN = range(4)
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"')\]\u00bb\u2019\u201d]*$")
#: First and last parts of longer names that say nothing of the branch itself, or that it is an article's.
NOT_ITSELF = frozenset("has with no without is js entry post article story page main content".split())
KINDS_OF = frozenset("area bar block body box bottom buttons button container content footer form group header icons inner item items left line links list main menu module nav outer panel region right row section slot strip text thread title top unit widget wrap wrapper zone".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|page)(?:[_-]?(?:body|content|text|main))?(?=$|[\s_-])", re.IGNORECASE)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Block:
    """A run of text, where it is in the page's style tree, and what its branches are: ``aside`` is the weight against
    them, 1 of roles, and ``kind`` what their names say."""

    __slots__ = ("article", "aside", "heading", "kind", "linked", "main", "parent", "path", "text")

    def __init__(self, text: str, path: int, parent: int, article: bool, main: bool, aside: float, kind: int, linked: int, heading: str):
        self.text, self.path, self.parent, self.article, self.main, self.aside, self.kind, self.linked, self.heading = text, path, parent, article, main, aside, kind, linked, heading


@functools.lru_cache(1 << 14)
def name_weight(names: str, inside: bool) -> tuple[float, int]:
    """The weight of class and id names against a branch, and their kind. A name counts whole, or as the first or last part of a longer one."""
    most, kind = 0.0, NO_KIND
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+|\d+", name) if x]
        if not parts or (len(parts) > 1 and parts[0] in NOT_ITSELF - {"page", "main", "content"}) or (len(parts) > 1 and parts[0] in NOT_ITSELF and parts[-1] == "header"):
            found = {parts[-1]} & {"comments", "commentlist", "ad", "ads"} if len(parts) > 1 and parts[0] in ("post", "entry", "article", "story") else set()
        else:
            found = {parts[-1]} | ({parts[0]} if all(x in KINDS_OF or x in PLAIN_NAMES for x in parts[1:]) else set())
        if found & PLAIN_NAMES:
            most = NAME_WEIGHT
            kind = max(kind, FOREIGN if found & FOREIGN_NAMES else REQUEST if found & REQUEST_NAMES else LINKS)
        elif found & LOOSE_NAMES:
            most = max(most, LOOSE_INSIDE if inside else NAME_WEIGHT)
    return most, kind


def _role(tag: str, attributes: dict[str, str], inside: bool) -> tuple[float, int, bool, str]:
    """(weight against it as article text, kind by name, likely main container, style) of an element. ``inside`` an article or main container, a header is its title."""
    aside, kind, main, style = float(tag in ASIDE_TAGS or (tag == "header" and not inside)), NO_KIND, False, tag
    if attributes:
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        if names:
            style = f"{tag}.{re.sub('[0-9]+', '#', attributes.get('class', ''))}"
            if tag not in ("html", "body", "article", "main"):
                weight, kind = name_weight(names, inside)
                aside = max(aside, weight)
            main = bool(MAIN_NAMES.search(names))
        role = attributes.get("role", "").lower()
        if role in ASIDE_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
            aside = 1.0
        main = main or role == "main" or attributes.get("itemprop", "") == "articleBody"
    return aside, kind, main, style


def tokens_of(page: str) -> Iterator[tuple[str, str, dict[str, str] | None, bool]]:
    """(kind, text or tag, attributes, self-closed) in order; kind: text, raw (not to be decoded), open, close.

    Each character is passed once: a tag ends at the first > outside quoted
    values; < without a later > is text, and so is a quote without a second one.
    """
    at, n = 0, len(page)
    last, quotes = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "text", page[at:], None, False
            return
        if lt > at:
            yield "text", page[at:lt], None, False
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            yield "text", "<", None, False
            at = lt + 1
            continue
        tag, at = m[0].lower(), m.end()
        attributes: dict[str, str] = {}
        while at <= last and page[at] != ">":
            m = ATTRIBUTE.match(page, at)
            if m.end() == at:
                at += 1
                continue
            if m[1] is not None:
                attributes.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
            at = m.end()
        if at > last:  # what looks like a tag has no end
            return
        slash = page[at - 1] == "/"
        at += 1
        yield ("close" if closing else "open"), tag, attributes, slash
        if not closing and tag in RAW:
            m = RAW[tag].search(page, at)
            end = m.start() if m else n
            if tag == "xmp":
                yield "raw", page[at:end], None, False
            at = end


def block_of(run: list[tuple[str, tuple]]) -> Block | None:
    """The block of the pieces of a run and their elements; None if it is white space."""
    text = " ".join(html_entities.unescape("".join(piece for piece, _ in run)).split())
    if not text:
        return None
    read = [(piece, top) for piece, top in run if not piece.isspace()]
    first = read[0][1]
    return Block(text, first[5], first[6], first[2], all(top[3] for _, top in read), first[1], first[8], sum(len(piece.strip()) for piece, top in read if top[4]), first[10])


def apart(block: Block | None) -> bool:
    """Whether a block's name has a second sign in its own text: half of it is links or, but for lists of links, it is no sentence."""
    if block is None:
        return True
    return 2 * block.linked >= len(block.text) or (block.kind != LINKS and not SENTENCE_END.search(block.text))


def by_name(block: Block) -> bool:
    """Whether a block's name and a second sign say that it is not an article's text, if the page has text of its own
    beside it: the sign of ``apart``, the name of text by others, or of a request outside of articles."""
    return block.kind != NO_KIND and (apart(block) or block.kind == FOREIGN or (block.kind == REQUEST and not block.article))


def blocks_of(page: str) -> Iterator[Block]:
    """The blocks of text of a page, in order. Open elements are a stack; a stray closing tag is left out.

    Each piece of a run of text keeps the flags of the element in which it is
    read; those of an inline aside are a block of their own, with its own path,
    but for a name without a second sign, which is part of the text around it.
    """
    # an element: tag, aside, article, main, link, path, parent's path, unread, kind, element around a named inline one, heading
    stack: list[tuple] = [("", 0.0, False, False, False, 0, 0, False, NO_KIND, None, "")]
    places: dict[str, list[int]] = {}
    parts: list[tuple[str, tuple]] = []

    def flush():
        named: dict[int, list[tuple[str, tuple]]] = {}
        for piece, top in parts:
            if top[9]:
                named.setdefault(top[5], []).append((piece, top))
        joined = {path for path, run in named.items() if not apart(block_of(run))}
        runs: dict[tuple[float, int], list[tuple[str, tuple]]] = {}
        kept = None
        for piece, top in parts:
            while top[9] and top[5] in joined:
                top = (*top[9][:4], top[4], *top[9][5:])
            run = runs.setdefault((top[1], top[5]), [])
            run.append((piece, top))
            if top[1] < 1 and not top[9]:
                kept = run
            elif kept is not None:
                kept.append((" ", top))
        parts.clear()
        for run in runs.values():
            if block := block_of(run):
                yield block

    def end(index: int):
        for e in stack[index:]:
            places[e[0]].pop()
        del stack[index:]

    def last_of(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    for kind, tag, attributes, closed in tokens_of(page):
        top = stack[-1]
        if kind == "text" or kind == "raw":
            if not top[7]:
                parts.append((html_entities.escape(tag) if kind == "raw" else tag, top))
            continue
        if top[7] and tag not in BREAKOUT and tag not in UNREAD:
            continue
        if kind == "open" and top[7] and tag in BREAKOUT:
            end(min(places[t][0] for t in UNREAD if places.get(t)))
        if tag in BLOCKS:
            yield from flush()
        elif tag == "br":
            parts.append((" ", stack[-1]))
        if kind == "close":
            # an inline element is not closed from inside a block that it holds
            if (i := last_of({tag})) and (tag in BLOCKS or i > last_of(BLOCKS)):
                end(i)
            continue
        if tag in VOID:
            continue
        if (closes := ENDS.get(tag)) and (i := last_of(closes)) and i >= last_of(SCOPES):
            end(i)
        if closed and tag not in BLOCKS:
            continue
        top = stack[-1]
        aside, named, main, style = _role(tag, attributes, top[2] or top[3])
        own = tag in BLOCKS or aside > top[1] or named > top[8]
        around = None if tag in BLOCKS or aside >= 1 else top if named > top[8] else top[9]
        path, parent = (paths(top[5], style), top[5]) if own else (top[5], top[6])
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, max(top[1], aside), top[2] or tag == "article", top[3] or main or tag == "main", top[4] or tag == "a", path, parent, top[7] or tag in UNREAD, max(top[8], named), around, tag if tag in HEADINGS else "" if tag in BLOCKS else top[10]))
    yield from flush()


@functools.lru_cache(1 << 14)
def paths(parent: int, style: str) -> int:
    return hash_path(parent, style)


def hash_path(parent: int, style: str) -> int:
    """A style node's number, from its parent's and its own tag and class; the same in every process."""
    return hash_text(f"{parent}>{style}")


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()) >> 1


def _entropy(n: str, nlogn: str):
    """Of counts with sum n and sum of n * log(n): 1 if all differ, 0 if all are the same."""
    total = F.col(n).cast("double")
    return F.when(F.col(n) >= LEAST_PAGES, (F.log(total) - F.col(nlogn) / total) / F.log(total))


def style_nodes(pages: DataFrame) -> DataFrame:
    """The site style trees: host, path, and importance of each style node that has text.

    Equal pages of a host count once. A node's content importance is the entropy
    of its texts over the pages that have it (1: all differ, 0: always the
    same). Its presentation importance is the entropy of the styles that its
    parent's branch shows, in their order. A host with fewer than LEAST_PAGES
    pages of a node takes the entropy of the node on all hosts; if these are too
    few as well, 1. The importance is their weighted mean, less the weight that
    roles and class names have against the branch and, outside articles, less
    the share of link text. Inside articles, those of a host with the same
    longest block count once, as articles may be published more than once, also
    with changes; links there take nothing, as they may be a title or
    references. Rows with a null host are one site.
    """
    hosts = pages.select(F.regexp_extract(F.lower(F.coalesce(F.col("url"), F.lit(""))), HOST, 1).alias("host"), "html")
    once = hosts.withColumn("page", F.xxhash64("html"))

    def make():
        def work(batch):
            if batch is None:
                return
            host, page = batch.column("host").to_pylist(), batch.column("page").to_pylist()
            rows = {}
            for h, p, body in zip(host, page, batch.column("_text").to_pylist(), strict=True):
                blocks = list(blocks_of(body or ""))
                longest = hash_text(max((b.text for b in blocks if b.article and b.aside < 1 and b.kind == NO_KIND), key=len, default=""))
                shown: dict[tuple[int, bool], list[int]] = {}
                for b in blocks:
                    key = (h, b.path, b.parent, longest if b.article else p, hash_text(b.text), True)
                    old = rows.get(key, (0, 0, 0.0, False))
                    rows[key] = (old[0] + len(b.text), old[1] + b.linked, old[2] + b.aside * len(b.text), b.article)
                    shown.setdefault((b.parent, b.article), []).append(b.path)
                for (parent, article), below in shown.items():
                    rows[h, parent, 0, longest if article else p, hash_text(repr(below)), False] = (0, 0, 0.0, article)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                columns = [*zip(*rows, strict=True), *zip(*rows.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "parent", "page", "value", "text", "chars", "linked", "aside", "article"])

        return work

    found = text_rows(once, "host string, path long, parent long, page long, value long, text boolean, chars long, linked long, aside double, article boolean", make, ["host", "page"], "html")
    # in steps, so that neither a large host nor a common text is one group
    sums = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("aside").alias("aside"), F.max("article").alias("article"), F.min("parent").alias("parent")]
    most = [F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.max("aside").alias("aside"), F.max("article").alias("article"), F.min("parent").alias("parent")]
    distinct = found.groupBy("host", "path", "text", "page", "value").agg(*most)
    values = cut_lineage(distinct.groupBy("host", "path", "text", "value").agg(F.count(F.lit(1)).alias("n"), *sums))
    n = F.col("n").cast("double")
    spread = [F.sum("n").alias("n"), F.sum(n * F.log(n)).alias("nlogn")]
    nodes = values.groupBy("host", "path", "text").agg(*spread, *sums)
    everywhere = values.groupBy("path", "text", "value").agg(F.sum("n").alias("n")).groupBy("path", "text").agg(*spread)
    everywhere = everywhere.select(F.col("path").alias("e_path"), F.col("text").alias("e_text"), _entropy("n", "nlogn").alias("everywhere"))
    nodes = nodes.join(everywhere, (F.col("path") == F.col("e_path")) & (F.col("text") == F.col("e_text")), "left").withColumn("entropy", F.coalesce(_entropy("n", "nlogn"), "everywhere", F.lit(1.0)))
    nodes = cut_lineage(nodes.select("host", "path", "text", "chars", "linked", "aside", "article", "parent", "entropy"))
    shown = nodes.filter("NOT text").select(F.col("host").alias("p_host"), F.col("path").alias("p_path"), F.col("entropy").alias("presentation"))
    nodes = nodes.filter("text").join(shown, (F.col("host") == F.col("p_host")) & (F.col("parent") == F.col("p_path")), "left")
    chars = F.greatest("chars", F.lit(1))
    links = F.when(F.col("article"), 0.0).otherwise(F.least(F.col("linked") / chars, F.lit(1.0)))
    asides = F.least(F.col("aside") / chars, F.lit(1.0))
    both = (1 - PRESENTATION) * F.col("entropy") + PRESENTATION * F.coalesce("presentation", "entropy")
    return nodes.select("host", "path", ((1 - asides) * (1 - links) * both).alias("importance"))


def main_text(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of a page that stay, joined by line ends: all but those whose role is not an article's text, branches in
    ``low``, and those of ``by_name``. Names drop nothing where the article, or the page, has no text without them. If
    the page has articles with more than headings and links, theirs; else those of its main containers if it has any. A
    heading in an article that is in ``low``, as its site repeats it, stays if text that stays follows it before the
    next heading: it names that text."""
    whole = [b for b in blocks_of(page) if b.aside < 1]
    own = {inside: any(b.kind == NO_KIND and not b.heading and b.path not in low and (b.article or not inside) for b in whole) for inside in (True, False)}
    whole = [b for b in whole if not (own[b.article] and by_name(b))]
    blocks, after = [], False
    for b in reversed(whole):
        stays = b.path not in low or (b.heading not in ("", "h1") and b.article and after)
        if stays:
            blocks.append(b)
        after = b.article and b.heading in ("", "h1") and (stays or (after and b.path in low))
    blocks.reverse()
    for inside in ("article", "main"):
        held = [b for b in blocks if getattr(b, inside)]
        if any(not b.heading and 2 * b.linked < len(b.text) for b in held):
            blocks = held
            break
    return "\n".join(b.text for b in blocks)


def extracted_pages(pages: DataFrame, keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add text (the main text; empty if none) and n_chars (its code points) to ``pages`` (url, html, ...).

    Columns: ``keep`` of ``pages`` (all by default, but not html and those named
    like the new ones), then the two. A null html is an empty page. A url
    without a host belongs to the site of all such urls. Repeated rows get the
    same result each; an empty table gives an empty one. Pages of any length are
    read in one pass, also broken ones. Other columns may have any name. Ties
    cannot arise. The style nodes of low
    importance are broadcast if there are few; else they are joined by host,
    where Spark may split a large host's pages.
    """
    names = [c for c in (keep or pages.columns) if c.lower() not in ("html", "text", "n_chars")]
    nodes = cut_lineage(style_nodes(pages).filter(F.col("importance") < LEAST_IMPORTANCE).select("host", "path"))
    size = nodes.agg(F.coalesce(F.sum(16 + F.length("host")), F.lit(0)).alias("n")).first()["n"]
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url"), F.lit(""))), HOST, 1)
    rows = pages.select(F.struct(*[pages[c] for c in names]).alias("row"), "html", host.alias("host"))
    if size <= broadcast_bytes:
        found = nodes.toArrow()  # broadcast_bytes at most
        sites = pages.sparkSession.sparkContext.broadcast((found.column("host").to_pylist(), found.column("path").to_pylist()))
        rows = rows.withColumn("low", F.lit(None).cast("array<long>"))
    else:
        sites = None
        by_host = nodes.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")).withColumnRenamed("host", "site")
        rows = rows.join(by_host, F.col("host") == F.col("site"), "left").drop("site")

    def make():
        known: dict[str, set[int]] = {}
        for h, path in zip(*sites.value, strict=True) if sites else ():
            known.setdefault(h, set()).add(path)

        def work(batch):
            texts = []
            for h, body, low in zip(batch.column("host").to_pylist(), batch.column("_text").to_pylist(), batch.column("low").to_pylist(), strict=True):
                texts.append(main_text(body or "", frozenset(low) if low is not None else known.get(h, frozenset())))
            return [pa.array(texts, pa.string()), np.array([len(t) for t in texts], np.int64)]

        return work

    return with_text_columns(rows, "text string, n_chars long", make, ["row"], "html", ["host", "low"]).select("row.*", "text", "n_chars")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_pages(table(spark, sf_dir, "pages"), ["page_id", "url"]).select("page_id", "url", "text", "n_chars")
