"""HTML extraction: the main text of pages, with repeated boilerplate found by suffix arrays over each host's token streams.

Markup that names its role decides first: an ``article`` or ``main`` element is the text, and navigation, forms, adverts,
comments and the like are not. Every block that markup leaves open is judged by repetition over a share of the host's
pages. All blocks of every page, those of main parts too, are one stream of tokens; a suffix array sorted to the depth of a long
substring brings equal ones together, and a block that is as long is boilerplate when most of it (two thirds) is covered by
substrings that so many distinct pages hold. A shorter block is boilerplate when so many pages hold it as a
whole block, or hold it in the same row of three short blocks, as in a menu.
"""
import html
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.scale import attach
from ..session import materialise, stored_rows
from .shingles import MULTIPLIERS, combined, mixed, word_hashes, words_of

# Tokens of a long substring (a power of two), covered share of a block; tokens from which a shorter block is judged by itself, short
# blocks in a row that are judged together.
DEPTH, COVERED, LEAST, ROW = 32, 2 / 3, 4, 3
# Share of a host's distinct pages that must hold what is boilerplate, and pages at least.
SHARE, PAGES = 1 / 3, 5
# Pages of a host whose streams one suffix array holds. What it finds is counted over all pages, so the number does not matter to the result.
SHARD = 256
# Bits of a hash by which most of those that are not looked for are left out before a join.
MARKS = 20
# Pages whose substrings are hashed at once.
PAGES_AT_ONCE = 32

URL_HOST = r"(?s)^.*?://([^/?#]*)"
# possessive, so that no broken tag is tried again from every place
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
# Elements by their role in a page.
HIDDEN = frozenset("script style noscript template iframe svg math object select textarea head title canvas audio video".split())
CHROME = frozenset("nav footer aside form button menu dialog".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
# Elements that a new block of the same list ends, since their end tags may be left out.
SELF_CLOSING = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
                "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                   "section table ul".split())
ROLES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb "
                  "breadcrumbs header masthead footer sidebar aside widget related cookie cookies consent notice popup modal newsletter "
                  "subscribe signup login share sharing social comment comments disqus replies navigation contentinfo complementary search "
                  "dialog alert".split())
# Names that say something else inside an article, and elements whose names style the whole page.
INSIDE_FINE, WHOLE = frozenset("header masthead banner".split()), frozenset("html body main".split())
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Roles under whose names an article is not the text of the page, and words that a name may hold beside its role (site-footer).
OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus replies".split())
BESIDE = frozenset("site main page top bottom global primary secondary list item area section block box bar slot unit container wrapper wrap "
                   "inner body text thread form author meta".split())
WORDS = re.compile(r"(?<![a-z0-9])[a-z]+")
# NAMED and OTHER are dropped for their names alone and may hold the main part, OTHER as a comment or an advert.
CONTENT, OPEN, DROPPED, NAMED, OTHER = 2, 1, 0, -1, -2


def roles_of(attributes):
    """Role words of the element's class, id and role: names that hold nothing else but words that say where the role is."""
    found = set()
    for groups in NAMES.findall(attributes) if "=" in attributes else ():
        for name in " ".join(groups).lower().split():
            words = set(WORDS.findall(name))
            if words <= ROLES | BESIDE:
                found |= words & ROLES
    return found


def role_in(name, attributes, role):
    """Role of an element that stands in one of ``role``: by its own name, or by its class, id or role."""
    if role == DROPPED or name in CHROME or (name == "header" and role != CONTENT):
        return DROPPED
    if role in (NAMED, OTHER):
        # a name is weaker evidence than a main part, unless that is itself a comment or an advert
        if roles_of(attributes) & OTHERS:
            return OTHER
        return CONTENT if name == "main" or (name == "article" and role == NAMED) else role
    if not (name in WHOLE or (name == "article" and role != CONTENT)):
        words = roles_of(attributes) - (INSIDE_FINE if role == CONTENT else frozenset())
        if words:
            return DROPPED if role == CONTENT else OTHER if words & OTHERS else NAMED
    return CONTENT if name in MAIN else role


def page_blocks(page):
    """Blocks of a page in order as (role, text), white space made single and references decoded; whether it has a main part."""
    stack, found, held = [], [], []
    muted, main, at, standing = None, False, 0, Counter()
    last = page.rfind(">")

    def flush():
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            found.append((max(stack[-1][1], DROPPED) if stack else OPEN, text))

    while at <= last:
        m = TAG.search(page, at)
        if not m:
            break
        if not muted:
            held.append(page[at:m.start()])
        at = m.end()
        if not m.group(2):
            continue
        name, ends, attributes = m.group(2).lower(), bool(m.group(1)), m.group(3)
        if name in INLINE:
            if name == "br":
                held.append(" ")
            elif muted and name == muted[0]:
                muted = (name, muted[1] + (-1 if ends else 1))
                muted = muted if muted[1] else None
            elif not ends and not muted and role_in(name, attributes, max(stack[-1][1] if stack else OPEN, OPEN)) <= DROPPED:
                muted = (name, 1)
            continue
        flush()
        muted = None
        if ends:
            while standing[name]:
                top = stack.pop()[0]
                standing[top] -= 1
                if top == name:
                    break
            continue
        if name in HIDDEN:
            end = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        ended = SELF_CLOSING.get(name, frozenset()) | (frozenset(("p",)) if name in ENDS_P else frozenset())
        while stack and stack[-1][0] in ended:
            standing[stack.pop()[0]] -= 1
        role = role_in(name, attributes, stack[-1][1] if stack else OPEN)
        main = main or role == CONTENT
        stack.append((name, role))
        standing[name] += 1
    if not muted:
        held.append(page[at:])
    flush()
    return found, main


def stream(blocks):
    """Token hashes of the blocks of a page, and the block that each token is from."""
    return stream_of(packed(blocks))[:2]


def packed(blocks):
    """The words of all blocks of a page, compressed: a line for each block, words divided by a space."""
    return zlib.compress("\n".join(" ".join(words_of(text)) for _, text in blocks).encode(), 1)


def stream_of(*pages):
    """``stream`` of pages whose words are ``packed``, one after the other, and the page of each block. Blocks are numbered on."""
    lines = [zlib.decompress(words).decode().split("\n") for words in pages]
    blocks = [block.split() for page in lines for block in page]
    return (word_hashes([w for block in blocks for w in block]), np.repeat(np.arange(len(blocks)), [len(block) for block in blocks]),
            np.repeat(np.arange(len(lines)), [len(page) for page in lines]))


def short_blocks(tokens, owner, page):
    """Hashes of what short blocks show, and the numbers of the ``ROW`` blocks that each speaks of: blocks of ``LEAST`` tokens
    or more by themselves, and rows of ``ROW`` neighbours of a page. ``page`` is that of each block."""
    if not len(owner):
        return np.empty(0, dtype=np.int64), np.empty((0, ROW), dtype=np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes, block = np.diff(np.append(first, len(owner))), owner[first]
    inside = np.arange(len(owner)) - np.repeat(first, sizes)
    own = mixed(mixed(np.add.reduceat(tokens * MULTIPLIERS[inside % len(MULTIPLIERS)], first)) + sizes.astype(np.uint64))
    alone = np.flatnonzero((sizes >= LEAST) & (sizes < DEPTH))
    hashes, about = own[alone], np.repeat(block[alone, None], ROW, axis=1)
    if len(own) >= ROW:
        blocks = np.column_stack([block[k:len(block) - ROW + 1 + k] for k in range(ROW)])
        short = (np.column_stack([sizes[k:len(sizes) - ROW + 1 + k] for k in range(ROW)]) < DEPTH).all(axis=1)
        short &= page[blocks[:, 0]] == page[blocks[:, -1]]
        hashes = np.append(hashes, mixed(combined(own, range(ROW)) + np.uint64(DEPTH))[short])
        about = np.concatenate([about, blocks[short]])
    return hashes.view(np.int64), about


def _streams(batches):
    met = set()
    for pdf in batches:
        # copies that a task meets are cut once
        pdf = pdf[[not (at in met or met.add(at)) for at in zip(pdf["_host"], pdf["_page"], strict=True)]]
        parsed = [page_blocks(h or "") for h in pdf["_html"]]
        yield pdf.drop(columns="_html").assign(_words=[packed(b) for b, _ in parsed],
                                               _open=[not main and any(role == OPEN for role, _ in b) for b, main in parsed])


def of_host(hashes, host):
    """The hashes as one host's, so that those of several hosts may meet in one column."""
    return mixed(hashes.view(np.uint64) ^ word_hashes([host])[0]).view(np.int64)


def suffix_array(tokens, page):
    """Starts of all substrings of ``DEPTH`` tokens within a page, in the order of the substrings, and their rank.

    Ranks by one token are doubled to ranks by two, four and so on: equal ranks are equal substrings.
    """
    rank = np.unique(tokens, return_inverse=True)[1]
    depth = 1
    start = np.arange(len(tokens))
    while depth < DEPTH:
        start = start[start + depth * 2 <= len(tokens)]
        start = start[page[start] == page[start + depth * 2 - 1]]
        pair = rank[start] * (rank.max() + 1) + rank[start + depth]
        deeper = np.zeros(len(tokens), dtype=np.int64)
        deeper[start] = np.unique(pair, return_inverse=True)[1]
        rank, depth = deeper, depth * 2
    start = start[np.argsort(rank[start], kind="stable")]
    return start, rank[start]


def least_pages(of):
    """Distinct pages, of so many of a host, that hold what is boilerplate."""
    return max(PAGES, SHARE * of)


def _found_here(pages, of):
    """(hash, distinct pages) of the long substrings and short blocks of some pages of a host that reach the wanted share of them.

    What ``least_pages`` of all pages hold reaches that share of the pages of some suffix array at least.
    """
    many, (tokens, owner, page) = len(pages), stream_of(*pages)
    hashes, about = short_blocks(tokens, owner, page)
    by = np.lexsort((page[about[:, 0]], hashes))
    hashes, at = hashes[by], page[about[by, 0]]
    once = np.append(True, (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1]))[:len(hashes)]
    found = [np.unique(hashes[once], return_counts=True)]
    if len(tokens) >= DEPTH:
        start, rank = suffix_array(tokens, page[owner])
        if len(start):
            ranks, pages = np.unique(np.unique(rank * many + page[owner[start]]) // many, return_counts=True)
            found.append((combined(tokens, range(DEPTH))[start[np.searchsorted(rank, ranks)]].view(np.int64), pages))
    for hashes, pages in found:
        # whole pages, so what rounding may add or take away is less than half of one
        enough = pages * of + 0.5 >= many * least_pages(of)
        yield hashes[enough], pages[enough]


def _repeats(batches):
    """For every suffix array: what may be boilerplate of its host, by its hash, with the distinct pages that hold it there, those
    that must hold it, and whether the array has all pages of the host."""
    held, at = [], None

    def found():
        host, of = at
        for hashes, pages in _found_here(held, of):
            if len(hashes):
                yield pd.DataFrame({"_hash": of_host(hashes, host), "_pages": pages, "_least": least_pages(of), "_whole": len(held) == of})

    for pdf in batches:
        for host, of, words in zip(pdf["_host"], pdf["_of"], pdf["_words"], strict=True):
            if held and (at != (host, of) or len(held) >= SHARD):
                yield from found()
                held = []
            at = host, of
            held.append(words)
    if held:
        yield from found()


def substrings(tokens):
    """Hashes of the long substrings at every start."""
    return combined(tokens, range(DEPTH)).view(np.int64) if len(tokens) >= DEPTH else np.empty(0, dtype=np.int64)


def _windows(batches, keys=(), marks=None):
    """The distinct hashes of long substrings and short blocks that each page shows, with the page's ``keys``; those that are not
    marked may be left out."""
    for whole in batches:
        for i in range(0, len(whole), PAGES_AT_ONCE):
            pdf = whole[i:i + PAGES_AT_ONCE]
            tokens, owner, page = stream_of(*pdf["_words"])
            short, about = short_blocks(tokens, owner, page)
            long, at = substrings(tokens), page[owner]
            within = np.flatnonzero(at[:len(long)] == at[DEPTH - 1:]) if len(long) else np.empty(0, dtype=np.int64)
            hashes, at = np.append(long[within], short), np.append(at[within], page[about[:, 0]])
            salts = word_hashes(list(pdf["_host"]))
            hashes = mixed(hashes.view(np.uint64) ^ salts[at]).view(np.int64)
            if marks is not None:
                some = np.flatnonzero(marks.value[hashes & (len(marks.value) - 1)])
                hashes, at = hashes[some], at[some]
            by = np.lexsort((at, hashes))
            hashes, at = hashes[by], at[by]
            once = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1]))[:len(hashes)])
            yield pd.DataFrame({**{k: pdf[k].to_numpy()[at[once]] for k in keys}, "_hash": hashes[once]})


def marks_of(hashes):
    """Broadcast marks at the places of the stored ``hashes`` (their last ``MARKS`` bits), which say which hashes cannot be among them."""
    places = hashes.select(F.col("_hash").bitwiseAND((1 << MARKS) - 1).alias("_at")).distinct().toPandas()["_at"].to_numpy()
    marks = np.zeros(1 << MARKS, dtype=bool)
    marks[places] = True
    return hashes.sparkSession.sparkContext.broadcast(marks)


def _judged(batches):
    """Of pages without a main part: the open blocks that repetition does not show to be boilerplate."""
    for pdf in batches:
        kept = []
        for host, page, repeats in zip(pdf["_host"], pdf.pop("_html"), pdf.pop("_repeats"), strict=True):
            blocks, _ = page_blocks(page or "")
            tokens, owner, page_of = stream_of(packed(blocks))
            repeats = np.asarray([] if repeats is None else repeats, dtype=np.int64)
            covered = np.zeros(len(tokens) + 1, dtype=np.int64)
            hit = np.flatnonzero(np.isin(of_host(substrings(tokens), host), repeats))
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + DEPTH, -1)
            covered = np.cumsum(covered)[:-1] > 0
            size = np.bincount(owner, minlength=len(blocks))
            part = np.bincount(owner, weights=covered, minlength=len(blocks))
            hashes, about = short_blocks(tokens, owner, page_of)
            gone = set(about[np.isin(of_host(hashes, host), repeats)].ravel().tolist())
            kept.append([i for i, (role, _) in enumerate(blocks) if role == OPEN and i not in gone
                         and (size[i] < DEPTH or part[i] <= COVERED * size[i])])
        yield pdf.assign(_kept=kept)


def _main_text(pages: pd.Series, kept: pd.Series) -> pd.Series:
    out = []
    for page, open_blocks in zip(pages, kept, strict=True):
        blocks, main = page_blocks(page or "")
        also = set() if main or open_blocks is None else set(open_blocks)
        out.append("\n\n".join(text for i, (role, text) in enumerate(blocks) if role == CONTENT or i in also))
    return pd.Series(out)


def host_streams(source):
    """Stored streams of the distinct pages of every host, with the host's number of them; the pages of a suffix array lie together."""
    sizes = source.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_of"))
    cut = source.mapInPandas(_streams, "_host string, _page long, _words binary, _open boolean")
    shard = F.pmod(F.col("_page"), F.ceil(F.col("_of") / F.lit(SHARD)))
    return materialise(attach(cut, sizes, ["_host"], "_of").withColumn("_shard", shard).repartition("_host", "_shard")
                       .dropDuplicates(["_host", "_shard", "_page"]).drop("_shard"))


def boilerplate(streams):
    """Stored hashes of what so many distinct pages of their host hold, over the streams of all pages.

    A suffix array tells what may be boilerplate; where it does not have all pages of its host, that is counted over all of them.
    """
    found = materialise(streams.mapInPandas(_repeats, "_hash long, _pages long, _least double, _whole boolean"))
    parts = materialise(found.where("not _whole").groupBy("_hash").agg(F.max("_least").alias("_least"), F.sum("_pages").alias("_pages")))
    known = found.where("_whole").where(F.col("_pages") >= F.col("_least")).select("_hash", "_pages")
    if not stored_rows(parts):
        return materialise(known)
    windows = streams.select("_host", "_words").mapInPandas(partial(_windows, marks=marks_of(parts)), "_hash long")
    counted = (attach(windows, parts.select("_hash", "_least", F.col("_pages").alias("_seen")), ["_hash"], "_seen")
               .groupBy("_hash").agg(F.count(F.lit(1)).alias("_pages"), F.max("_least").alias("_least")))
    return materialise(known.unionByName(counted.where(F.col("_pages") >= F.col("_least")).select("_hash", "_pages")))


def extract_text(pages, url="url", page="html"):
    """``pages`` without the column ``page`` and with ``text`` (empty if none) and ``n_chars`` (its code points).

    Blocks of the main part are never dropped, however often they repeat. A page without one keeps its open blocks that
    are no boilerplate of its host: what ``SHARE`` of the host's distinct pages, ``PAGES`` at least, do not hold. Blocks are joined by two line feeds. A
    missing page is empty; a missing URL is the host with the empty name; copies of a page count once as evidence and
    each give a row. Columns named ``text`` or ``n_chars`` are replaced, any other name may occur. An empty table gives an empty table.

    A host is split into shards of pages, so none is held whole; tokens and hashes are shuffled, no markup. All blocks of all pages
    are in the suffix arrays, whether or not a page of their host is to be judged.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url, URL_HOST, 1)), F.lit(""))
    others = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    # other columns travel as one, so their names meet none of those made here
    keyed = pages.select(host.alias("_host"), F.xxhash64(page).alias("_page"), F.col(page).alias("_html"),
                         F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_none")).alias("_others"))
    source = keyed.select("_host", "_page", "_html")
    streams = host_streams(source)
    undecided = materialise(streams.where("_open").select("_host", "_page", "_words"))
    keys = ["_host", "_page"]
    repeats = boilerplate(streams)
    windows = undecided.mapInPandas(partial(_windows, keys=keys, marks=marks_of(repeats)), "_host string, _page long, _hash long")
    hits = attach(windows, repeats, ["_hash"], "_pages", stored=True).groupBy(*keys).agg(F.collect_list("_hash").alias("_repeats"))
    facts = materialise(undecided.select(*keys).join(hits, keys, "left"))
    judged = (source.join(facts, ["_host", "_page"]).mapInPandas(_judged, "_host string, _page long, _kept array<int>")
              .dropDuplicates(["_host", "_page"]))
    text = F.pandas_udf(_main_text, "string")
    return (keyed.join(materialise(judged), ["_host", "_page"], "left").withColumn("_text", text(F.col("_html"), F.col("_kept")))
            .select(*[F.col("_others")[c].alias(c) for c in others], F.col("_text").alias("text"), F.length("_text").cast("bigint").alias("n_chars")))
