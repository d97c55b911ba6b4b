"""Main text of web pages by template deduction from equivalence classes of tokens.

Pages of a host are made from a template. Tokens (elements by their path, and texts at a path) that occur equally often on the same
pages share an occurrence vector and form an equivalence class; classes of several tokens on several pages are the template. A text is
the template's if it shares the class of its own element, also inside articles: an element that always says the same. Names of elements
are evidence beside that. On hosts whose elements do not say what the article is, the innermost once-per-page template element around
all that varies is its slot.

Pages are parsed once into a written table. Vectors are sums of hashes per (host, token), combined on the map side; pages meet the
template by (host, token), so a host's template is never in one place, and a host with a third of all pages is many keys.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.session import cut_lineage, fresh_path

#: A class is part of the template if it has this many tokens and is on this many pages.
LEAST_TOKENS = 2
LEAST_PAGES = 3
#: Texts on this share of the pages of a host belong to its template, where no element says that they are an article; there, on all pages.
TEXT_SHARE = 0.5

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "textarea", "title"}
ASIDE = set("nav aside footer form head button select option datalist dialog menu object svg canvas audio video map".split())
ARTICLE = {"article", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer notice notices cookie cookies consent comment comments respond disqus share sharing social related newsletter "
    "subscribe subscription popup modal widget toolbar pagination login signup".split()
)
#: Of these, names that an article may give its own sections: they set aside only what is on several pages, or what no other page tells.
DOUBTFUL_NAMES = set("menu social related notice notices share sharing banner promotion sponsor subscription".split())
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "form", "dialog", "alert"}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class Block:
    """A run of text between block elements: where it stands, and what its elements say about it."""

    __slots__ = ("path", "text", "aside", "article", "doubtful")

    def __init__(self, path: int, text: str, aside: bool, article: bool, doubtful: bool):
        self.path, self.text, self.aside, self.article, self.doubtful = path, text, aside, article, doubtful


def _role(name: str, attributes: str, in_article: bool) -> tuple[str, bool, bool, bool]:
    """Path step, whether the element is beside the article, whether it is the article, whether only a doubtful name sets it aside."""
    step, words, role = name, set(), ""
    if attributes:
        for key, *values in NAMES.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if key.lower() == "role":
                role = value.strip()
            else:
                words.update(re.split(r"[^a-z]+", value))
                if key.lower() == "class":
                    step = name + "." + ".".join(sorted(value.split()))
    doubtful = in_article and name not in ("body", "main") and bool(words & DOUBTFUL_NAMES)
    named = words & (ASIDE_NAMES - DOUBTFUL_NAMES if in_article else ASIDE_NAMES)
    # A heading group inside the article belongs to it.
    aside = name in ASIDE or bool(named) or role in ASIDE_ROLES or (name == "header" or "header" in words) and not in_article
    if name in ("html", "body", "article", "main"):
        aside = name == "article" and in_article and bool(named)
    if attributes and HIDDEN.search(attributes):
        aside = True
    return step, aside, name in ARTICLE or role in ("main", "article"), doubtful


#: The path of what is in no element.
ROOT = 0


def _hashed(*parts: object) -> int:
    """64 bits, signed."""
    h = xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def parse(html: str) -> tuple[list[Block], list[int], dict[int, tuple[int, int]]]:
    """Blocks with text in page order, the paths of all block elements, and of each path its parent and its depth.

    A path is a hash of its parent and its last step, so deep nesting costs no more than its elements.
    """
    blocks: list[Block] = []
    paths: list[int] = []
    parents: dict[int, tuple[int, int]] = {ROOT: (ROOT, 0)}
    stack: list[tuple[str, int, bool, bool, bool]] = [("", ROOT, False, False, False)]
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                _, path, aside, article, doubtful = stack[-1]
                blocks.append(Block(path, text, aside, article, doubtful))

    def pop(k: int) -> None:
        if any(s[0] not in INLINE for s in stack[k:]):
            flush()
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        tag = TAG.search(html, at)
        if tag is None:
            pending.append(unescape(html[at:]))
            break
        if tag.start() > at:
            pending.append(unescape(html[at : tag.start()]))
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name = name.lower()
        if tag[1] or tag[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW:
            if name not in INLINE:
                flush()
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
            closes = CLOSES.get(name) or {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        _, path, aside, article, doubtful = stack[-1]
        step, is_aside, is_article, is_doubtful = _role(name, tag[3] or tag[6] or "", article)
        if name in INLINE:
            stack.append((name, path, aside or is_aside, article, doubtful))
            if aside != stack[-1][2]:
                flush()
        else:
            depth = parents[path][1] + 1
            above, path = path, _hashed(path, step)
            parents[path] = (above, depth)
            paths.append(path)
            stack.append((name, path, aside or is_aside, article or is_article, doubtful or is_doubtful))
    flush()
    return blocks, paths, parents


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _undecided(blocks: list[Block]) -> list[Block]:
    """Blocks of which no element says whether they are the article."""
    named = any(b.article and not b.aside for b in blocks)
    return [b for b in blocks if not b.aside and (b.article or not named)]


#: Kinds of tokens: elements, and texts by what their elements say.
ELEMENT, UNDECIDED, IN_ARTICLE, DOUBTFUL = "/", "u", "a", "d"


def kind_of(block: Block) -> str:
    return DOUBTFUL if block.doubtful else IN_ARTICLE if block.article else UNDECIDED


def text_token(block: Block) -> int:
    return _hashed(kind_of(block), block.path, block.text)


PARSED = (
    "page_id {page_id}, url string, host string, texts array<string>, kinds array<string>, tokens array<long>, paths array<long>, "
    "times array<int>, elements array<struct<path: long, parent: long, depth: int, n: int>>"
)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Every row with the texts that no element sets aside, their tokens, and the elements.

    `times`, at the first text of a token (else 0), and `n` are how often the token and the element are on the page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, host, html in batch.itertuples(index=False):
                blocks, paths, parents = parse(html or "")
                chosen = _undecided(blocks)
                tokens = [text_token(b) for b in chosen]
                often, left = Counter(paths), Counter(tokens)
                times = [left.pop(token, 0) for token in tokens]
                above = [(p, *parents[p], n) for p, n in often.items()]
                rows.append((page_id, url, host, [b.text for b in chosen], [kind_of(b) for b in chosen], tokens, [b.path for b in chosen], times, above))
            yield pd.DataFrame(rows, columns=["page_id", "url", "host", "texts", "kinds", "tokens", "paths", "times", "elements"])

    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    return read.mapInPandas(run, PARSED.format(page_id=pages.schema["page_id"].dataType.simpleString()))


def occurrences(parsed: DataFrame) -> DataFrame:
    """(host, token, kind, at, pages, total, v1, v2): on how many pages, how often, and the vector's hash; `at` is the element around."""
    page = ("host", F.xxhash64("page_id", "url").alias("page"))
    texts = parsed.select(*page, F.inline(F.arrays_zip("tokens", "kinds", "paths", "times"))).toDF("host", "page", "token", "kind", "at", "n")
    elements = parsed.select(*page, F.inline("elements")).select("host", "page", F.col("path").alias("token"), F.lit(ELEMENT).alias("kind"), F.col("parent").alias("at"), "n")
    one = texts.filter("n > 0").unionByName(elements).withColumn("h", F.xxhash64("page", "n"))
    return one.groupBy("host", "token", "kind", "at").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("total"),
        F.sum(F.col("h").bitwiseAND(0x7FFFFFFF)).alias("v1"),
        F.sum(F.shiftrightunsigned("h", 33)).alias("v2"),
    )


def template_tokens(tokens: list[tuple[int, str, int]], pages: int, total: int, host_pages: int) -> list[tuple[int, str]]:
    """The template's texts, and the elements that are once on their pages, of one class of (token, kind, element around)."""
    elements = {token for token, kind, _ in tokens if kind == ELEMENT}
    texts = [t for t in tokens if t[1] != ELEMENT]
    # Texts at elements of other classes that keep each other's company are a copied article, unless they are on most pages.
    copied = pages < TEXT_SHARE * host_pages and any(at not in elements for _, _, at in texts)
    found = []
    for token, kind, at in texts:
        own = len(tokens) >= LEAST_TOKENS and at in elements and not copied
        enough = {UNDECIDED: TEXT_SHARE * host_pages, IN_ARTICLE: host_pages, DOUBTFUL: LEAST_PAGES}[kind]
        if own or pages >= enough:
            found.append((token, kind))
    if len(tokens) >= LEAST_TOKENS and pages == total:
        found += [(token, ELEMENT) for token in elements]
    return found


def templates(parsed: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, token, kind) of all templates. A class is no more than the tokens of one page."""
    found = cut_lineage(occurrences(parsed).filter(F.col("pages") >= LEAST_PAGES))
    members = F.collect_list(F.struct("token", "kind", "at")).alias("members")
    classes = found.groupBy("host", "pages", "total", "v1", "v2").agg(members).join(hosts, "host")
    classes = classes.select("host", "host_pages", "pages", "total", "members.token", "members.kind", "members.at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, host_pages, n, total, *members in batch.itertuples(index=False):
                rows += [(host, *t) for t in template_tokens(list(zip(*members)), n, total, host_pages)]
            yield pd.DataFrame(rows, columns=["host", "token", "kind"])

    return classes.mapInPandas(run, "host string, token long, kind string")


def common_chain(paths: list[int], parents: dict[int, tuple[int, int]]) -> list[int]:
    """The elements around all of the paths, the innermost first. Every element is visited once."""
    if not paths:
        return []
    chain = [paths[0]]
    while chain[-1] != ROOT:
        chain.append(parents[chain[-1]][0])
    meets = {p: k for k, p in enumerate(chain)}
    first = 0
    for path in paths[1:]:
        walked = []
        while path not in meets:
            walked.append(path)
            path = parents[path][0]
        first = max(first, meets[path])
        meets.update((p, meets[path]) for p in walked)
    return chain[first:-1]


def within(paths: list[int], slot: int, parents: dict[int, tuple[int, int]]) -> list[bool]:
    """Whether each path is in the slot. Every element is visited once."""
    known = {slot: True} | ({ROOT: False} if slot != ROOT else {})
    for path in paths:
        walked = []
        while path not in known:
            walked.append(path)
            path = parents[path][0]
        known.update((p, known[path]) for p in walked)
    return [known[p] for p in paths]


def slots(judged: DataFrame, told: DataFrame) -> DataFrame:
    """(host, slot): the innermost once-per-page template element around all undecided text that is not the template's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, kinds, paths, elements, template in batch.itertuples(index=False):
                parents = _parents(elements)
                gone = set(template) if template is not None else ()
                varying = [p for k, (p, kind) in enumerate(zip(paths, kinds)) if kind == UNDECIDED and k not in gone]
                if varying:
                    rows += [(host, p, parents[p][1]) for p in (*common_chain(varying, parents), ROOT)]
            yield pd.DataFrame(rows, columns=["host", "token", "depth"])

    asked = judged.filter(F.array_contains("kinds", UNDECIDED)).select("host", "kinds", "paths", "elements", "template")
    around = asked.mapInPandas(run, "host string, token long, depth int").groupBy("host", "token", "depth").agg(F.count("*").alias("n"))
    around = cut_lineage(around)
    every = around.filter(F.col("token") == ROOT).select("host", F.col("n").alias("every"))
    once = told.filter(F.col("kind") == ELEMENT).select("host", "token")
    held = around.join(every, "host").filter("n = every").join(once, ["host", "token"])
    return held.groupBy("host").agg(F.max_by("token", "depth").alias("slot"))


def _parents(elements) -> dict[int, tuple[int, int]]:
    return {ROOT: (ROOT, 0)} | {e["path"]: (e["parent"], e["depth"]) for e in elements}


def own_text(texts, kinds, paths, parents, slot: int | None, template: set[int] | None) -> str:
    """All blocks of articles, else those of the slot, without the template's texts (by position) and what elements set aside.

    Without a template (None) there is nothing to compare with, and doubtful names decide. An article that is the template's as a whole,
    as on a host of copies, stays.
    """
    if template is None:
        return " ".join([t for t, kind in zip(texts, kinds) if kind != DOUBTFUL])
    chosen = list(range(len(texts)))
    if slot is not None and UNDECIDED in kinds:
        inside = within(list(paths), slot, parents)
        chosen = [k for k in chosen if kinds[k] != UNDECIDED or inside[k]] or chosen
    own = [k for k in chosen if k not in template] or [k for k in chosen if kinds[k] == IN_ARTICLE]
    return " ".join([texts[k] for k in own])


def main_text(html: str | None, slot: int | None, tokens) -> str:
    """Of one page, given the slot and the template's text tokens of its host (None: unknown host)."""
    blocks, _, parents = parse(html or "")
    chosen = _undecided(blocks)
    template = None if tokens is None else {k for k, b in enumerate(chosen) if text_token(b) in set(tokens)}
    return own_text([b.text for b in chosen], [kind_of(b) for b in chosen], [b.path for b in chosen], parents, slot or None, template)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html; null and empty pages have an empty text.

    Hosts with fewer than LEAST_PAGES pages, and null urls together as one host, are read by their elements alone or like any host.
    Repeated rows stay rows. Nesting may be of any depth: an element costs the same wherever it is.
    """
    spark = pages.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        """Read again, so that Spark knows the size and broadcasts only what is small."""
        path = fresh_path(spark, name)
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    parsed = written(parsed_pages(pages).withColumn("row", F.monotonically_increasing_id()), "pages-parsed")
    hosts = parsed.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= LEAST_PAGES)
    hosts = written(hosts, "page-hosts")
    told = written(templates(parsed, hosts), "page-templates")

    # A row of `told` per key: a key with many pages is split by the skew join.
    at = parsed.select("row", "host", F.posexplode("tokens").alias("k", "token"))
    gone = at.join(told.filter(F.col("kind") != ELEMENT), ["host", "token"], "left_semi").groupBy("row").agg(F.collect_list("k").alias("template"))
    judged = parsed.join(written(gone, "page-template-texts"), "row", "left")
    known = written(hosts.select("host", F.lit(True).alias("known")).join(slots(judged, told), "host", "left"), "page-slots")

    @F.pandas_udf("string")
    def text_of(page: pd.DataFrame) -> pd.Series:
        out = []
        for texts, kinds, paths, elements, template, slot, is_known in page.itertuples(index=False):
            gone = set() if template is None else set(template)
            of_host = None if pd.isna(slot) else int(slot)
            out.append(own_text(texts, list(kinds), paths, _parents(elements), of_host, gone if is_known else None))
        return pd.Series(out, dtype="object")

    page = F.struct("texts", "kinds", "paths", "elements", "template", F.col("slot").cast("string").alias("slot"), F.coalesce("known", F.lit(False)).alias("known"))
    found = judged.join(known, "host", "left").select("page_id", "url", text_of(page).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
