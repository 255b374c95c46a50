"""Main text of web pages: site templates are element subtrees that recur on many pages of a host; they go, the article stays."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, slices, stored, table, worker_cache

#: A subtree is a site's template where it stands on so many pages of the host that differ in all else, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.1
#: The same for elements that bear no class or id, which may as well be prose that pages share.
LEAST_PAGES_PLAIN, LEAST_SHARE_PLAIN = 5, 0.5
SALTS = 16

# Names of HTML elements by what they do to text.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
NEVER_TEXT = set("head script style title textarea xmp iframe noembed noframes noscript template svg canvas video audio object map select option button datalist".split())
AROUND = set("nav footer aside form menu dialog search".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | set("p pre blockquote li dd dt td th tr tbody thead figure figcaption b i em strong a span code q cite u s small sub sup mark".split())
#: What an opening tag closes on its way: these, up to but without those.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: An end tag of these reaches over no block.
INLINE = set("a abbr b big cite code em font i label q s small span strike strong sub sup tt u".split())
BARRIER = set("table td th caption html template".split())
# Words of class and id names, and roles, that mark what stands around an article.
MARKS = set(
    """ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb
    breadcrumbs sidebar sidebars footer footers masthead cookie cookies consent gdpr notice notices alert alerts share sharing social comment comments reply replies respond
    disqus newsletter subscribe subscription signup login related recommended recommendations popup modal overlay pagination pager toolbar skip widget widgets search hidden""".split())
PAGE_MARKS = {"header", "topbar", "headers"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOT_MARKS = {"has", "with", "no", "without", "not", "hide", "show"}
MAIN_NAMES = [
    {"articlebody", "article-body", "article-content", "article-text", "post-content", "post-body", "entry-content", "story-body"},
    {"article", "post", "story", "entry"}, {"main", "main-content", "page-content", "content"},
]

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_MASK, _PRIME, _BASE = (1 << 63) - 1, (1 << 61) - 1, 1_000_003_000_007

PLAIN, AROUND_IT, COMMENT, MAIN_ROLE = 0, 1, 2, 4


def _read_attributes(text: str) -> tuple[int, bool, frozenset]:
    """(what class, id, role and the like say, whether there is a class or id, the names)."""
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    flag = PLAIN
    for name in names:
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        marked = [w for k, w in enumerate(words) if w in MARKS and not (k and words[k - 1] in NOT_MARKS)]
        if marked:
            flag |= AROUND_IT
        if {"comment", "comments", "reply", "replies"} & set(marked):
            flag |= COMMENT
    role = found.get("role", "").lower()
    if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        flag |= AROUND_IT
    if role == "main" or "articlebody" in found.get("itemprop", "").lower():
        flag |= MAIN_ROLE
    return flag, "class" in found or "id" in found, frozenset(n.lower() for n in names)


def read_attributes(text: str) -> tuple[int, bool, frozenset]:
    if not text or not _TELLING.search(text):
        return PLAIN, False, frozenset()
    kept = worker_cache("page-attributes", dict)
    if text not in kept:
        if len(kept) > 20_000:
            kept.clear()
        kept[text] = _read_attributes(text)
    return kept[text]


class Page:
    """Elements of a page in order, and its texts: element, text as written, block.  Unclosed, stray and wrongly nested tags are taken as browsers do, roughly."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes, self.first, self.last = ["#"], [-1], [(PLAIN, False, frozenset())], [0], [0]
        self.texts: list[tuple[int, str, int]] = []
        stack, count, block, at = [0], Counter(), 0, 0

        def close(to: int) -> None:
            for node in stack[to:]:
                self.last[node] = len(self.texts)
                count[self.tag[node]] -= 1
            del stack[to:]

        while True:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start() if m else len(source)]
            if piece:
                self.texts.append((stack[-1], piece, block))
            if not m:
                break
            at = m.end()
            slash, name, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if name is None:
                continue
            name = name.lower()
            if slash:
                if count[name]:
                    place = next(k for k in range(len(stack) - 1, -1, -1) if self.tag[stack[k]] == name)
                    between = stack[place + 1 :]
                    if not any(self.tag[n] in (BLOCK if name in INLINE else BARRIER) for n in between) or name in ("article", "body", "html", "table"):
                        close(place)
                if name in BLOCK:
                    block += 1
                continue
            if name in BLOCK:
                block += 1
                if count["p"] and name != "option":
                    place = next(k for k in range(len(stack) - 1, -1, -1) if self.tag[stack[k]] == "p")
                    if not any(self.tag[n] in BARRIER for n in stack[place + 1 :]):
                        close(place)
                if name in CLOSES:
                    these, those = CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in those:
                            break
                        if self.tag[stack[k]] in these:
                            close(k)
            if name in VOID:
                if name == "br":
                    self.texts.append((stack[-1], " ", block))
                elif name == "hr":
                    block += 1
                continue
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attributes.append(read_attributes(rest))
            self.first.append(len(self.texts))
            self.last.append(len(self.texts))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = source.find(">", end.start()) + 1 if end else len(source)
                at = at or len(source)
                continue
            stack.append(node)
            count[name] += 1
        close(0)

    def regions(self) -> tuple[list[int], bool, list[bool]]:
        """(elements that hold the article, whether the page names them, whether an element goes by itself or by one around it)."""
        n = len(self.tag)
        flag = [a[0] for a in self.attributes]
        named = [t == "article" and not f & COMMENT or t == "main" or bool(f & MAIN_ROLE) for t, f in zip(self.tag, flag)]
        holds = named[:]
        for k in range(n - 1, 0, -1):
            if holds[k] and not (self.tag[k] == "article" and flag[k] & COMMENT):
                holds[self.parent[k]] = True
        gone, within, heading = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            up, tag = self.parent[k], self.tag[k]
            within[k] = within[up] or named[k]
            heading[k] = heading[up] or tag in HEADINGS
            bad = tag in NEVER_TEXT
            if not bad and not holds[k] and tag not in ("html", "body"):
                bad = tag in AROUND or bool(flag[k] & (AROUND_IT | COMMENT)) or not within[k] and (tag == "header" or any(PAGE_MARKS & set(re.split(r"\W|_", x)) for x in self.attributes[k][2]))
            gone[k] = gone[up] or bad
        # a header inside the article: its headings stay, bylines and the like go
        loose = [False] * n
        for k in range(1, n):
            loose[k] = (loose[self.parent[k]] or self.tag[k] == "header") and within[k]
        self.bare = [a and not b for a, b in zip(loose, heading)]

        def outermost(chosen) -> list[int]:
            inside, out = [False] * n, []
            for k in range(1, n):
                inside[k] = inside[self.parent[k]]
                if not inside[k] and not gone[k] and chosen(k):
                    inside[k] = True
                    out.append(k)
            return out

        mains = outermost(lambda k: self.tag[k] == "main" or bool(flag[k] & MAIN_ROLE))
        under = [False] * n
        for k in mains:
            under[k] = True
        for k in range(1, n):
            under[k] = under[k] or under[self.parent[k]]
        articles = outermost(lambda k: self.tag[k] == "article" and named[k])
        found = [k for k in articles if under[k]] or articles or mains
        for names in MAIN_NAMES:
            found = found or outermost(lambda k: bool(names & self.attributes[k][2]) and self.last[k] > self.first[k])  # noqa: B023
        return (found, True, gone) if found else ([0], False, gone)

    def menus(self, gone: list[bool]) -> None:
        """Where nothing names the article: elements of two links and more whose text is links for three quarters go."""
        n = len(self.tag)
        linked = [t == "a" for t in self.tag]
        for k in range(1, n):
            linked[k] = linked[k] or linked[self.parent[k]]
        everything, links = [0], [0]
        for node, text, _ in self.texts:
            size = 0 if gone[node] else len("".join(text.split()))
            everything.append(everything[-1] + size)
            links.append(links[-1] + size * linked[node])
        count = [0] * n
        for k in range(n - 1, 0, -1):
            count[k] += self.tag[k] == "a"
            count[self.parent[k]] += count[k]
        for k in range(1, n):
            a, b = self.first[k], self.last[k]
            if gone[self.parent[k]] or self.tag[k] not in ("html", "body") and count[k] > 1 and 4 * (links[b] - links[a]) >= 3 * (everything[b] - everything[a]) > 0:
                gone[k] = True


class Article:
    """What of a page's texts is article, and the hashed subtrees of it that may be the site's."""

    def __init__(self, source: str):
        page = Page(source)
        regions, named, gone = page.regions()
        if not named:
            page.menus(gone)
        self.page, self.named = page, named
        kept = [False] * len(page.texts)
        for region in regions:
            for k in range(page.first[region], page.last[region]):
                node = page.texts[k][0]
                kept[k] = not gone[node] and not page.bare[node]
        self.kept, self.regions, self.gone = kept, regions, gone

    def subtrees(self) -> list[tuple[int, int, int]]:
        """(element, hash, hash of all the article but it) of subtrees with text.

        A subtree is hashed by its tag and the texts in it, out of running polynomials, so that nesting costs nothing.
        The lowest bit of a hash tells whether the element bears a class or id.  Where the page names its article,
        prose elements and elements without class or id belong to it and are left out.
        """
        page = self.page
        inside = [False] * len(page.tag)
        for k in range(1, len(page.tag)):
            inside[k] = inside[page.parent[k]] or page.parent[k] in self.regions
        able = [k for k in range(1, len(page.tag)) if inside[k] and not self.gone[k] and page.tag[k] not in ("html", "body") and (not self.named or page.attributes[k][1] and page.tag[k] not in PROSE)]
        running, sums, degree = [0], [0], [0]  # degree: texts with words so far
        for kept, (node, text, _) in zip(self.kept, page.texts):
            words = text.split() if kept else None
            h = 0
            if words:
                h = int.from_bytes(hashlib.blake2b("\x1f".join([page.tag[node], *words]).encode("utf-8", "replace"), digest_size=8).digest(), "little")
            running.append((running[-1] * _BASE + h) % _PRIME if words else running[-1])
            sums.append(sums[-1] + h)
            degree.append(degree[-1] + bool(words))
        self.total = sums[-1] & _MASK
        scale = [1]
        while len(scale) <= degree[-1]:
            scale.append(scale[-1] * _BASE % _PRIME)
        out = []
        for k in able:
            a, b = page.first[k], page.last[k]
            if degree[b] > degree[a]:
                h = (running[b] - running[a] * scale[degree[b] - degree[a]]) % _PRIME
                h = int.from_bytes(hashlib.blake2b(f"{page.tag[k]} {h}".encode(), digest_size=8).digest(), "little") & _MASK & ~1 | page.attributes[k][1]
                out.append((k, h, (self.total - (sums[b] - sums[a])) & _MASK))
        return out

    def text(self, templates: frozenset = frozenset()) -> str:
        """The article without the subtrees among templates: blocks joined by newlines."""
        kept, page = self.kept, self.page
        if templates:
            kept = kept[:]
            for k, h, _ in self.subtrees():
                if h in templates:
                    kept[page.first[k] : page.last[k]] = [False] * (page.last[k] - page.first[k])
        blocks, last = [], None
        for keep, (_, text, block) in zip(kept, page.texts):
            if keep:
                text = entities.unescape(text) if "&" in text else text
                if block == last:
                    blocks[-1].append(text)
                else:
                    blocks.append([text])
                    last = block
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(b for b in joined if b)


# ---------------------------------------------------------------- over all pages

def site_templates(pages: DataFrame) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur on the host; pages: host, html.

    A subtree counts once for every different rest of an article, so copies of one page make nothing a template.  Rows
    are counted by host, subtree and rest before they meet by host.  Every template takes its share of a host's different
    pages, so a host has at most 1 / share times as many as a page has subtrees on average.
    """

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 1):
            hosts, hashes, rests = [], [], []
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                article = Article(html)
                found = {(h, rest) for _, h, rest in article.subtrees()}
                found.add((-1, article.total))
                hosts += [host] * len(found)
                hashes += [h for h, _ in found]
                rests += [r for _, r in found]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(rests, pa.int64())], names=["host", "subtree", "rest"])

    seen = pages.filter("host <> ''").select("host", "html").mapInArrow(run, "host string, subtree long, rest long").distinct()
    counts = stored(seen.groupBy("host", "subtree").count(), "subtrees")
    all_pages = counts.filter("subtree = -1").select("host", F.col("count").alias("pages"))
    # hosts are dealt by a salt too: one of them may have a third of all subtrees
    salted = all_pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    often = counts.filter(f"subtree <> -1 and count >= {LEAST_PAGES}").withColumn("salt", F.pmod(F.col("subtree").bitwiseAND(F.lit((1 << 62) - 2)) / 2, F.lit(SALTS)).cast("int"))
    marked = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    enough = (marked & (F.col("count") >= LEAST_SHARE * F.col("pages"))) | (~marked & (F.col("count") >= LEAST_PAGES_PLAIN) & (F.col("count") >= LEAST_SHARE_PLAIN * F.col("pages")))
    return often.join(salted, ["host", "salt"]).filter(enough).groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null and empty html give an empty text; a page whose url is null or names no host has no site, so only its markup
    counts; repeated rows and ids stay as they are; pages of any length are read whole; other columns do not matter.
    An article is what <article>, <main> or names like them hold, else all of the body that is no menu; in it and around it
    go scripts, forms, elements of navigation, headers, footers, sidebars, notices, adverts and comments, by their names, and then
    the templates of the site.  A header inside an article keeps its headings.  <br> counts as white space.
    """
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    templates = stored(site_templates(rows), "templates")
    salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 2):
            known = [frozenset(t) if t else frozenset() for t in part.column(3).to_pylist()]
            texts = [Article(h).text(t) for h, t in zip(part.column(2).to_pylist(), known)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return joined.select("page_id", "url", "html", "templates").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
