"""Operator 5: main text of a web page by composite text density.

For every node of the page's element tree: characters C, characters inside
links LC, elements T and link elements LT below it. The composite density

    CTD = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

(zero counts read as one) is high where much text stands in few tags and few
links.  A node's density sum adds its children's CTD; the subtree of the
largest sum holds the main text.  The method's threshold, the smallest CTD on
the path from it to the body, is left out: it takes headings and short
paragraphs of the text too (figures in the README).
Elements that say themselves what they are (menus, headers, footers, asides,
forms, adverts, notices, comment sections, scripts, styles) are taken out
before.  A class or id says so where it is such a name as a whole, ends in one
(``site-header``), or begins with one before words of layout (``comment-list``);
a name with a modifier (``has-sidebar``, ``ad-free``, ``comments-open``) says
something else, and one that holds the page's ``h1`` or ``main`` or nearly all
of its text is not believed.  An ``article`` or ``main`` element around the chosen subtree is
kept whole.  Inside these two only the listed kinds go: headers, link-rich
lists and tables, and blocks named after a search, sharing or related matter
stay, and no heading is judged by its class or id.

The tree lives in flat lists filled in one scan of the page, so depth and
length of a page are not limited.  The operator is map-only.

Defined results: null, empty and text-less pages give the empty text; broken
pages are read as far as they go (open elements end with the page, an end
tag without start is ignored); repeated pages are extracted each; an empty
table gives an empty result; extra columns pass through where named in
``keep``.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

#: fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe noembed noframes xmp svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img input".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                     "pre section table ul".split())
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg head "
                       "dialog menu".split())
NOISE_NAMES = frozenset("ad ads adv advert advertisement adverts banner sponsor sponsored promo sidebar menu nav navbar navigation "
                        "breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notification alert popup modal "
                        "overlay comment comments reply replies disqus share sharing social related recommended newsletter "
                        "subscribe signup login search widget toolbar pagination pager".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
KEEP_WHOLE = frozenset(("article", "main"))
#: names that are noise outside an article only: none of the kinds that go inside one
OUTSIDE_NAMES = frozenset("header masthead search share sharing social related recommended widget toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


#: words that turn a name into a statement about something else
MODIFIERS = frozenset("has no not non with without is free open opened closed enabled disabled hide hidden less ready".split())
#: words of layout that may follow a name
LAYOUT = frozenset("list area section box container wrapper wrap inner outer item items block content main left right top bottom bar "
                   "slot unit form link links button buttons title body thread count posts articles stories primary secondary row "
                   "col column group panel panels text message messages holder region zone module icon icons".split())
#: share of the page's text that no element of such a name can hold
NEARLY_ALL = 0.9

HARD, SOFT = 2, 1


def _says(value: str, names: frozenset) -> bool:
    """Whether one of the names of a class or id attribute says ``names``."""
    for one in value.split():
        words = [w for w in re.split(r"[^a-z]+", one) if w]
        if not words or not MODIFIERS.isdisjoint(words):
            continue
        if words[-1] in names or words[0] in names and LAYOUT.issuperset(words[1:]):
            return True
    return False


def _noise(name: str, attrs: str, in_article: bool) -> int:
    """HARD for what the element, its role or style says, SOFT for its class or id."""
    if name in NOISE_TAGS or name == "header" and not in_article:
        return HARD
    if not attrs or name in ("html", "body", "article", "main"):
        return 0
    low = attrs.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", low) or re.search(r"display\s*:\s*none", low):
        return HARD
    names = NOISE_NAMES - OUTSIDE_NAMES if in_article else NOISE_NAMES
    if in_article and name in HEADINGS:
        names = frozenset()
    found = 0
    for m in ATTR.finditer(low):
        value = m[2] or m[3] or m[4] or ""
        if m[1] == "role" and value.strip() in NOISE_ROLES:
            return HARD
        if m[1] in ("class", "id") and _says(value, names):
            found = SOFT
    return found


class Page:
    """Element tree in flat lists; node 0 is the body."""

    def __init__(self, page: str):
        self.parent, self.name, self.noise, self.inside, self.soft = [-1], ["body"], [False], [False], [False]
        self.runs: list[tuple[int, str]] = []       # (node, text) in page order; node -1: block break
        self._read(page)
        self._settle()

    def _open(self, name: str, attrs: str, stack: list[int], articles: int) -> int:
        up = stack[-1]
        self.parent.append(up)
        self.name.append(name)
        kind = _noise(name, attrs, articles > 0)
        self.noise.append(self.noise[up] or kind == HARD)
        self.soft.append(kind == SOFT)
        self.inside.append(articles > 0 or name in KEEP_WHOLE)
        return len(self.name) - 1

    def _read(self, page: str) -> None:
        stack, articles, at, n = [0], 0, 0, len(page)
        runs, name = self.runs, self.name
        while at < n:
            m = TAG.search(page, at)
            text = page[at:m.start()] if m else page[at:]
            if text and not self.noise[stack[-1]]:
                runs.append((stack[-1], _html.unescape(text)))
            if not m:
                break
            at = m.end() if m.end() > m.start() else m.end() + 1
            tag = (m[2] or "").lower()
            if not tag or tag in ("html", "body"):
                continue
            if tag not in INLINE:
                runs.append((-1, ""))
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if name[stack[k]] == tag:
                        articles -= sum(name[x] in KEEP_WHOLE for x in stack[k:])
                        del stack[k:]
                        break
                    if tag in INLINE and name[stack[k]] not in INLINE:
                        break
                continue
            if tag in CLOSES_P:
                self._end(stack, "p", CLOSES_P - {"p"})
            elif tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
                for k in range(len(stack) - 1, 0, -1):
                    if name[stack[k]] in same:
                        del stack[k:]
                        break
                    if name[stack[k]] in ("ul", "ol", "dl", "table", "select", "div", "section", "article"):
                        break
            node = self._open(tag, m[3] or "", stack, articles)
            if tag in RAW and not (m[3] or "").endswith("/"):
                close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
            elif tag not in VOID and not (m[3] or "").endswith("/"):
                stack.append(node)
                articles += tag in KEEP_WHOLE

    def _end(self, stack: list[int], tag: str, stops: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.name[stack[k]] == tag:
                del stack[k:]
                return
            if self.name[stack[k]] in stops or self.name[stack[k]] in ("td", "th", "li", "button"):
                return

    def _settle(self) -> None:
        """Believe what classes and ids say, but for elements that hold the
        page's own title, its ``main`` or nearly all of its text."""
        if not any(self.soft):
            return
        n = len(self.name)
        size, title = [0] * n, [x in ("h1", "main") for x in self.name]
        for node, text in self.runs:
            if node >= 0:
                size[node] += len("".join(text.split()))
        for k in range(n - 1, 0, -1):
            if not self.noise[k]:
                size[self.parent[k]] += size[k]
                title[self.parent[k]] |= title[k]
        for k in range(1, n):
            said = self.soft[k] and not title[k] and size[k] < NEARLY_ALL * size[0]
            self.noise[k] = self.noise[k] or self.noise[self.parent[k]] or said

    def densities(self):
        """CTD and density sum of every node, and its characters."""
        n = len(self.name)
        c, lc, t, lt = [0] * n, [0] * n, [0] * n, [0] * n
        link = [False] * n
        for k in range(1, n):
            link[k] = link[self.parent[k]] or self.name[k] == "a"
        for node, text in self.runs:
            if node >= 0:
                size = len("".join(text.split()))
                c[node] += size
                lc[node] += size if link[node] else 0
        for k in range(n - 1, 0, -1):
            if self.noise[k]:
                continue
            up = self.parent[k]
            t[k] += 1
            lt[k] += self.name[k] == "a"
            for counts in (c, lc, t, lt):
                counts[up] += counts[k]
        share = lc[0] / c[0] if c[0] else 0.0
        ctd, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if self.noise[k] or not c[k]:
                continue
            base = math.log(c[k] / max(1, c[k] - lc[k]) * lc[k] + share * c[k] + math.e)
            inner = c[k] / max(1, lc[k]) * max(1, t[k]) / max(1, lt[k])
            ctd[k] = c[k] / max(1, t[k]) * math.log(max(inner, 1.0)) / math.log(max(base, 1.0 + 1e-9))
            if k:
                total[self.parent[k]] += ctd[k]
        return ctd, total, c, lc

    def main_text(self) -> str:
        _, total, c, lc = self.densities()
        n = len(self.name)
        if not c[0]:
            return ""
        best = max(range(n), key=lambda k: (total[k] if not self.noise[k] else -1.0, -k))
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        whole = next((k for k in path if self.name[k] in KEEP_WHOLE), None)
        if whole is None:                    # the subtree may stand around the article
            inside = [k for k in range(n) if self.name[k] in KEEP_WHOLE and not self.noise[k] and self._under(k, best)]
            whole = max(inside, key=lambda k: (c[k], -k), default=None)
            if whole is not None and 2 * c[whole] < c[best]:
                whole = None
        top = best if whole is None else whole
        keep = [False] * n
        for k in range(n):
            if k == top:
                keep[k] = True
            elif k and keep[self.parent[k]] and not self.noise[k]:
                keep[k] = self.inside[k] or not (self.name[k] in ("ul", "ol", "div", "section", "table") and 2 * lc[k] > c[k])
        blocks, now = [], []
        for node, text in self.runs:
            if node < 0:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif keep[node]:
                now.append(text)
        blocks.append("".join(now))
        return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)

    def _under(self, k: int, top: int) -> bool:
        while k > top:
            k = self.parent[k]
        return k == top


def main_text(page: str | None) -> str:
    return Page(page).main_text() if page else ""


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (page_id and url by default) with the main ``text``
    and ``n_chars``, its code points."""
    keep = list(keep if keep is not None else ["page_id", "url"])
    src = pages.select(*keep, F.col("html").alias("_html"))

    def run(batches):
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 256):
                out += [main_text(p) for p in b["_html"].slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in keep], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                names=[*keep, "text", "n_chars"])

    return src.mapInArrow(run, T.StructType([*[src.schema[c] for c in keep], T.StructField("text", T.StringType()),
                                             T.StructField("n_chars", T.LongType())]))
