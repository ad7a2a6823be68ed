"""Main text of web pages: parser events to lines, text-to-tag ratios smoothed by a Gaussian, threshold clustering.

Every line is the text between two block boundaries. Its text-to-tag ratio is its characters over the tags met in it,
linked ones counting for less. Tags and names are evidence that weighs on the ratio: text of elements that articles do
not hold (menus, footers, adverts) counts as none, text outside an article element for a fraction. Smoothed ratios, on a
log scale and not smoothed across the borders of such elements, are split into two clusters. The content region is the
smallest element that covers the content cluster and its headings. Its text are the lines of the content cluster, and
the short ones among them that nothing speaks against."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

# Element names and the words in class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("button canvas datalist frameset head iframe input noscript object option script select style svg template textarea title".split())
MARKED = frozenset("aside dialog footer form header menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply respond share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
WHOLE_MARKS = frozenset("header site-header page-header top-header aside".split())
PLACES = frozenset("area articles bar block bottom box buttons column container content inner item items left link links list main outer panel posts right row section slot top unit wrap wrapper".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody table ul ol dl blockquote pre figure figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html head option select title".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SIGMA, WIDTH, APART = 1.0, 3, 1.0  # clusters whose ratios are less than a factor e apart are one
LINKED, OUTSIDE = 0.1, 0.125  # what a character counts in a link, and outside the article elements of a page that has some
MENU = 0.8  # a line with this share of its characters in links is no text unless its element holds content

_words = re.compile(r"[a-z0-9]+")
_space = re.compile(r"\s+")


def boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is marked as one of those that an article does not hold. A name of several words is such a
    mark if its last word is, or if all its words are marks or name places on a page."""
    if tag in MARKED:
        return True
    if tag in ("article", "main", "body", "html"):
        return False
    for key, value in attrs:
        if key == "hidden" and (value or "").lower() != "until-found":
            return True
        value = (value or "").lower()
        if key == "role" and value.strip() in ROLES or key == "aria-hidden" and value.strip() == "true":
            return True
        if key in ("class", "id"):
            for name in value.split():
                words = _words.findall(name)
                if name in WHOLE_MARKS:
                    return True
                if words and not name.startswith(("no-", "has-", "with-", "without-")) and (words[-1] in MARKS or words[0] in MARKS and all(w in MARKS or w in PLACES or w.isdigit() for w in words)):
                    return True
    return False


class Line:
    """The text between two block boundaries: its characters, those in links, the tags met, the element it is in, and
    the outermost marked and article elements around it (0 for none)."""

    __slots__ = ("text", "linked", "tags", "node", "mark", "article", "heading")

    def __init__(self, text: str, linked: int, tags: int, node: int, mark: int, article: int, heading: bool) -> None:
        self.text, self.linked, self.tags, self.node, self.mark, self.article, self.heading = text, linked, tags, node, mark, article, heading


class Lines(HTMLParser):
    """Streams events into lines; `parents` and `kinds` hold each element's parent, and its name and class, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents, self.kinds = [-1], [("", "")]
        self.open: list[tuple[str, int, int, int, bool]] = [("", 0, 0, 0, True)]  # tag, node, mark, article, whether it is shown
        self.counts: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.text:
            text = _space.sub(" ", "".join(self.text)).strip()
            if text:
                _, node, mark, article, _ = self.open[-1]
                self.lines.append(Line(text, min(self.linked, len(text)), self.tags, node, mark, article, any(self.counts[h] for h in HEADINGS)))
                self.tags = 0
            self.text, self.linked = [], 0

    def pop(self, names: tuple[str, ...] | frozenset[str], until: frozenset[str]) -> None:
        """Closes the nearest open element of these names, with all above it, unless one of `until` stands between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                for tag, *_ in self.open[i:]:
                    self.counts[tag] -= 1
                del self.open[i:]
                return
            if self.open[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            if tag in CLOSES_P and self.counts["p"]:
                self.pop(("p",), frozenset(("td", "th", "li", "div", "article", "section", "main", "aside", "form")))
            if tag in SIBLINGS:
                self.pop(tuple(SIBLINGS[tag].split()), frozenset(("ul", "ol", "dl", "table", "menu", "select")))
        if tag in VOID:
            return
        _, node, mark, article, shown = self.open[-1]
        marked, is_article = not mark and boilerplate(tag, attrs), not article and (tag in ("article", "main") or ("role", "main") in attrs)
        if marked:
            self.flush()
        if tag in BLOCK or marked or is_article:
            self.parents.append(node)
            self.kinds.append((tag, dict(attrs).get("class") or ""))
            node = len(self.parents) - 1
        self.open.append((tag, node, node if marked else mark, node if is_article else article, shown and tag not in UNSEEN))
        self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or self.open[-1][2]:
            self.flush()
        if self.counts[tag] > 0:
            self.pop((tag,), frozenset())

    def handle_data(self, data: str) -> None:
        if self.open[-1][4]:
            self.text.append(data)
            if self.counts["a"]:
                self.linked += len(data.strip())


def content_cluster(lines: list[Line]) -> np.ndarray:
    """Text-to-tag ratios of the lines, smoothed on a log scale and split in two by iterated mean thresholds; True for
    the higher part. Lines whose text counts as none are never content."""
    inside = any(x.article and not x.mark for x in lines)
    ratio = np.array([0.0 if x.mark else (len(x.text) - (1 - LINKED) * x.linked) / max(1, x.tags) * (OUTSIDE if inside and not x.article else 1.0) for x in lines])
    part = np.cumsum([i > 0 and (x.mark, x.article) != (lines[i - 1].mark, lines[i - 1].article) for i, x in enumerate(lines)])
    value, total, weight = np.log1p(ratio), np.zeros(len(lines)), np.zeros(len(lines))
    for d in range(-WIDTH, WIDTH + 1):
        here, there = slice(max(0, -d), len(lines) - max(0, d)), slice(max(0, d), len(lines) - max(0, -d))
        if abs(d) < len(lines):
            near = np.exp(-(d**2) / (2 * SIGMA**2)) * (part[here] == part[there])
            total[here] += near * value[there]
            weight[here] += near
    smooth = total / weight
    cut = smooth.mean()
    for _ in range(100):
        low, high = smooth[smooth < cut], smooth[smooth >= cut]
        if not len(low) or not len(high) or abs((new := (low.mean() + high.mean()) / 2) - cut) < 1e-9:
            break
        cut = new
    low, high = smooth[smooth < cut], smooth[smooth >= cut]
    if len(low) and low.min() > 0 and high.mean() - low.mean() < APART:
        cut = 0.0
    return (smooth >= cut - 1e-9) & (smooth > 0)


def main_text(html: str | None) -> str:
    """The article's lines joined by newlines; empty where there is none. Takes any string, broken markup too."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines, parents = page.lines, page.parents
    if not lines:
        return ""
    content = content_cluster(lines)
    inside = any(x.article and not x.mark for x in lines)
    plain = [not x.mark and (bool(x.article) or not inside) for x in lines]  # nothing speaks against these
    covered, holds, free_lines = [0] * len(parents), [False] * len(parents), [0] * len(parents)
    for x, chosen, free in zip(lines, content, plain):
        covered[x.node] += bool(chosen or free and x.heading)
        holds[x.node] |= bool(chosen)
        free_lines[x.node] += free
    if not any(holds):
        return ""
    for i in range(len(parents) - 1, 0, -1):
        covered[parents[i]] += covered[i]
        free_lines[parents[i]] += free_lines[i]
    home = max(i for i, n in enumerate(covered) if n == covered[0])
    alike = Counter((parents[i], page.kinds[i]) for i, n in enumerate(free_lines) if n)
    while home and (page.kinds[home][0] in PARAGRAPHS or alike[parents[home], page.kinds[home]] > 1):
        home = parents[home]  # one long paragraph among others is not the article
    within = [i == home for i in range(len(parents))]
    for i in range(home + 1, len(parents)):
        within[i] = within[parents[i]]
    return "\n".join(x.text for x, chosen, free in zip(lines, content, plain) if within[x.node] and (chosen or free and (x.linked < MENU * (len(x.text) - x.text.count(" ")) or x.heading or holds[max(0, parents[x.node])])))


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html), by main_text.

    Null html is empty, so text is "" and n_chars 0; null page_id and url stay null; repeated rows give repeated
    rows; an empty table gives none; other columns are not read. Whole pages are parsed whatever their length."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
