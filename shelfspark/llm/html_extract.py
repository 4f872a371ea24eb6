"""Main text of pages by a tree-structured graphical model over the DOM.

Every element is content or not. An element's potential comes from its features (tag, hints in class, id and role, text
length, share of link text); parent and child are tied by a 2 x 2 potential for each kind of child. Sum-product messages
go up the tree and down again (all pages of a batch together, level by level) and give the marginal probability of
content for each element; text of elements above one half is kept, block by block.

What a page's markup says by its own words (a tag like nav, a class like comments) is strong evidence; names that may tell of
the text itself (side-effects, share-price, alert) are weak, and so are tags like p, lengths and link shares: such an
element mostly follows its parent. Below an element that speaks against content, tags and lengths say nothing for it.
The potentials are trained from labelled pages: pages whose url names a document, where a text of LEAST_LABEL characters or
more is content if it is a whole line of that document, and is not if the document does not contain it; other texts are not
labelled. Of at most MOST_PAGES pages, least hashes of page_id first, all pages of one layout (its tags and hints) count
for each feature as one. Counts meet pseudo-counts of the prior, from the hint alone to the hint with its place and length
to the whole feature, so what the labelled layouts lack keeps its prior, and what many of them hold is learned.

Null or empty html, and pages without content, give an empty text. Malformed markup is read as browsers do in the common
cases: unclosed and misnested elements, stray tags and bare `&` and `<`. Repeated pages are rows of their own.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, each_batch, kept_in_worker, least_by_hash, release, stage, strings, table

MOST_PAGES = 2_000
#: Characters of a text that can be labelled, and the layouts that a prior weighs as much as.
LEAST_LABEL, STRENGTH = 25, 2.0
#: Fixed word lists after the HTML standard and common class names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option button".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo mrow msub msup mfrac msqrt mtext".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
HINTS = {
    "chrome": "nav navbar navigation menu header masthead footer foot sidebar side aside complementary contentinfo breadcrumb breadcrumbs toolbar topbar pagination pager search login signup".split(),
    "notice": "cookie cookies consent notice banner alert gdpr popup modal overlay newsletter subscribe subscription promo promotion".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors dfp adsense".split(),
    "comment": "comment comments commentlist reply replies disqus respond".split(),
    "related": "related recommended recommendations share sharing social tags tagcloud widget meta byline".split(),
    "content": "article content post entry main story body text".split(),
}
#: Words of these kinds that name parts of a text as well, and what stands beside a word in the name of a box.
UNSURE = {"alert": "notice", "discussion": "comment", "side": "chrome", "promotion": "notice", "search": "chrome", "tags": "related", "share": "related", "sharing": "related", "meta": "related"}
BESIDE = frozenset("slot box container wrapper wrap area section list item block bar buttons button links link icons icon posts post articles stories panel form unit top bottom left right main site page global inner outer primary secondary col column row group content text body html fixed sticky footer header title thread entry default module zone pane field input".split())
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws} | UNSURE
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A class token with one of these words tells of a state or a layout, not of what the element holds.
STATES = frozenset("has with without no not is open opened closed enabled disabled allowed count show hide active category tag format status type page template layout style theme color bg".split())
#: First headings of the parts of a page that are not its article.
HEADINGS = {"comment": re.compile(r"(?:\d+ )?(?:comments?|responses?|repl(?:y|ies)|discussion (?=\(?\d)|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))(?: \(?\d+\)?)?:?", re.I), "related": re.compile(r"(?:related|recommended|more) (?:posts?|articles?|stories|reading|for you|from .{1,40})|read (?:more|next)|you may also like|share this", re.I)}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Page:
    """Elements of a page in document order: parent, tag, features, and the blocks of text in them."""

    def __init__(self, text: str):
        self.parent, self.tag, self.hint, self.blocks = [-1], ["#root"], [""], []  # blocks: [owner, [pieces]]
        self.links = [0]
        self.own, self.anchored = [0], [False]  # the block that an element's text belongs to; inside a link of that block
        stack, at, block = [0], 0, None
        self.opened: dict[str, int] = {}
        for m in _TAG.finditer(text):
            if m.start() < at:
                continue
            if m.start() > at:
                block = self._text(stack, text[at : m.start()], block)
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if not self.opened.get(tag) and tag not in ("p", "br"):
                    block = block if tag in INLINE else None
                    continue
                if tag in ("p", "br") and not self.opened.get(tag):
                    block = None if tag == "p" else self._text(stack, " ", block)
                    continue
                if tag not in INLINE:
                    block = None
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        self._cut(stack, k)
                        break
                    if self.tag[stack[k]] in ("body", "html", "td", "th", "table") and tag in INLINE:
                        break
                continue
            if tag in VOID:
                block = self._text(stack, " ", block) if tag == "br" else block if tag in INLINE else None
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                if end is None and tag not in ("script", "style", "title", "textarea"):
                    continue
                at = end.end() if end else len(text)
                continue
            if tag not in INLINE:
                block = None
                self._close(stack, tag)
            node = len(self.parent)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.hint.append(self._hint(tag, m[3]) if m[3] else "")
            self.links.append(0)
            self.own.append(self.own[stack[-1]] if tag in INLINE else node)
            self.anchored.append(tag == "a" or self.anchored[stack[-1]] if tag in INLINE else False)
            self.opened[tag] = self.opened.get(tag, 0) + 1
            stack.append(node)
        if at < len(text):
            self._text(stack, text[at:], block)

    def _cut(self, stack: list[int], k: int) -> None:
        for i in stack[k:]:
            self.opened[self.tag[i]] -= 1
        del stack[k:]

    @staticmethod
    def _hint(tag: str, attributes: str) -> str:
        """What class, id and role say; with a `?` if it may tell of the text itself. Tokens are read one by one: one that is
        a word of HINTS as a whole counts first; in a compound one a word that speaks against content does, surely if
        what stands beside it names a box. An id of a heading is its text."""
        if tag in ("html", "body"):
            return ""
        whole, compound = [], []
        for a in _ATTRIBUTE.finditer(attributes):
            if a[1].lower() == "id" and tag in _HEADINGS:
                continue
            for token in (a[2] or a[3] or a[4] or "").split():
                words = [w.lower() for w in _WORD.findall(token)]
                if not words or not STATES.isdisjoint(words):
                    continue
                kinds = [(k, w) for w in words if (k := _HINT_OF.get(w))]
                if not kinds:
                    continue
                kind, word = next((x for x in kinds if x[0] != "content"), kinds[0])
                sure = kind == "content" or len(words) > 1 and all(w in _HINT_OF or w in BESIDE for w in words) or len(words) == 1 and word not in UNSURE
                sure = sure and not (len(words) > 1 and word == "alert")
                (whole if len(words) == 1 else compound).append(kind if sure else kind + "?")
        against = lambda kinds: next((k for k in sorted(kinds, key=lambda k: k.endswith("?")) if k != "content"), "")
        if against(whole) or whole or tag in ("article", "main"):
            return against(whole) or "content" * bool(whole)
        return against(compound) or "content" * bool(compound)

    def _close(self, stack: list[int], tag: str) -> None:
        """Closes what a new block element ends: an open paragraph (with inline elements in it), list items and cells."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        inline = len(stack)
        while inline > 1 and self.tag[stack[inline - 1]] in INLINE:
            inline -= 1
        if inline > 1 and tag in CLOSES_P and self.tag[stack[inline - 1]] == "p":
            self._cut(stack, inline - 1)
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in ends:
                self._cut(stack, k)
                break
            if self.tag[stack[k]] in ("ul", "ol", "dl", "table", "article", "div", "section", "body"):
                break

    def _text(self, stack: list[int], text: str, block: list | None) -> list | None:
        owner = self.own[stack[-1]]
        if block is None or block[0] != owner:
            if not text.strip():
                return None
            block = [owner, []]
            self.blocks.append(block)
        if self.anchored[stack[-1]]:
            self.links[owner] += len(text)
        block[1].append(text)
        return block


def clean(pieces: list[str]) -> str:
    """A block's text: character references decoded, white space to one blank, trimmed."""
    return _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()


def node_keys(page: Page) -> list[tuple[str, str]]:
    """(feature key, edge kind) of every element: tag, hint, length, share of links and place; tag, hint and place."""
    n = len(page.parent)
    length, hint, article = [0] * n, list(page.hint), [False] * n
    first: dict[int, int] = {}  # first children
    for i in range(1, n):
        first.setdefault(page.parent[i], i)
        article[i] = article[page.parent[i]] or page.tag[page.parent[i]] == "article"
    for owner, pieces in page.blocks:
        length[owner] += sum(map(len, pieces))
        up = page.parent[owner]
        if page.tag[owner] in _HEADINGS and first.get(up) == owner and not hint[up].rstrip("?") and page.tag[up] in ("div", "section"):
            title = clean(pieces)
            hint[up] = next((k for k, x in HEADINGS.items() if x.fullmatch(title)), "")
    whole, linked = list(length), list(page.links)
    for i in range(n - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
        linked[page.parent[i]] += linked[i]
    bounded = any(t in ("article", "main") and h in ("", "content") for t, h in zip(page.tag, hint, strict=True))
    out, place = [], [""] * n
    for i, (tag, h, size) in enumerate(zip(page.tag, hint, length, strict=True)):
        up = page.parent[i]
        if i:
            before = page.tag[up]
            sure = _against(hint[up]) or before in CHROME and not (before == "header" and article[up])
            place[i] = "under" if place[up] == "under" or sure else "in" if place[up] == "in" or before in ("article", "main") else ""
        kind = "none" if size == 0 else "short" if size < 40 else "some" if size < 160 else "long"
        if tag in ("#root", "html", "body") and bounded:
            tag += "+"  # a page that says where its article is
        elif tag == "header" and article[i]:
            tag = "article-header"
        links = "links" if (2 * page.links[i] > size if size else 2 * linked[i] > whole[i] > 0) else ""
        top = "top" if i and page.tag[up] in ("#root", "html", "body") else place[i]
        out.append((f"{tag}|{h}|{kind}|{links}|{place[i]}", f"{tag}|{h}|{top}"))
    return out


def _against(hint: str) -> bool:
    return hint not in ("", "content") and not hint.endswith("?")


def _prior(tag: str, hint: str, size: str, links: str, place: str) -> float:
    """Prior log odds of content."""
    if _against(hint) or tag in CHROME:
        return -8.0
    if place == "under":
        return -1.5
    odds = 2.0 if hint == "content" else -1.0 if hint else 0.0
    odds += 6.0 if tag in ("article", "main") else -3.0 if tag.endswith("+") else 0.5 if tag in ("p", *_HEADINGS, "blockquote", "pre", "figcaption") else 0.0
    odds += {"none": 0.0, "short": -0.2 if place else -0.8, "some": 0.3, "long": 0.8}[size]
    return odds - ((0.5 if place else 2.5) if links else 0.0)


def _prior_tie(tag: str, hint: str, place: str) -> float:
    """Prior log ratio with which a child takes its parent's side; a child of another nature, or of the whole page, is less tied."""
    if tag in CHROME or _against(hint) or tag in ("article", "main"):
        return 0.5
    return 1.0 if place == "top" else 2.0 if hint == "content" else 4.0


def _coarser(key: str) -> list[str]:
    """The features that a feature backs off to, coarsest first, and the feature itself."""
    parts = key.split("|")
    if len(parts) == 3:  # an edge
        return [f"*|{parts[1]}|{parts[2]}", key]
    _, hint, size, links, place = parts
    return [f"*|{hint}|*|*|{place}", f"*|{hint}|{size}|{links}|{place}", key]


class Model:
    """unary: key -> (content, other) layouts. tie: edge kind -> [same, different] layouts for parent content and not. Both hold
    the coarser keys as well."""

    def __init__(self, unary: dict[str, list[float]], tie: dict[str, list[float]], strength: float = STRENGTH):
        self.unary, self.tie, self.strength = unary, tie, strength
        self._u: dict[str, float] = {}
        self._t: dict[str, np.ndarray] = {}

    def _learned(self, prior: float, counts: list[tuple[float, float]]) -> float:
        """Log odds after the counts (yes, no) of ever finer features, each starting from what the one before says."""
        odds = float(prior)
        for yes, no in counts:
            p = 1 / (1 + np.exp(-np.clip(odds, -8, 8)))
            moved = np.log((yes + self.strength * p) / (no + self.strength * (1 - p)))
            odds += float(moved - np.log(p / (1 - p)))
        return odds

    def odds(self, key: str) -> float:
        """Log odds of content."""
        if key not in self._u:
            self._u[key] = self._learned(_prior(*key.split("|")), [tuple(self.unary.get(k, (0, 0))) for k in _coarser(key)])
        return self._u[key]

    def tied(self, kind: str) -> np.ndarray:
        """psi[parent state, child state]."""
        if kind not in self._t:
            prior = _prior_tie(*kind.split("|"))
            n = [self.tie.get(k, (0, 0, 0, 0)) for k in _coarser(kind)]  # parent not: child not, child is; parent is: child not, child is
            same = np.array([self._learned(prior, [(x[0], x[1]) for x in n]), self._learned(prior, [(x[3], x[2]) for x in n])])
            q = 1 / (1 + np.exp(-same))
            self._t[kind] = np.array([[q[0], 1 - q[0]], [1 - q[1], q[1]]])
        return self._t[kind]

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """P(content) of every element of every page: messages from the leaves up, then from the roots down."""
        keys = [node_keys(p) for p in pages]
        sizes = [len(p.parent) for p in pages]
        base = np.cumsum([0, *sizes])
        parent = np.concatenate([np.array(p.parent) + b * (np.array(p.parent) >= 0) for p, b in zip(pages, base, strict=False)])
        depth = np.zeros(len(parent), np.int64)
        for p, b in zip(pages, base, strict=False):
            d = [0] * len(p.parent)
            for i in range(1, len(d)):
                d[i] = d[p.parent[i]] + 1
            depth[b : b + len(d)] = d
        odds = np.array([self.odds(k) for page in keys for k, _ in page])
        psi = np.array([self.tied(e) for page in keys for _, e in page])
        levels = [np.flatnonzero(depth == k) for k in range(int(depth.max()) + 1)]
        logs = -np.logaddexp(0, np.stack([odds, -odds], 1))  # log potentials, then times messages from below
        up = np.zeros_like(logs)
        for level in levels[:0:-1]:
            m = np.einsum("npc,nc->np", psi[level], np.exp(logs[level] - logs[level].max(1, keepdims=True)))
            up[level] = np.log(m / m.sum(1, keepdims=True))
            np.add.at(logs, parent[level], up[level])
        belief = logs.copy()
        for level in levels[1:]:
            rest = belief[parent[level]] - up[level]
            m = np.einsum("npc,np->nc", psi[level], np.exp(rest - rest.max(1, keepdims=True)))
            belief[level] = logs[level] + np.log(m / m.sum(1, keepdims=True))
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))
        return [content[b : b + n] for b, n in zip(base, sizes, strict=False)]

    def texts(self, pages: list[Page]) -> list[str]:
        out = []
        for page, p in zip(pages, self.marginals(pages), strict=True):
            blocks = (clean(pieces) for owner, pieces in page.blocks if p[owner] > 0.5)
            out.append("\n\n".join(b for b in blocks if b))
        return out

    def to_json(self) -> str:
        return json.dumps([self.unary, self.tie, self.strength])


def page_counts(raw: str, text: str) -> tuple[int, dict[tuple[str, str, int], int]]:
    """A labelled page -> its layout (a hash of its tags and hints) and counts (kind, key, slot) of all features, coarser ones too.
    An element's label is that of its own text; one without labelled text of its own takes the majority of what is
    below it. The page as a whole (html, body) has none."""
    import xxhash

    page, whole, lines = Page(raw), _SPACE.sub(" ", text), {_SPACE.sub(" ", x).strip() for x in text.split("\n")}
    n = len(page.parent)
    yes, no = [0] * n, [0] * n
    for owner, pieces in page.blocks:
        t = clean(pieces)
        if len(t) >= LEAST_LABEL:
            yes[owner] += len(t) * (t in lines)
            no[owner] += len(t) * (t not in whole)
    for i in range(n - 1, 0, -1):
        yes[page.parent[i]] += yes[i]
        no[page.parent[i]] += no[i]
    label = [y > x for y, x in zip(yes, no, strict=True)]
    rows: dict[tuple[str, str, int], int] = {}
    keys = node_keys(page)
    for i, (key, edge) in enumerate(keys):
        if (yes[i] or no[i]) and page.tag[i] not in ("#root", "html", "body"):
            for k in _coarser(key):
                rows["unary", k, int(label[i])] = rows.get(("unary", k, int(label[i])), 0) + 1
            for k in _coarser(edge) if page.tag[page.parent[i]] not in ("#root", "html", "body") else ():
                slot = 2 * label[page.parent[i]] + label[i]
                rows["tie", k, slot] = rows.get(("tie", k, slot), 0) + 1
    return xxhash.xxh64_intdigest(" ".join(sorted({e for _, e in keys}))) >> 1, rows


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[tuple[str, str, int, int], int] = {}
    for b in each_batch(batches, 100):
        for raw, text in zip(strings(b, "html"), strings(b, "text"), strict=True):
            layout, found = page_counts(raw, text)
            for k, v in found.items():
                rows[*k, layout] = rows.get((*k, layout), 0) + v
    names = ["kind", "key", "slot", "layout", "n"]
    columns = list(zip(*((*k, v) for k, v in rows.items()), strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)


def model_of(rows: Iterable[tuple[str, str, int, float]]) -> Model:
    """(kind, key, slot, layouts) -> the model."""
    unary: dict[str, list[float]] = {}
    tie: dict[str, list[float]] = {}
    for kind, key, slot, n in rows:
        if kind == "unary":
            unary.setdefault(key, [0, 0])[1 - slot] += n
        else:
            tie.setdefault(key, [0, 0, 0, 0])[slot] += n
    return Model(unary, tie)


def fit(pages: DataFrame, docs: DataFrame) -> Model:
    """pages (page_id, url, html) whose url path holds a document's number, docs (doc_id, text) -> the model. Potentials
    are counts of at most MOST_PAGES pages, chosen before any html is read (of one page_id or doc_id one row counts); the
    counts sent to the driver are one row per feature key. Of a layout each feature has weight one, shared by its labels."""
    number = F.try_to_number(F.regexp_extract("url", "/([0-9]{1,12})(?:[/?#]|$)", 1), F.lit("999999999999")).cast("long")
    named = pages.where("html is not null and page_id is not null").select("page_id", number.alias("doc_id")).where("doc_id is not null")
    some = stage(least_by_hash(named, "page_id", MOST_PAGES).dropDuplicates(["page_id"]), "labelled-pages")
    chosen = pages.where("html is not null").select("page_id", "html").join(F.broadcast(some), "page_id").dropDuplicates(["page_id"])
    texts = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id").dropDuplicates(["doc_id"])
    found = chosen.join(texts, "doc_id").select("html", "text").mapInArrow(_counts, "kind string, key string, slot int, layout long, n long")
    each = found.groupBy("kind", "key", "layout", "slot").agg(F.sum("n").alias("n"))
    of = each.groupBy("kind", "key", "layout").agg(F.sum("n").alias("all"), F.collect_list(F.struct("slot", "n")).alias("slots"))
    shares = of.select("kind", "key", "all", F.explode("slots").alias("s")).groupBy("kind", "key", "s.slot").agg(F.sum(F.col("s.n") / F.col("all")).alias("n"))
    model = model_of((r["kind"], r["key"], r["slot"], r["n"]) for r in shares.collect())
    release(some)
    return model


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and n_chars (its code points) of every page."""
    spec = model.to_json()
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_in_worker("pages/model", spec, lambda: Model(*json.loads(spec)))
        for b in each_batch(batches, 100):
            texts = own.texts([Page(x) for x in strings(b, "html")])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, "html").mapInArrow(run, f"{kinds}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages, documents(spark, sf_dir)))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
