"""HTML extraction by equivalence classes of template tokens.

Pages of one host come from a template.  A token is a start tag, an end tag or
a piece of text, told apart by the path of open elements.  Its occurrence
vector says how often it occurs on each page of the host; tokens with equal
vectors form an equivalence class.  The vectors are never built: a token keeps
the exclusive or of a hash of (page, count), which Spark aggregates, so that
equal vectors have equal hashes.  Valid classes - in order, properly nested -
nest into the host's template, whose slots hold what varies.  Text in a class
with the template's own tags is template text: it counts for no slot and is
taken out of all.  Slots that hold most of the varying text, one in the other,
can be the main one: a page gives the outermost article-like one, or a deeper
one that leaves only template text.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written
from .words import chunks

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPACE = re.compile(r"\s+")

# Elements of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title textarea select button canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl div article section main td th nav aside footer header form blockquote".split())
HOLDERS = frozenset("html body main article section div td center".split())
APART = frozenset("nav aside footer form menu dialog".split())
APART_NAMES = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|notices?|comments?|replies|disqus\w*|sidebars?|menus?|nav(?:s|bar|igation)?|breadcrumbs?|footers?|share|sharing|social|related|newsletter|subscribe|popup|modal")
HEADER_NAMES = re.compile(r"headers?")
#: Elements that a name can set apart: no page frames, articles, headings or inline elements.
NAMED = BLOCKS - frozenset("html body main article h1 h2 h3 h4 h5 h6".split())

HEADING = re.compile(r"/h[1-6](?=[/\[|])")
ARTICLE = re.compile(r"(article|main)(\[|$)")
#: Begins an entry of a host's slots that is the hash of a text of its template, which pages lose; paths begin with '/'.
SAME = "="
#: The same of a text that is on most pages only: it stays, but a deeper slot need not hold it.
OFTEN = "~"

#: Pages from which on a host has a template; share of a host's pages that a template token is on; share of the text that the main slot holds at least;
#: pages from which on a text that all of them share is template text.
LEAST_PAGES, LEAST_SUPPORT, LEAST_MASS, SAME_PAGES = 3, 0.5, 0.5, 5
#: Bytes of templates that may be broadcast; beyond, pages are joined by host.
BROADCAST_BYTES = 8 << 20


class Element:
    """``apart``: by its or an outer element's tag, and once a page is parsed by names; ``named``: itself or the nearest outer element that has such a name."""

    __slots__ = ("tag", "path", "apart", "link", "named", "outer", "chars")

    def __init__(self, tag: str, path: str, apart: bool, link: bool, outer: Element | None = None, named: bool = False):
        self.tag, self.path, self.apart, self.link = tag, path, apart, link
        self.named, self.outer, self.chars = self if named else outer, outer, 0


def _label(tag: str, attributes: str) -> tuple[str, str]:
    """The element's name in paths, and its class, id and role."""
    names = ""
    if "=" in attributes:
        names = " ".join(sorted({v.strip("\"'").lower() for _, v in ATTRIBUTE.findall(attributes)} - {""}))
    return (f"{tag}[{names}]" if names else tag), names


def _set_apart(names: str, inside: bool) -> bool:
    """Whether a class, id or role, as a whole, sets a block apart; a header in an article (``inside``) belongs to it."""
    return any(APART_NAMES.fullmatch(n) or not inside and HEADER_NAMES.fullmatch(n) for n in names.split())


def parsed(page: str, slots=()) -> list[tuple[str, Element, str]]:
    """The page's events with names considered: a named element is apart unless it holds most of the page's text or, on its host, a slot."""
    got = list(events(page))
    if not any(e.named for kind, e, _ in got if kind == "start"):
        return got
    total = 0
    for kind, e, text in got:
        if kind == "text" and not e.apart:
            n, e = len(text.strip()), e.named
            total += n
            while e:
                e.chars += n
                e = e.outer
    for kind, e, _ in got:
        if kind == "start" and e.named:  # outer elements come first
            if e.named is not e:
                e.apart = e.apart or e.named.apart
            elif e.outer and e.outer.apart:
                e.apart = True
            elif 2 * e.chars <= total:
                e.apart = e.apart or not any(s == e.path or s.startswith(e.path + "/") for s in slots or ())
    return got


def events(page: str):
    """('start' | 'end' | 'text', element, text): tags in order, with omitted end tags supplied; text in hidden elements is skipped."""
    root = Element("", "", False, False)
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", stack[-1], page[at:]
            return
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag closes its element and all in it; without one it says nothing
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            while k and len(stack) > k:
                yield "end", stack.pop(), ""
            continue
        attributes = m[3] if m[2] else m[6]
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS else ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes or (stack[k].tag == "p" and tag in BLOCKS):
                while len(stack) > k:
                    yield "end", stack.pop(), ""
                break
            if stack[k].tag in SCOPES:
                break
        above = stack[-1]
        label, names = _label(tag, attributes)
        inside = bool(re.search("/(article|main)", above.path))
        apart = above.apart or tag in APART or tag in HIDDEN or tag == "header" and not inside
        named = bool(names) and tag in NAMED and _set_apart(names, inside)
        e = Element(tag, f"{above.path}/{label}", apart, above.link or tag == "a", above.named, named)
        yield "start", e, ""
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            yield "end", e, ""
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            yield "end", e, ""
            if close:
                at = (page.find(">", at) + 1) or end
        else:
            stack.append(e)
    while len(stack) > 1:
        yield "end", stack.pop(), ""


def host_of(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _text_key(path: str, text: str) -> str:
    return f"{path}|{xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def tokens_of(page: str) -> dict[tuple[str, str], list[int]]:
    """(kind, path) -> [occurrences, place of the first, characters of text outside links]; text tokens are pieces of text by hash."""
    found: dict[tuple[str, str], list[int]] = {}
    for place, (kind, e, text) in enumerate(parsed(page)):
        if kind == "text":
            text = text.strip()
            if not text or e.apart:
                continue
            mass = found.setdefault(("mass", e.path), [0, place, 0])
            mass[0] += 1
            mass[2] += 0 if e.link else len(text)
            key, chars = ("text", _text_key(e.path, text)), 0 if e.link else len(text)
        else:
            key, chars = (kind, e.path), 0
        row = found.setdefault(key, [0, place, 0])
        row[0] += 1
        row[2] += chars
    return found


def host_tokens(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A row per host and token: hash of the occurrence vector, pages, occurrences, mean place, characters.

    A task adds up the tokens of a chunk of pages before Spark does.
    """

    def run(batches):
        for b in chunks(batches, "html"):
            sums: dict[tuple, list] = {}
            for ident, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                host, key = host_of(url), f"{ident} {url} ".encode("utf-8", "surrogatepass")
                sums.setdefault((host, "page", ""), [0, 0, 0, 0, 0])[1] += 1
                for (kind, path), (n, place, chars) in tokens_of(page or "").items():
                    row = sums.setdefault((host, kind, path), [0, 0, 0, 0, 0])
                    row[0] ^= xxhash.xxh64_intdigest(key + str(n).encode()) - (1 << 63)
                    row[1] += 1
                    row[2] += n
                    row[3] += place
                    row[4] += chars
            cols = list(zip(*((*k, *v) for k, v in sums.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(cols)], names=["host", "kind", "path", "vector", "pages", "n", "place", "chars"])

    src = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = src.mapInArrow(run, "host string, kind string, path string, vector long, pages long, n long, place long, chars long")
    return rows.groupBy("host", "kind", "path").agg(F.bit_xor("vector").alias("vector"), *(F.sum(c).alias(c) for c in ("pages", "n", "place", "chars")))


def deduce(rows: pd.DataFrame) -> list[str]:
    """Of a host's tokens (those on enough pages): paths of slots that can be the main one, outermost first, and hashes of template texts (``SAME``, ``OFTEN``).

    Classes are ordered by support.  A class is valid if its start and end tags
    pair up in order; a valid class nests in the template if its elements lie
    in a slot of one that is there already.  Texts of such a class - those that
    come with the template's tags on all of at least ``SAME_PAGES`` pages - are
    template text, but for headings, which articles have alike.  Slots whose element occurs once a page and that holds
    ``LEAST_MASS`` of the varying text of the whole can be the main one, from
    the outermost article or main on, if there is any.
    """
    tags = rows[rows.kind.isin(["start", "end", "text"])].copy()
    if tags.empty:
        return []
    tags["at"] = tags["place"] / tags["pages"]
    template: list[tuple[str, float, float]] = []  # slots: path, where they open and close
    same: list[str] = []
    holder = lambda p: re.split(r"\[", p.rsplit("/", 1)[1])[0] in HOLDERS
    for (pages, _), members in sorted(tags.groupby(["pages", "vector"]), key=lambda g: (-g[0][0], g[1]["at"].min())):
        if len(members) < 2:
            continue
        starts = {r.path: r for r in members.itertuples() if r.kind == "start"}
        ends = {r.path: r for r in members.itertuples() if r.kind == "end"}
        pairs = [(p, s.at, ends[p].at, s.n == s.pages) for p, s in starts.items() if p in ends]
        valid = all(s <= e for _, s, e, _ in pairs) and all(not (s1 < s2 <= e1 < e2) for _, s1, e1, _ in pairs for _, s2, e2, _ in pairs)
        if not valid:
            continue
        nested = False
        for path, s, e, once in sorted(pairs, key=lambda p: p[1]):
            top = [t for t in template if path.startswith(t[0] + "/")]
            if once and (not template or top and all(t[1] <= s and e <= t[2] for t in top) or path.count("/") == 1):
                template.append((path, s, e))
                nested = True
        if nested and pages >= SAME_PAGES:
            same += [k for k in members.loc[members.kind == "text", "path"] if not HEADING.search(k)]
    mass = rows[rows.kind == "mass"][["path", "chars"]]
    texts = tags[tags.kind == "text"]
    constant = pd.DataFrame({"path": texts["path"].str.rsplit("|", n=1).str[0], "chars": -texts["chars"]})
    varying = pd.concat([mass, constant]).groupby("path")["chars"].sum().clip(lower=0)
    held = {p: int(varying[(varying.index == p) | varying.index.str.startswith(p + "/")].sum()) for p, _, _ in template}
    total = int(varying.sum())
    good = [p for p, m in held.items() if holder(p) and m >= LEAST_MASS * total and m > 0]
    good.sort(key=lambda p: (p.count("/"), -held[p], p))
    first = next((p for p in good if ARTICLE.match(p.rsplit("/", 1)[1])), good[0] if good else None)
    slots = [p for p in good if p == first or p.startswith(f"{first}/")]
    if not slots:
        return []
    out = set(same)
    often = [k for k in texts["path"] if k not in out and len(slots) > 1 and _within(p := k.rsplit("|", 1)[0], first) and not all(_within(p, s) for s in slots)]
    marked = lambda mark, keys: sorted({mark + xxhash.xxh64_hexdigest(k.encode("utf-8", "surrogatepass")) for k in keys})
    return slots + marked(SAME, (k for k in same if _within(k.rsplit("|", 1)[0], first))) + marked(OFTEN, often)


def _within(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def host_templates(tokens: DataFrame) -> DataFrame:
    """``host, slots``: a row for each host with a template, as a written table. Only tokens on ``LEAST_SUPPORT`` of a host's pages come together, however many pages it has."""
    # text of one page only is no template, and there is much of it
    tokens = written(tokens.filter("kind <> 'text' or pages > 1"), "html-tokens")
    sizes = tokens.filter("kind = 'page'").select("host", F.col("pages").alias("host_pages"))
    often = tokens.filter("kind <> 'page'").join(sizes, "host").filter((F.col("host_pages") >= LEAST_PAGES) & ((F.col("pages") >= LEAST_SUPPORT * F.col("host_pages")) | (F.col("kind") == "mass") & (F.col("pages") >= 0.01 * F.col("host_pages"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "slots": [deduce(pdf)]})

    out = written(often.groupBy("host").applyInPandas(run, "host string, slots array<string>"), "html-templates")
    drop_written(tokens)
    return out


def _token(e: Element, text: str) -> str:
    return xxhash.xxh64_hexdigest(_text_key(e.path, text).encode("utf-8", "surrogatepass"))


def _only_template(got, outer: str, inner: str, known: set[str]) -> bool:
    """Whether all text in ``outer`` and not in ``inner`` is in the template."""
    for kind, e, text in got:
        if kind == "text" and not e.apart and _within(e.path, outer) and not _within(e.path, inner) and (text := text.strip()):
            if _token(e, text) not in known:
                return False
    return True


def main_text(page: str, slots) -> str:
    """The blocks of the page's main slot, or of its article, main or body, joined by blank lines.

    The slot is the first that the page has; a deeper one takes its place as
    long as all other text is that of the host's template.  Blocks of nothing
    but template text are left out of it, unless the page has no others: then
    they are its article.
    """
    paths_of = [s for s in slots or () if s.startswith("/")]
    same, often = ({s[1:] for s in slots or () if s.startswith(mark)} for mark in (SAME, OFTEN))
    got = parsed(page, paths_of)
    paths = {e.path for kind, e, _ in got if kind == "start"}
    tags = {e.tag for kind, e, _ in got if kind == "start" and not e.apart}
    root = None
    for s in paths_of:
        if s in paths and (root is None or _within(s, root) and _only_template(got, root, s, same | often)):
            root = s
    by_tag = None if root else next((t for t in ("article", "main", "body", "html") if t in tags), "")
    below = root + "/" if root else None
    blocks: list[tuple[str, bool]] = []  # each with whether it has text of its own
    now: list[str] = []
    own = False

    def close():
        nonlocal own
        text = SPACE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            blocks.append((text, own))
        now.clear()
        own = False

    for kind, e, text in got:
        if kind == "text":
            if e.apart:
                continue
            if root:
                if e.path == root or e.path.startswith(below):
                    now.append(text)
                    own = own or not same or bool(t := text.strip()) and _token(e, t) not in same
            elif not by_tag or re.search(rf"/{by_tag}(?=[/\[]|$)", e.path):
                now.append(text)
        elif e.tag in BLOCKS:
            close()
        elif e.tag == "br":
            now.append(" ")
    close()
    return "\n\n".join([t for t, mine in blocks if mine] or [t for t, _ in blocks])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: its main text, empty if it has none.

    Null html counts as empty and a null or odd url as a host of its own name
    ''.  Hosts with fewer than ``LEAST_PAGES`` pages, and pages without any
    slot of their host, give their article, main or body.  A host's template
    is made of tokens on ``LEAST_SUPPORT`` of its pages; text is left out of
    the main slot if the template has it on all of its pages, ``SAME_PAGES``
    at least.  Repeated rows give equal texts; an empty table gives an empty result; other columns are not
    read.
    """
    spark = pages.sparkSession
    templates = host_templates(host_tokens(pages, id_col, url_col, html_col))
    size = templates.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.concat_ws(",", "slots")) + F.length("host")), F.lit(0)).alias("b")).first()
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, url string, text string, n_chars long"

    def texts(b, slots):
        out = [main_text(page or "", s) for page, s in zip(b.column(2).to_pylist(), slots)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    src = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if size["b"] + 64 * size["n"] <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r.host: list(r.slots) for r in templates.collect()})

        def run(batches):
            for b in chunks(batches, "html"):
                yield texts(b, [known.value.get(host_of(u)) for u in b.column(1).to_pylist()])

        return src.mapInArrow(run, schema)

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    joined = src.withColumn("_host", host).join(templates.withColumnRenamed("host", "_host"), "_host", "left").select(id_col, "url", "html", "slots")

    def run_joined(batches):
        for b in chunks(batches, "html"):
            yield texts(b, b.column(3).to_pylist())

    return joined.mapInArrow(run_joined, schema)
