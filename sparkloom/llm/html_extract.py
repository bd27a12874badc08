"""Main text of web pages: template deduction by equivalence classes of tokens, then the slots that are left.

Tokens are element paths (with classes) and whole text blocks, of every part of a page.  A token's occurrence vector over
the distinct pages of its host is kept as its support and the exclusive or of a hash of (page, count), so tokens with
equal vectors fall into one class by plain partial aggregates and no task ever holds a host.  Pages with equal tokens are
one page, so copies and repeated rows are no evidence of a template.  A class is valid if its support reaches
``max(min_pages, min_share * pages of the host)`` and it holds an element.  Classes nest by their paths: whatever holds a
token occurs wherever the token does, so the parents of a valid class are valid.

The template of a host has two parts.  Text blocks of valid classes are fixed text and go.  The region is the slot that
holds the articles: going down from the root along elements that stand once on nearly every page and hold over half of
the host's text, the last one before text stands beside it (a heading or a paragraph).  Slots outside the region go.  What
is left goes by roles: elements and attributes of menus, headers, footers, side bars, notices, adverts, forms and comments,
which also serve hosts with too few pages.  Outside of articles, blocks that are links for four fifths are menus.

Defined cases: null html is empty and gives an empty text; a null url is a host of its own; repeated rows are extracted
each; a page without any block in the region keeps its other slots, and one whose every slot is fixed text keeps its text;
an empty table gives an empty result; extra columns are not read.

At scale: templates hold block hashes of valid classes and one path a host; they are written and their sizes are summed.
At most ``small`` hashes and hosts are broadcast to where pages are parsed; more are joined by host and salt, so that a hot
host is spread over ``salts`` keys, and then blocks of text, not pages, are shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

#: Element names by role.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "title", "canvas", "audio", "video"}
#: Of these, what holds no elements: without an end tag it goes on to the end of the page.
TO_THE_END = {"script", "style", "textarea", "title", "iframe"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MATH = {"maction", "math", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none", "semantics", "annotation", "annotation-xml"}
INLINE = MATH | {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PARAGRAPH_ENDS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|masthead|footer|side-?bar|ads?|adverts?|advertisements?|adsense|promo(?:tion)?|sponsor(?:ed)?|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|sign-?up|log-?in|comments?|comment-?list|respond|replies|reply|disqus|share|sharing|social|related|recommended|read-?more|breadcrumbs?|pagination|pager|widget|toolbar|copyright|search(?:-?form|-?box)?|skip(?:-?link)?|disclaimer)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|top-?bar)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(/?)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)()>")
_ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in TO_THE_END}
_EDGE = {name: re.compile(rf"<{name}(?=[\s/>])[^>]*>|</{name}\s*>", re.I) for name in RAW - TO_THE_END}


#: Marks that only parts beside an article carry; the others may also stand on a frame around everything.
_BESIDE = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|respond|replies|reply|disqus|related|recommended|ads?|adverts?|advertisements?|promo|sponsored|cookies?|consent|newsletter)(?:$|[\s_-])", re.I)

INSIDE, DOUBTFUL, OUTSIDE_OF = 0, 1, 2


class Block:
    __slots__ = ("linked", "outside", "owner", "path", "text")

    def __init__(self, text: str, path: str, outside: int, owner: int, linked: float) -> None:
        self.text, self.path, self.outside, self.owner, self.linked = text, path, outside, owner, linked


def _unwanted(name: str, attrs: dict[str, str], inside: bool) -> int:
    """Does this element hold something else than the article?  Doubtful, if only a mark says so that frames carry as well.

    ``inside``: it stands in an article.
    """
    if name in OUTSIDE or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return OUTSIDE_OF
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return OUTSIDE_OF
    if name in ("html", "body", "main"):
        return INSIDE
    marks = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    if _BESIDE.search(marks):
        return OUTSIDE_OF
    if name == "header" and not inside:
        return OUTSIDE_OF
    if name != "article" and (_UNWANTED.search(marks) or (not inside and _HEADER.search(marks))):
        return DOUBTFUL
    return INSIDE


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the elements ``name`` end, by where they start; without those that are empty or never closed."""
    out: dict[int, int] = {}
    open_at: list[int] = []
    for m in _EDGE[name].finditer(page):
        if m[0].startswith("</"):
            if open_at:
                out[open_at.pop()] = m.end()
        elif name != "svg" or not m[0].endswith("/>"):
            open_at.append(m.start())
    return out


def blocks(page: str) -> tuple[list[Block], Counter]:
    """The blocks of text in order, and how often each element path opens."""
    out: list[Block] = []
    paths: Counter = Counter()
    stack: list[tuple[str, str, int, int]] = []  # name, path, outside, owner (number of the article or main, 0: none)
    text: list[str] = []
    ends: dict[str, dict[int, int]] = {}
    linked, owners, anchors = 0, 0, 0

    def flush() -> None:
        nonlocal text, linked
        whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if whole:
            _, path, outside, owner = stack[-1] if stack else ("", "", INSIDE, 0)
            out.append(Block(whole, path, outside, owner, linked / max(1, sum(map(len, text)))))
        text, linked = [], 0

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            text.append(page[at:start])
            linked += (start - at) * (anchors > 0)
        if start >= n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not m:
            text.append("<")
            at = start + 1
            continue
        at = m.end()
        closing, name = m[1], m[2].lower()
        if not closing and name in RAW:
            if name in TO_THE_END:
                end = _END[name].search(page, at)
                at = end.end() if end else n
            else:
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = ends[name].get(start, at)
            if name not in ("title",):
                text.append(" ")
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                text.append(" " if name != "wbr" else "")
            elif name in MATH:
                text.append(" " if not closing else "")
            elif name == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            continue
        flush()
        anchors = 0
        if closing:
            close(name)
            continue
        if name in PARAGRAPH_ENDS and stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3])}
        _, path, outside, owner = stack[-1] if stack else ("", "", INSIDE, 0)
        path = f"{path}/{name}.{attrs.get('class', '').replace('/', '_')}"
        paths[path] += 1
        if name in VOID or m[4]:
            continue
        own = _unwanted(name, attrs, owner > 0)
        outside = own if outside == DOUBTFUL and name in ("article", "main") else max(outside, own)
        if name in ("article", "main") and not outside and owner <= 0:
            owners += 1
            owner = owners
        elif name == "article" and not outside and owner > 0:
            owners += 1
            owner = owners
        stack.append((name, path, outside, owner))
    flush()
    return out, paths


def main_blocks(found: list[Block]) -> list[Block]:
    """The blocks that no role puts outside; blocks of links only within an article.  If nothing is left, doubtful ones count as well."""
    free = [b for b in found if b.outside == INSIDE and (b.owner or b.linked < 0.8)]
    return free or [b for b in found if b.outside == DOUBTFUL and b.linked < 0.8]


#: Elements that hold text of their own.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "figure", "dl"}


def page_tokens(found: list[Block], paths: Counter) -> tuple[list[tuple[int, int, bool, str, int, bool]], int]:
    """(token, count, is an element, path, characters within, text stands in it) of a page, and the page's own hash.

    The path is given for single elements with over half of the page's text only: no others can lead to the region.
    """
    chars: Counter = Counter()
    texts: Counter = Counter()
    own: set[str] = set()
    for b in found:
        texts[_hash(b.path, b.text)] += 1
        own.add(b.path)
        chars[b.path] += len(b.text)
    total = sum(chars.values())
    for path in sorted(paths, key=len, reverse=True):
        parent, _, last = path.rpartition("/")
        chars[parent] += chars[path]
        if last.partition(".")[0] in TEXT:
            own.add(parent)
    out = [(_hash(p), c, True, p if c == 1 and 2 * chars[p] > total else "", chars[p], p in own) for p, c in paths.items()]
    out += [(t, c, False, "", 0, False) for t, c in texts.items()]
    return out, _hash(*sorted(f"{t} {c} {e}" for t, c, e, _, _, _ in out))


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63


_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else url


def templates(pages: DataFrame, min_pages: int = 8, min_share: float = 0.5) -> DataFrame:
    """t_host, template (hashes of fixed text blocks) and region (a path, or null) of each host that has either."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in NAMES]
            for url, source in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                found, paths = blocks(source or "")
                all_tokens, one = page_tokens(found, paths)
                here, total = host_of(url), sum(len(b.text) for b in found)
                for row in [(0, 1, None, "", total, False), *all_tokens]:  # the first stands for the page itself
                    for column, value in zip(columns, (here, one, *row)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], NAMES)

    seen = pages.select("url", "html").mapInArrow(tokens, "host string, page long, token long, count long, element boolean, path string, chars long, texty boolean")
    seen = seen.dropDuplicates(["host", "page", "token", "element"])
    vectors = seen.groupBy("host", "token", "element").agg(
        F.count(F.lit(1)).alias("support"), F.bit_xor(F.xxhash64("page", "count")).alias("vector"), F.max("count").alias("most"), F.sum("chars").alias("chars"), F.max("path").alias("path"), F.max("texty").alias("texty")
    )
    vectors = keep(vectors.where(F.col("support") >= min_pages))
    hosts = vectors.where(F.col("element").isNull()).select(F.col("host").alias("p_host"), F.col("support").alias("pages"), F.col("chars").alias("all_chars"))
    frequent = vectors.where(F.col("element").isNotNull()).join(hosts, F.col("host").eqNullSafe(F.col("p_host"))).where(F.col("support") >= min_share * F.col("pages"))
    classes = frequent.groupBy("host", "support", "vector").agg(F.max("element").alias("valid"), F.collect_set(F.when(~F.col("element"), F.col("token"))).alias("texts"))
    fixed = classes.where(F.col("valid") & (F.size("texts") > 0)).groupBy(F.col("host").alias("t_host")).agg(F.flatten(F.collect_list("texts")).alias("template"))
    # Elements with over half of the text lie on one path from the root, so these lists are no longer than pages are deep.
    frame = F.col("element") & (F.col("path") != "") & (F.col("most") == 1) & (F.col("support") >= 0.9 * F.col("pages")) & (2 * F.col("chars") > F.col("all_chars"))
    line = frequent.where(frame).groupBy(F.col("host").alias("r_host")).agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), "path", "texty"))).alias("line"))
    start = F.struct(F.lit("").alias("path"), F.lit(False).alias("texty"))
    region = F.aggregate("line", start, lambda acc, e: F.when(acc["texty"], acc).otherwise(F.struct(e["path"].alias("path"), e["texty"].alias("texty"))), lambda acc: acc["path"])
    both = fixed.join(line.select("r_host", region.alias("region")), F.col("t_host").eqNullSafe(F.col("r_host")), "full")
    return both.select(F.when(F.col("template").isNotNull(), F.col("t_host")).otherwise(F.col("r_host")).alias("t_host"), F.coalesce("template", F.array().cast("array<bigint>")).alias("template"), "region")


NAMES = ["host", "page", "token", "count", "element", "path", "chars", "texty"]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_()]


def extract(pages: DataFrame, min_pages: int = 8, min_share: float = 0.5, small: int = 100_000, salts: int = 16, roles: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row.  Without ``roles``, templates alone decide."""
    kind = dict(pages.dtypes)["page_id"]
    block = "array<struct<text: string, token: long, path: string>>"
    block_type = pa.list_(pa.struct([("text", pa.string()), ("token", pa.int64()), ("path", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h or "")[0] for h in batch[2].to_pylist()]
            kept = [[{"text": b.text, "token": _hash(b.path, b.text), "path": b.path} for b in (main_blocks(f) if roles else f)] for f in found]
            hosts = pa.array([host_of(u) for u in batch[1].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], hosts, pa.array(kept, block_type)], ["page_id", "url", "host", "blocks"])

    source = pages.select("page_id", "url", "html")
    parsed = source.mapInArrow(parse, f"page_id {kind}, url string, host string, blocks {block}")
    template = keep(templates(source, min_pages, min_share))
    hashes = template.agg(F.sum(F.size("template") + 1)).first()[0] or 0
    if hashes <= small:
        d = parsed.join(F.broadcast(template), F.col("host").eqNullSafe(F.col("t_host")), "left")
    else:
        salted = template.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        own = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
        d = parsed.withColumn("salt", own).join(salted, F.col("host").eqNullSafe(F.col("t_host")) & (F.col("salt") == F.col("t_salt")), "left")
    free = F.filter("blocks", lambda b: F.col("template").isNull() | ~F.array_contains("template", b["token"]))
    d = d.withColumn("free", free)
    within = F.filter("free", lambda b: (b["path"] == F.col("region")) | F.startswith(b["path"], F.concat("region", F.lit("/"))))
    d = d.withColumn("within", within)
    slots = F.when(F.size("within") > 0, F.col("within")).when(F.size("free") > 0, F.col("free")).otherwise(F.col("blocks"))
    d = d.withColumn("text", F.array_join(F.transform(slots, lambda b: b["text"]), "\n\n"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
