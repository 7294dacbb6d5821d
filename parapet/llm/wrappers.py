"""Main text of web pages by wrappers: union-free regular expressions inferred per host."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.session import cut_lineage

#: Elements by their part in a page, and words in a class, id or role that name such parts.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style textarea title iframe noembed noframes noscript template svg math object"
    " button select datalist canvas video audio map".split()
)
DROPPED = frozenset("head nav footer aside form menu dialog fieldset".split())
MAIN = frozenset(("article", "main"))
LAYOUT_WORDS = frozenset(
    "nav navbar navigation menu sidebar side header masthead topbar footer banner breadcrumb breadcrumbs toolbar"
    " widget complementary contentinfo search skip".split()
)
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal"
    " dialog newsletter subscribe signup login form comment comments disqus replies reply respond share sharing social"
    " related recommended trending pagination pager copyright legal disclaimer hidden".split()
)
#: Words that may stand beside those in a name; a name with any other word tells of something else (share-price).
COMPANIONS = frozenset(
    "area bar block body bottom box button buttons card cell center col column container content count counter frame"
    " group heading icon icons inner item items label left link links list main module outer panel post posts primary"
    " right row secondary section slot space text title top unit view wrap wrapper".split()
)
#: Names that an id may drop an element by inside an article, where ids are often the subject of a section.
READERS = frozenset("comment comments disqus replies respond".split())
#: Elements that an opening tag of the same row closes.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
BOUNDS = frozenset(("ul", "ol", "dl", "table", "article", "main", "body", "section", "div"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_SPACE = re.compile(r"\s+")


def host(url):
    """The host part of a URL column in lower case, without a port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name in lower case; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    shown = "hidden" not in attributes and attributes.get("aria-hidden", "").strip().lower() != "true"
    return not shown or bool(_NOT_SHOWN.search(attributes.get("style", "")))


def _signature(attributes: dict[str, str]) -> str:
    """The first class or id, as part of a path."""
    for name, value in attributes.items():
        if name in ("class", "id") and value.split():
            return "." + re.sub(r"[0-9]+", "0", value.split()[0])
    return ""


def _kind(attributes: dict[str, str], inside: bool) -> str:
    """How an element drops by its names: as a part, as layout, "mixed" if it has other names besides, or not ("").

    A name counts if it is made of listed words and companions only. Inside an article (``inside``) an id counts only if
    it tells of readers' comments.
    """
    names = []
    for attribute in ("class", "id", "role"):
        own = [{w.lower() for w in _WORDS.findall(name)} for name in attributes.get(attribute, "").split()]
        names += [words for words in own if words and (attribute != "id" or not inside or words & READERS)]
    for listed, kind in ((OTHER_WORDS, "part"), (LAYOUT_WORDS, "layout")):
        known = OTHER_WORDS | LAYOUT_WORDS
        telling = [bool(words & known) and words <= known | COMPANIONS for words in names]
        if any(tells and words & listed for tells, words in zip(telling, names)):
            return kind if all(telling) else f"mixed {kind}"
    return ""


def blocks_of(page: str) -> list[tuple[str, str, bool, bool]]:
    """The text blocks of a page in order: ``(path, text, main, head)``.

    ``path`` joins the open block elements, a tag with its first class or id each; ``main`` says that an article or
    main element is open, ``head`` that a header is, which may be the site's or that of the text: the wrapper tells. Menus,
    adverts and the like are left out. Tags left open are closed by
    what follows them, as browsers do for paragraphs, items and cells.

    A form, and an element known by names of layout, is no such part if it holds an article; a main element inside
    lifts any drop by name. On pages without article and main, a form stays if it holds over half of the text; where nothing
    is left, so does an element that has another name besides (``content widget``).
    """
    found: list[tuple[str, str, bool, bool, list]] = []  # the last: elements that drop the block
    stack: list[tuple[str, str, list]] = []  # tag, signature, how it drops: [] or ["hard"] or the kind by its names
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            drops = [drop for *_, drop in stack if drop]
            if text and ["hard"] not in drops:
                path = "/".join(signature for _, signature, _ in stack)
                tags = [tag for tag, *_ in stack]
                main = any(tag in MAIN for tag in tags)
                found.append((path, text, main, "header" in tags and not main, drops))

    def close(tags: tuple[str, ...], bounds: frozenset[str] = BOUNDS) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in bounds:
                return

    def text(piece: str) -> None:
        if piece:
            held.append(html.unescape(piece))

    at = 0
    while tag := _TOKEN.search(page, at):
        text(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA["):
                held.append(tag[0][9:].removesuffix("]]>"))
            continue
        ends, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in RAW:
            if not ends and not _SELF_CLOSED.search(attributes):
                over = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = over.end() if over else len(page)
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        if ends:
            close((name,), frozenset())
            continue
        if name in VOID:
            continue
        close(CLOSES.get(name, ()))
        close(("p",))
        own = _attributes(attributes)
        inside = any(t in MAIN for t, *_ in stack)
        drop = []
        if name in DROPPED or _hidden(own):
            drop = ["form"] if name == "form" and not _hidden(own) else ["hard"]
        elif name not in ("html", "body", "main") and (kind := _kind(own, inside)):
            drop = [] if name == "article" and kind.endswith("layout") else [kind]
        if name in MAIN and not drop:
            # Such a name on what holds the article names the layout and not the part.
            def lifted(d: list) -> bool:
                return d != ["hard"] and (name == "main" or d == ["form"] or d[0].endswith("layout"))

            stack[:] = [(t, s, [] if d and lifted(d) else d) for t, s, d in stack]
        stack.append((name, name + _signature(own), drop))
    text(page[at:])
    flush()
    kept = [block for block in found if not block[4]]
    if not any(main for _, _, main, *_ in kept):
        for kinds in (("form",), ("form", "mixed")):
            able = [block for block in found if all(d[0].startswith(kinds) for d in block[4])]
            sizes: dict[int, int] = {}
            for _, own, _, _, drops in able:
                for d in drops:
                    sizes[id(d)] = sizes.get(id(d), 0) + len(own)
            half = sum(len(own) for _, own, *_ in able) / 2
            kept = [block for block in able if all(sizes[id(d)] > half for d in block[4])]
            if kept:
                break
    return [block[:4] for block in kept]


# A wrapper is a list of nodes. A slot is ["t", path, text, its hash or None, characters, pages]; groups are ["*", nodes]
# (once or more) and ["?", nodes] (once or not at all).


def _shape(node: list) -> str:
    """What has to agree for two nodes to be aligned."""
    if node[0] == "t":
        return node[1]
    return "(" + " ".join(map(_shape, node[1])) + ")"


def _merge(a: list, b: list) -> list:
    """One node for two of the same shape; texts that differ become an open slot."""
    if a[0] == "t":
        return ["t", a[1], a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4]]
    kind = "*" if "*" in (a[0], b[0]) else "?"
    return [kind, [_merge(x, y) for x, y in zip(a[1], b[1])]]


def fold(nodes: list, longest: int = 8) -> list:
    """Turn runs of equal-shaped groups, of up to ``longest`` nodes, into repeated groups."""
    for width in range(1, longest + 1):
        out, at = [], 0
        shapes = [_shape(n) for n in nodes]
        while at < len(nodes):
            group, own, to = nodes[at : at + width], shapes[at : at + width], at + width
            while len(own) == width and shapes[to : to + width] == own:
                group = [_merge(x, y) for x, y in zip(group, nodes[to : to + width])]
                to += width
            if to > at + width:
                out.append(group[0] if width == 1 and group[0][0] == "*" else ["*", group])
                at = to
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def _bare(node: list) -> str:
    """A shape by which a group and a single one of it agree."""
    inner = node[1] if node[0] != "t" else [node]
    return " ".join(map(_shape, inner))


def align(a: list, b: list, rest: dict[str, list] | None = None) -> list:
    """The wrapper of two wrappers: aligned nodes merge, others become optional.

    A repeated group and a single instance of it agree and stay repeated. ``rest`` takes what ``bounded`` leaves out.
    """
    out = []
    steps = SequenceMatcher(None, [_bare(n) for n in a], [_bare(n) for n in b], autojunk=False).get_opcodes()
    for step, i, j, k, m in steps:
        if step == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                inner = [_merge(u, v) for u, v in zip(
                    x[1] if x[0] != "t" else [x], y[1] if y[0] != "t" else [y]
                )]
                kinds = {x[0], y[0]}
                if "*" in kinds or "?" in kinds:
                    out.append(["*" if "*" in kinds else "?", inner])
                else:
                    out += inner
        else:
            out += [n if n[0] in "?*" else ["?", [n]] for n in [*a[i:j], *b[k:m]]]
    return bounded(fold(out), rest=rest)


def _content(text: str) -> str:
    """What stands for a text in a slot: itself, or a hash of the whole if it is long."""
    return text if len(text) <= 200 else "#" + xxhash.xxh128_hexdigest(text.encode("utf-8", "surrogatepass"))


def page_wrapper(blocks: list[tuple]) -> list:
    return fold([["t", path, _content(text), len(text), 1] for path, text, *_ in blocks])


def _pages(node: list) -> int:
    return node[4] if node[0] == "t" else max(map(_pages, node[1]))


def bounded(nodes: list, most: int = 512, rest: dict[str, list] | None = None) -> list:
    """The wrapper, made smaller if it has more than ``most`` nodes.

    Optional nodes of one shape become one, at the place of the first, with all their pages and characters. Of those
    that are left, the ones seen on the fewest pages leave the wrapper for ``rest``, by shape and with all that they
    count. So what is aligned stays as it is in size however many pages follow, and ``settled`` counts every node.
    """
    if len(nodes) <= most:
        return nodes
    out, place = [], {}
    for node in nodes:
        shape = _bare(node)
        if node[0] == "?" and shape in place:
            out[place[shape]] = _merge(out[place[shape]], node)
            continue
        if node[0] == "?":
            place[shape] = len(out)
        out.append(node)
    spare = sorted((_pages(n), -i) for i, n in enumerate(out) if n[0] == "?")[: max(0, len(out) - most)]
    gone = {-i for _, i in spare}
    if rest is not None:
        for i in gone:
            shape = _bare(out[i])
            rest[shape] = _merge(rest[shape], out[i]) if shape in rest else out[i]
    return [node for i, node in enumerate(out) if i not in gone]


def constants(wrapper: list, least: int = 3) -> list[str]:
    """The slots that hold one text on most pages, on ``least`` at least: the template's own, as ``path text``."""
    single = [node for node in wrapper if node[0] == "t"]
    single += [node[1][0] for node in wrapper if node[0] == "?" and node[1][0][0] == "t" and len(node[1]) == 1]
    pages = max([node[4] for node in single], default=0)
    return [f"{n[1]} {n[2]}" for n in single if n[2] is not None and n[4] >= least and 2 * n[4] >= pages]


def _leaves(nodes: list) -> list[list]:
    """The slots of nodes and of the groups in them, in order."""
    return [slot for node in nodes for slot in ([node] if node[0] == "t" else _leaves(node[1]))]


def container(wrapper: list) -> str:
    """The path of the element that holds the main text.

    From the root down, it follows the child element that holds most of the open (varying) text, as long as
    that holds at least two thirds of it. Constant texts are the template's; only where nothing varies
    all text counts.
    """
    slots = _leaves(wrapper)
    slots = [s for s in slots if s[2] is None] or slots
    total, path = sum(s[3] for s in slots), ""
    while total:
        sizes: dict[str, int] = {}
        for _, own, _, n, _ in slots:
            if own.startswith(path) and "/" in own[len(path):]:
                child = path + own[len(path):].split("/", 1)[0] + "/"
                sizes[child] = sizes.get(child, 0) + n
        best = max(sizes, key=lambda c: (sizes[c], c), default="")
        if not best or 3 * sizes[best] < 2 * total:
            break
        path = best
    return path


def main_text(page: str, path: str | None, fixed: frozenset[str] | None = None) -> str:
    """The blocks of a page below ``path``, the container of its host's wrapper, one to a line.

    Where the container still holds a whole layout with an article or main element, only that element's
    blocks count. Otherwise the wrapper's constant slots (``fixed``, see ``constants``) are left out as the template's, and a
    header below the container is the text's own if it varies; without a wrapper of several pages (``fixed`` none) headers
    are the site's. A page that has nothing below ``path`` goes by its article, or else by its own wrapper.
    """
    found = blocks_of(page)
    if not fixed:
        found = [block for block in found if not block[3]]
    below = [block for block in found if path is None or block[0].startswith(path)]
    if not below:
        own_path = container(page_wrapper(found))
        below = [b for b in found if b[2]] or [b for b in found if b[0].startswith(own_path)]
    inside = [block for block in below if block[2]]
    if not inside and fixed:
        varying = [b for b in below if f"{b[0]} {_content(b[1])}" not in fixed]
        # a page that shows nothing of its own is all text, but for headers
        below = varying or [b for b in below if not b[3]]
    return "\n".join(text for _, text, *_ in inside or below)


_PART = "host string, shape string, wrapper string"


def _parts(own: dict[str, list], rests: dict[str, dict[str, list]]) -> pd.DataFrame:
    """Wrappers of hosts (``shape`` null) and the nodes that left them, as rows."""
    rows = [(name, None, json.dumps(wrapper)) for name, wrapper in own.items()]
    rows += [(name, shape, json.dumps(node)) for name, rest in rests.items() for shape, node in rest.items()]
    return pd.DataFrame(rows, columns=["host", "shape", "wrapper"], dtype=object)


def settled(found: DataFrame) -> DataFrame:
    """``(host, path, fixed)`` of wrappers and of the nodes that left them (``shape`` not null), over all slots.

    The same as ``container`` and ``constants`` of the unbounded wrapper, whose optional nodes of one shape are one: slots
    are added up by shape, characters by each element they stand in. The container is the deepest
    element with two thirds of them, which is one at each depth.
    """
    names = ("node", "alone", "place", "own", "text", "chars", "pages")

    @F.pandas_udf(
        "array<struct<node: string, alone: boolean, place: int, own: string, text: string, chars: bigint, pages: bigint>>"
    )
    def slots(shapes: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for shape, text in zip(shapes, texts):
            read, own = json.loads(text), []
            for i, node in enumerate(read if shape is None else [read]):
                # only optional nodes are known by their shape; others by their place in the wrapper
                name = _bare(node) if node[0] == "?" else f"={i}"
                leaves = _leaves([node])
                alone = node[0] == "t" or (node[0] == "?" and len(node[1]) == 1 and node[1][0][0] == "t")
                own += [(name, alone, j, *leaf[1:]) for j, leaf in enumerate(leaves)]
            out.append([dict(zip(names, row)) for row in own])
        return pd.Series(out, dtype=object)

    each = found.select("host", F.explode(slots("shape", "wrapper")).alias("s")).select("host", "s.*")
    same = (F.count("text") == F.count(F.lit(1))) & (F.min("text") == F.max("text"))
    each = each.groupBy("host", "node", "alone", "place", "own").agg(
        F.when(same, F.min("text")).alias("text"), F.sum("chars").alias("chars"), F.sum("pages").alias("pages")
    )
    each = cut_lineage(each, "slots")
    is_open = F.col("text").isNull()
    hosts = each.groupBy("host").agg(
        F.max(F.when(F.col("alone"), F.col("pages"))).alias("most"),
        F.max(is_open).alias("varies"),
        F.sum("chars").alias("all"),
        F.sum(F.when(is_open, F.col("chars"))).alias("open"),
    )
    hosts = hosts.withColumn("total", F.when(F.col("varies"), F.col("open")).otherwise(F.col("all"))).drop("all", "open")
    each = each.join(hosts, "host")
    enough = F.col("alone") & ~is_open & (F.col("pages") >= 3) & (2 * F.col("pages") >= F.col("most"))
    fixed = each.filter(enough).groupBy("host").agg(F.collect_set(F.concat("own", F.lit(" "), "text")).alias("fixed"))
    steps = F.split("own", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))
    )
    inside = each.filter((is_open | ~F.col("varies")) & F.col("own").contains("/"))
    inside = inside.select("host", "total", "chars", F.explode(above).alias("path"))
    inside = inside.groupBy("host", "total", "path").agg(F.sum("chars").alias("chars"))
    paths = inside.filter((3 * F.col("chars") >= 2 * F.col("total")) & (F.col("total") > 0))
    paths = paths.groupBy("host").agg(F.max_by("path", F.length("path")).alias("path"))
    rows = hosts.select("host").join(paths, "host", "left").join(fixed, "host", "left")
    none = F.array().cast("array<string>")
    return rows.select("host", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("fixed", none).alias("fixed"))


def wrappers(pages: DataFrame, fan: int = 32) -> DataFrame:
    """``(host, path, fixed, wrapper)``: the wrapper of each host over all its pages, as JSON, its container and constants.

    Each task folds its pages into one wrapper per host; wrappers then meet in rounds, at most ``fan`` of a host in one
    group, until each host has one. So a host with any share of the pages is spread over all tasks. Nodes that leave
    a wrapper on the way (see ``bounded``) are rows of their own; the container and the constants of their
    hosts are added up from all rows.
    """
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, list] = {}
        rests: dict[str, dict[str, list]] = {}
        for batch in batches:
            for name, page in zip(batch["host"], batch["html"]):
                new = page_wrapper(blocks_of(page or ""))
                rest = rests.setdefault(name, {})
                own[name] = align(own[name], new, rest) if name in own else new
                if len(rest) > 4096:
                    yield _parts({}, {name: rests.pop(name)})
            if len(own) > 4096 or sum(map(len, rests.values())) > 65536:
                yield _parts(own, rests)
                own, rests = {}, {}
        yield _parts(own, rests)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        own, rest = None, {}
        for text in sorted(group["wrapper"]):
            own = json.loads(text) if own is None else align(own, json.loads(text), rest)
        name = group["host"].iloc[0]
        return _parts({name: own}, {name: rest}).assign(part=int(group["part"].iloc[0]))

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(first, _PART)
    found = cut_lineage(found.withColumn("part", F.monotonically_increasing_id()), "wrappers")
    left = found.filter("shape is not null")
    found = found.filter("shape is null")
    # Numbers of one host's parts, gapless: parts of a host are at most one for each task or flush.
    most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while most > 1:
        # Hashed into groups of about half of ``fan``; one group is left when few enough are.
        groups = -(-most * 2 // fan) if most > fan else 1
        part = F.pmod(F.xxhash64("host", "part"), F.lit(groups)).cast("long")
        found = found.withColumn("part", part)
        found = found.groupBy("host", "part").applyInPandas(meet, _PART + ", part bigint")
        found = cut_lineage(found, "wrappers")
        left = left.unionByName(found.filter("shape is not null"))
        found = found.filter("shape is null")
        most = groups

    @F.pandas_udf("path string, fixed array<string>")
    def told(texts: pd.Series) -> pd.DataFrame:
        read = [json.loads(text) for text in texts]
        return pd.DataFrame({"path": [container(own) for own in read], "fixed": [constants(own) for own in read]})

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select("host", told("wrapper").alias("told"), "wrapper").select("host", "told.*", "wrapper")

    if left.isEmpty():
        return whole(found)
    hosts = cut_lineage(left.select("host").distinct(), "hosts")
    some = found.join(hosts, "host", "left_semi")
    counted = settled(some.unionByName(left).select("host", "shape", "wrapper"))
    return whole(found.join(hosts, "host", "left_anti")).unionByName(counted.join(some.select("host", "wrapper"), "host"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of each page.

    Wrappers are inferred from all pages of a host. Pages without a host share one. A null or empty page
    gives an empty text; repeated rows give equal results; an empty table gives no rows;
    further columns are ignored.
    """
    paths = cut_lineage(wrappers(pages).select("host", "path", "fixed"), "paths")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))

    @F.pandas_udf("string")
    def text(page: pd.Series, path: pd.Series, fixed: pd.Series) -> pd.Series:
        rows = zip(page, path, fixed)
        return pd.Series([main_text(h or "", p, frozenset(f) if f is not None else None) for h, p, f in rows], dtype=object)

    found = rows.join(paths, "host", "left").withColumn("text", text("html", "path", "fixed"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
