"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of elements: a node is an element path (tags with class and id, without
numbers that are a page's own), hashed.  Importance comes from entropies over the m pages that have the node.  A content block that k pages
show at this node has the entropy log k / log m, so a block on every page is worth nothing and one that stands alone
is worth 1; the mean over the blocks is the node's content importance.  A presentation node's importance is the entropy
of its layouts (child sequences), and mostly what hangs below it.  A block's importance is that of its node, and with
less weight that of the branch it hangs in.  Hosts with few pages lean on the tree of all hosts.

Evidence of tags and names is added to the importance.  What HTML itself says (menus, asides, forms, scripts, hidden
elements) and a class or id that is by itself the name of such a part decide; a class name that merely contains such
a word only lowers the importance, and text beside the page's article must be worth more than other text.  What stands
in an <article> or <main> stays unless it is named otherwise: readers' comments and teasers, which are articles by their tag, go
by their names, and a part whose name may be a subject (legal, search) goes if the tree finds it on every page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, ready, written

# Elements and name parts, as HTML and common practice have them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("head nav footer aside form button dialog menu script style textarea title noscript template svg math iframe object select fieldset audio video canvas".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
#: These close an open paragraph.
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Left out as well, without ending the block around them.
OUT_INLINE = frozenset("button select svg math object audio video canvas template noscript".split())
#: Words that name what is not the article, and their forms.
NOISE = re.compile(
    r"ads?|advert\w*|adv|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|aside|widgets?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|form|share|sharing|social|comments?|reply|replies|respond|disqus|related|recommended|pagination|pager|toolbar|skip|copyright|legal|disclaimer|discussions?|teasers?|more",
    re.I,
)
#: Of these, words that name what readers say or other articles: an <article> of that name is none.
TALK = re.compile(r"comments?|reply|replies|respond|disqus|discussions?|related|recommended|teasers?|more", re.I)
#: Words that may as well be what an article is about: within one the tree must agree.
TOPIC = frozenset("legal disclaimer copyright search form header more".split())
#: Words beside which such a word still names the element itself.
PLACE = frozenset("left right top bottom main site page global primary secondary list box bar wrap wrapper container inner outer links link item items area block section unit slot text title user blog web app mobile sticky fixed stories news articles posts latest popular body".split())
#: Beside these it names a part of the article, or that the element has or lacks such a part.
NOT_NOISE = frozenset("post article entry story content has no with without is not".split())
ROLE_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![^\s=/])""", re.I)
NAME = re.compile(r"""[A-Za-z][^\s/>"'=<]*""")
#: The rest of a tag, quoted values and all; nothing is tried twice.
REST = re.compile(r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>""")
#: Elements whose content is no markup, and what ends them.
SHUT = {t: re.compile(rf"</{t}[^>]*>", re.I | re.A) for t in ("script", "style", "textarea", "title", "iframe")}
DIGITS = re.compile(r"\d+")
NUMBERS = re.compile(r"\d{3,}")
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")

#: What is known of an element besides its importance.  NAMED: by its name no article, but one may stand inside.
EXCLUDED, ARTICLE, OPEN, HINTED, ARTICLE_HINTED, HEADING, INSIDE_NAMED, NAMED = range(8)
#: What is added to the importance of a block of these kinds; ARTICLE stays, EXCLUDED goes.
EVIDENCE = {OPEN: 0.0, HINTED: -0.35, ARTICLE_HINTED: 0.3, HEADING: 0.0}
#: What is added for text beside the page's article, headings aside.
BESIDE = -0.3


#: What attributes can say, the strongest last.
SAID = ("", "main", "hinted", "topic", "named", "talk", "out")


def names(attributes: str) -> tuple[str, str]:
    """The path part of an element's class and id, and what its attributes say: out, talk, named, topic, hinted, main or nothing.

    talk and named: by its name readers' words or other articles, or another part that is no article; topic: such a name that may be
    a subject; hinted: a name that contains such a word.
    """
    part, said = "", ""
    for m in ATTRIBUTE.finditer(attributes):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        name = m[1].lower()
        if name in ("class", "id"):
            part += "." + NUMBERS.sub("", value).strip() if name == "class" else "#" + DIGITS.sub("", value).strip()
            for word in value.split():
                parts = [p.lower() for p in PARTS.split(word) if p]
                noise = [p for p in parts if NOISE.fullmatch(p)]
                if not noise or not NOT_NOISE.isdisjoint(parts):
                    continue
                exact = all(p in noise or p in PLACE or p.isdigit() for p in parts)
                if all(p in TOPIC for p in noise) and not (exact and "more" in noise and len(parts) > 1):
                    told = "topic" if exact else "hinted"
                elif exact:
                    told = "talk" if any(map(TALK.fullmatch, noise)) else "named"
                else:
                    told = "hinted"
                said = max(said, told, key=SAID.index)
        elif name == "role":
            if value.lower() in ROLE_OUT:
                said = "out"
            elif value.lower() in ("main", "article"):
                said = max(said, "main", key=SAID.index)
        elif name == "hidden" or value.lower() == "true":
            said = "out"
    return part, said


def _node(parent: int, part: str) -> int:
    """A 63-bit name of the node `part` below `parent`."""
    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "replace"), seed=parent) >> 1


class Element:
    __slots__ = ("tag", "node", "kind", "block", "layout")

    def __init__(self, tag: str, node: int, kind: int, block: bool):
        self.tag, self.node, self.kind, self.block, self.layout = tag, node, kind, block, 0


ROOT = Element("", 0, OPEN, True)


def kind_of(tag: str, said: str, above: int) -> int:
    """The kind of an element below one of kind `above`."""
    inside = above in (ARTICLE, ARTICLE_HINTED)
    if above == EXCLUDED or tag in OUT or said == "out" or said == "talk" and tag not in ("html", "body") or tag == "header" and not inside:
        return EXCLUDED
    if tag in MAIN or said == "main":
        # Articles of such a name are notices, adverts and the like; one within what is named otherwise counts if the page has no other.
        return EXCLUDED if said == "named" else INSIDE_NAMED if above in (INSIDE_NAMED, NAMED) else ARTICLE
    if said == "topic" and inside:
        return ARTICLE_HINTED
    if said in ("named", "topic") and tag not in ("html", "body"):
        return EXCLUDED if inside or above == INSIDE_NAMED else NAMED
    if said == "hinted" and tag not in ("html", "body"):
        return {OPEN: HINTED, HEADING: HINTED, ARTICLE: ARTICLE_HINTED}.get(above, above)
    if tag == "h1" and above == OPEN:
        return HEADING
    return above


def blocks(page: str, layouts: list | None = None, parents: dict | None = None) -> list[tuple[int, int, str]]:
    """(kind, node, text) of each block in page order.

    Tags that close nothing are passed over, elements left open end with their parent; text outside any element
    counts as a block of the root; a tag that nothing ends is text.  The time is in proportion to the page's length.
    With `layouts` it gets (node, layout) of each element that has elements below, with `parents` each node's parent.
    """
    out: list[tuple[int, int, str]] = []
    stack: list[Element] = []
    tops: list[int] = []  # where the block elements stand in the stack
    opened: dict[str, int] = defaultdict(int)
    text: list[str] = []
    at, n, whole_quotes = 0, len(page), True
    say = text.append

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                e = stack[tops[-1]] if tops else ROOT
                out.append((EXCLUDED if e.kind == NAMED else e.kind, e.node, joined))

    def close(i: int) -> None:
        if tops and tops[-1] >= i:
            flush()
            while tops and tops[-1] >= i:
                tops.pop()
        for e in stack[i:]:
            opened[e.tag] -= 1
            if layouts is not None and e.layout:
                layouts.append((e.node, e.layout >> 1))
        del stack[i:]

    def chars(a: int, b: int) -> None:
        if stack and stack[-1].kind == EXCLUDED and not stack[-1].block:
            return
        piece = page[a:b]
        say(html.unescape(piece) if "&" in piece else piece)

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            chars(at, n)
            break
        if lt > at:
            chars(at, lt)
        after = page[lt + 1]
        if page.startswith("!--", lt + 1):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        shuts = after == "/"
        m = NAME.match(page, lt + 1 + shuts)
        if m is None:
            if after in "!?/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        rest = REST.match(page, m.end()) if whole_quotes else None
        if rest is None:
            whole_quotes = False  # a quote that nothing closes: from here on a tag ends at the first >
            end = page.find(">", m.end())
            if end < 0:  # no tag ends any more
                chars(lt, n)
                break
            end += 1
        else:
            end = rest.end()
        attributes = page[m.end() : end - 1]
        at = end
        tag = m[0].lower()
        if shuts:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in SHUT:
            found = SHUT[tag].search(page, at)
            at = found.end() if found else n
            continue
        is_block = tag not in INLINE and tag not in OUT_INLINE
        if is_block:
            top = stack[tops[-1]].tag if tops else ""
            if top in CLOSES.get(tag, ()) or top == "p" and tag in BLOCK:
                close(tops[-1])
            flush()
        part, said = names(attributes) if attributes and ("=" in attributes or "idden" in attributes) else ("", "")
        above = stack[-1] if stack else ROOT
        if is_block:
            kind = kind_of(tag, said, above.kind)
            parent = stack[tops[-1]] if tops else ROOT
            node = _node(parent.node, tag if tag in ("html", "body") else tag + part)
            if parent is not ROOT:
                parent.layout = _node(parent.layout, str(node)) | 1
            if parents is not None:
                parents[node] = parent.node
            tops.append(len(stack))
            stack.append(Element(tag, node, kind, True))
        else:
            # Names say little of what stands within a line.
            kind = EXCLUDED if above.kind == EXCLUDED or tag in OUT_INLINE or said == "out" else above.kind
            stack.append(Element(tag, above.node, kind, False))
        opened[tag] += 1
    close(0)
    flush()
    return out


def host_of(url) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url) if isinstance(url, str) else None
    return m[1].lower().removeprefix("www.") if m else ""


def _asked(found: list) -> set[int]:
    """The nodes of a page whose importance decides."""
    return {node for kind, node, _ in found if kind in EVIDENCE}


def _rows(pages: DataFrame) -> DataFrame:
    """Rows (host, node, kind, value, k, up), counted within each task.

    kind 0: k pages have the node (the one above it in `up`, null for the root); 1: k pages show the content `value` at it; 2: it has the
    layout `value` k times; 3: a page whose html has the hashes `value` and k asks for the node.
    """
    names = ["host", "node", "kind", "value", "k", "up"]

    def run(frames):
        count: dict[tuple[str, int, int, int], int] = defaultdict(int)
        ups: dict[tuple[str, int], int] = {}
        asks: set[tuple] = set()

        def take():
            f = [(h, p, kind, v, k, ups.get((h, p)) if kind == 0 else None) for (h, p, kind, v), k in count.items()]
            f += [(h, p, 3, a, b, None) for h, a, b, p in asks]
            count.clear(), ups.clear(), asks.clear()
            out = pd.DataFrame(f, columns=names)
            out["up"] = pd.array([u for *_, u in f], "Int64")
            return out

        for f in frames:
            for host, page, a, b in zip(f["host"], f["html"], f["a"].tolist(), f["b"].tolist()):
                if not isinstance(page, str):
                    continue
                layouts: list[tuple[int, int]] = []
                parents: dict[int, int] = {}
                found = blocks(page, layouts, parents)
                seen: set = set()
                for kind, node, text in found:
                    if kind == EXCLUDED:
                        continue
                    word = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1
                    if (host, node, 1, word) not in seen:
                        seen.add((host, node, 1, word))
                        count[host, node, 1, word] += 1
                    p = node
                    while p is not None and (host, p, 0, 0) not in seen:  # what is above a node that was seen was seen
                        seen.add((host, p, 0, 0))
                        count[host, p, 0, 0] += 1
                        if p in parents:
                            ups[host, p] = parents[p]
                        p = parents.get(p)
                known = {p for _, p, kind, _ in seen if kind == 0}
                for node, layout in layouts:
                    if node in known:
                        count[host, node, 2, layout] += 1
                asks |= {(host, a, b, node) for node in _asked(found)}
                if len(count) + len(asks) > 200_000:
                    yield take()
        if count or asks:
            yield take()

    return pages.select("host", "html", "a", "b").mapInPandas(run, "host string, node long, kind int, value long, k long, up long")


def _below(own: DataFrame) -> DataFrame:
    """(host, node, below): the mean content importance of all that hangs below each node, by the pages that have it.

    own: a written table (host, node, m, content, up).  Sums reach twice as far each time, so a tree of any depth takes the
    logarithm of its depth in joins: what a node holds within a distance, and the node that far above it.
    """
    mine = F.col("content").isNotNull()
    start = own.select("host", "node", "up", F.when(mine, F.col("m") * F.col("content")).otherwise(0.0).alias("w"), F.when(mine, F.col("m")).otherwise(0).cast("long").alias("s"))
    start = written(start, "below")
    sums = start
    while not sums.where("up is not null").isEmpty():
        held = sums.where("up is not null").groupBy(F.col("host").alias("h1"), F.col("up").alias("n1")).agg(F.sum("w").alias("w1"), F.sum("s").alias("s1"))
        far = sums.select(F.col("host").alias("h2"), F.col("node").alias("n2"), F.col("up").alias("u2"))
        more = sums.join(held, (F.col("host") == F.col("h1")) & (F.col("node") == F.col("n1")), "left").join(far, (F.col("host") == F.col("h2")) & (F.col("up") == F.col("n2")), "left")
        more = written(more.select("host", "node", F.col("u2").alias("up"), (F.col("w") + F.coalesce("w1", F.lit(0.0))).alias("w"), (F.col("s") + F.coalesce("s1", F.lit(0))).alias("s")), "below")
        if sums is not start:
            discard(sums)
        sums = more
    first = start.select(F.col("host").alias("h1"), F.col("node").alias("n1"), F.col("w").alias("w0"), F.col("s").alias("s0"))
    out = sums.join(first, (F.col("host") == F.col("h1")) & (F.col("node") == F.col("n1"))).where("s > s0")
    return out.select("host", "node", ((F.col("w") - F.col("w0")) / (F.col("s") - F.col("s0"))).alias("below"))


def style_trees(rows: DataFrame, lean: float = 20.0, upward: float = 0.2) -> DataFrame:
    """rows: host, node, kind, value, k, up -> (host, node, importance).

    `lean` is how many pages of its own a host needs for its own tree to count as much as the tree of all hosts;
    `upward` is the weight of the branch that a node hangs in, and of the layouts within a branch.
    """

    def entropies(rows: DataFrame, *by: str) -> DataFrame:
        """m pages; content importance, null without content; entropy of the layouts."""
        m = F.max(F.when(F.col("kind") == 0, F.col("k"))).alias("m")
        seen, logs = ([F.sum(F.when(F.col("kind") == i, x)) for i in (1, 2)] for x in (F.col("k"), F.col("k") * F.log("k")))
        out = rows.groupBy(*by).agg(m, seen[0].alias("s1"), logs[0].alias("l1"), seen[1].alias("s2"), logs[1].alias("l2"), F.max(F.when(F.col("kind") == 0, F.col("up"))).alias("up"))
        log_m = F.log(F.greatest(F.col("m"), F.lit(2)))
        content = F.when(F.col("m") > 1, F.greatest(1 - F.col("l1") / F.col("s1") / log_m, F.lit(0.0))).when(F.col("s1").isNotNull(), 1.0)
        layout = F.least(F.coalesce((F.log("s2") - F.col("l2") / F.col("s2")) / log_m, F.lit(0.0)), F.lit(1.0))
        return out.select(*by, F.coalesce("m", F.lit(1)).alias("m"), content.alias("content"), layout.alias("layout"), "up")

    own = written(entropies(rows, "host", "node"), "own")
    every = rows.groupBy("node", "kind", "value").agg(F.sum("k").alias("k"), F.max("up").alias("up"))
    every = entropies(every, "node").select(F.col("node").alias("n"), F.col("content").alias("all_content"), F.col("layout").alias("all_layout"))
    lent = lambda c: ((F.col("m") * F.col(c) + lean * F.col(f"all_{c}")) / (F.col("m") + lean)).alias(c)
    own = written(own.join(every, own["node"] == every["n"]).select("host", "node", "m", lent("content"), lent("layout"), "up"), "own")
    below = _below(own)
    branch = own.select("host", "node", "layout").join(below, ["host", "node"])
    branch = branch.select(F.col("host").alias("h"), F.col("node").alias("p"), (upward * F.col("layout") + (1 - upward) * F.col("below")).alias("branch"))
    leaf = own.where("content is not null").withColumn("parent", F.col("up"))
    out = leaf.join(branch, (leaf["host"] == F.col("h")) & (leaf["parent"] == F.col("p")), "left")
    return out.select("host", "node", ((1 - upward) * F.col("content") + upward * F.coalesce("branch", "content")).alias("importance"))


def kept(page: str, importance: dict[int, float], least: float) -> list[str]:
    """The blocks of the article.  A node without an importance counts as important."""
    found = blocks(page)
    has_article = any(kind in (ARTICLE, ARTICLE_HINTED) for kind, *_ in found)
    if not has_article and any(kind == INSIDE_NAMED for kind, *_ in found):
        return [text for kind, _, text in found if kind in (INSIDE_NAMED, HEADING)]
    out = []
    for kind, node, text in found:
        if kind == ARTICLE:
            out.append(text)
        elif kind in EVIDENCE:
            beside = BESIDE if has_article and kind in (OPEN, HINTED) else 0.0
            if importance.get(node, 1.0) + EVIDENCE[kind] + beside >= least:
                out.append(text)
    return out


def extract_text(pages: DataFrame, least: float = 0.35, lean: float = 20.0) -> DataFrame:
    """A row for each row of pages (page_id, url, html): page_id, url, text.

    Null and empty html give an empty text; a null url or one without a host belongs to the host "" (one site);
    repeated rows are extracted alike; an empty table gives no rows; other columns are left out.

    Two passes parse the pages: one counts nodes, contents and layouts by host, the other removes branches.  A page
    whose nodes are not all decided by evidence meets the importances of its own nodes, by host and the hash of its
    html; trees never travel with pages.
    """
    ready(pages.sparkSession)

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return pd.Series([host_of(u) for u in urls], dtype=object)

    @F.pandas_udf("string")
    def text(html_: pd.Series, nodes: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for h, p, i in zip(html_, nodes, values):
            told = dict(zip(p.tolist(), i.tolist())) if p is not None and i is not None else {}
            out.append("\n".join(kept(h, told, least)) if isinstance(h, str) else "")
        return pd.Series(out, dtype=object)

    pages = pages.select("page_id", "url", "html", F.xxhash64("html").alias("a"), F.xxhash64(F.lit("html"), "html").alias("b")).withColumn("host", host("url"))
    counted = written(_rows(pages), "counted")
    nodes = counted.where("kind < 3").groupBy("host", "node", "kind", "value").agg(F.sum("k").alias("k"), F.max("up").alias("up"))
    nodes = written(nodes, "nodes")
    trees = style_trees(nodes, lean).toDF("site", "n", "importance")
    asked = counted.where("kind = 3").select("host", "node", F.col("value").alias("a"), F.col("k").alias("b")).distinct()
    told = asked.join(trees, (F.col("host") == F.col("site")) & (F.col("node") == F.col("n"))).groupBy("host", "a", "b")
    # At most as many entries as the page has nodes.
    told = told.agg(F.collect_list(F.struct("node", "importance")).alias("tree")).toDF("site", "ta", "tb", "tree")
    told = written(told, "told")
    discard(counted, nodes)
    out = pages.join(told, (pages["host"] == told["site"]) & (pages["a"] == told["ta"]) & (pages["b"] == told["tb"]), "left")
    return out.select("page_id", "url", text("html", F.col("tree.node"), F.col("tree.importance")).alias("text"))
