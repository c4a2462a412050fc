"""HTML extraction with site style trees.

1. Every page is parsed to a DOM; elements with the same way from the root
   (tags, classes and ids, digits folded) are one node of the host's tree.
2. Over all pages of a host, a node has a distribution of presentations (the
   kinds of children it shows) and of contents (the texts below it). Node
   importance is the entropy of the presentations; content importance is one
   minus the mean entropy of its distinct texts over the pages, both with
   logarithms to the number of pages. Their mix, as in site style trees, is near 0 for what a
   host repeats on all its pages and near 1 for what changes.
3. A page keeps its article. Branches of low importance go, and so do the
   branches whose markup says what they are (menus, footers, adverts, forms,
   comments, ...): markup weighs the importance of a node, with 0 for those.
   Outside an article any word of a class, id or role says so; inside, a whole
   class or role does, ids do not, and headings and paragraphs have no such names.
   Inside an `article` or `main` element a branch goes only at a stricter bound
   (`INSIDE`) and if at least half of the host's pages show it; headings and
   elements without class, id and role stay, and so does an article that its host repeats whole. What is
   outside the article goes, unless it is the most of the page's text (`TEASER`).

Counts are grouped by (host, node, text), so a host of any size is counted by
many tasks; a host's low nodes come back to its pages by a join on host and a
salt, so a large host spreads too.

Defined cases: null or empty html gives an empty text; a null or malformed url
is a host of its own name ("" for null); repeated pages have one row each;
unclosed and stray tags are closed as browsers do for paragraphs, list items
and table parts; a formatting tag inside one of its own kind and names adds no
level, and elements more than `DEPTH` levels down are siblings there, as in
browsers, so broken markup costs time and memory in proportion to its length;
an empty table gives an empty table. Only the id, url and html
columns are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import table
from .textops import slices

LOW = 0.35          # importance below which a branch is noise
INSIDE = 0.1        # the same inside an article
TEASER = 4          # times an article's text that the important text outside must have to be kept too
MIN_PAGES = 4       # pages of a host that must show a node before its importance counts
DECAY = 0.9         # weight of contents against presentations, to the power of the number of presentations
SALT = 32
DEPTH = 128         # levels of a page's tree

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
RAW_OUTSIDE = frozenset("noscript math object".split())  # inside an article their text is part of it
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul""".split())
FORMATTING = frozenset("b big code em font i nobr s small strike strong tt u".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}

# What markup says about a branch.
CONTENT_TAGS = frozenset(("article", "main"))
NOISE_TAGS = frozenset("nav footer aside form button menu dialog head search".split())
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb
    breadcrumbs footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login
    comment comments commentlist disqus respond reply replies discussion share sharing social related recommended toolbar masthead topbar pagination pager
    search complementary contentinfo""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDING = frozenset("h1 h2 h3 h4 h5 h6 p".split())  # inside an article no name makes these noise

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _words(names: str) -> frozenset:
    return frozenset(_PART.findall(_CAMEL.sub(" ", names).lower()))


class Node:
    """A node of the merged tree: all elements with the same way from the root. Made once for each way by `child`.

    `around` is the element around it: its parent, but for elements below `DEPTH`.
    """
    __slots__ = ("tag", "names", "noise", "content", "depth", "value", "parent", "children")

    def __init__(self, tag: str, names: str, words: frozenset, main: bool, parent: "Node | None", tokens: tuple = (), around: "Node | None" = None):
        self.tag, self.names, self.parent, self.children = tag, names, parent, {}
        self.depth = 0 if parent is None else parent.depth + 1
        inside = around is not None and around.content
        if inside:  # there a name counts only as a whole: class="comments" or "social-share", but not "share-capital"
            named = tag not in WORDING and any(t <= NOISE_WORDS for t in tokens)
        else:
            named = not words.isdisjoint(NOISE_WORDS)
        self.noise = tag in NOISE_TAGS or (tag == "header" and not inside) or named
        if tag in ("html", "body", "article", "main") and words.isdisjoint(("comment", "comments", "reply")):
            self.noise = False  # a page or an article is not noise for a word in its class
        self.noise |= around is not None and around.noise
        self.content = inside or main or tag in CONTENT_TAGS
        self.value = _hash(f"{parent.value if parent is not None else 0}/{tag}.{names}")

    def child(self, tag: str, attrs: str, around: "Node | None" = None) -> "Node":
        around = around or self
        found = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attrs)] if "=" in attrs else []
        names = " ".join(_DIGITS.sub("0", v) for _, v in found)
        key = tag, names, around.noise, around.content
        node = self.children.get(key)
        if node is None:
            words = _words(" ".join(v for _, v in found))
            tokens = tuple(w for k, v in found if k != "id" for t in v.split() if (w := _words(t)))
            node = self.children[key] = Node(tag, names, words, ("role", "main") in found, self, tokens, around)
        return node


def parse(page: str, root: Node, kids: dict | None = None):
    """Yield the blocks of text in page order, each a list of runs (node, raw text).

    `kids` collects the children of each node on this page.
    """
    stack, runs, at, is_open = [root], [], 0, Counter()

    def end_from(i: int) -> None:
        is_open.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for m in _TOKEN.finditer(page):
        begin = m.start()
        if begin < at:  # inside a script or the like
            continue
        if begin > at:
            runs.append((stack[-1], page[at:begin]))
        at = m.end()
        close, tag, attrs = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if block:
            if runs:
                yield runs
                runs = []
        elif tag == "br":
            runs.append((stack[-1], " "))
            continue
        if close:
            if is_open[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        end_from(i)
                        break
            continue
        if tag in RAW and not (tag in RAW_OUTSIDE and stack[-1].content):
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if block:
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if stack[i].tag == "p":
                    end_from(i)
                    break
                if stack[i].tag in BLOCK:
                    break
            if tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSES[tag]:
                        end_from(i)
                        break
                    if stack[i].tag in SCOPE[tag]:
                        break
        above = stack[-1] if len(stack) <= DEPTH else stack[DEPTH - 1]
        node = above.child(tag, attrs, stack[-1])
        if tag in FORMATTING and is_open[tag] and _formatted(stack, node):
            continue
        if kids is not None:
            kids.setdefault(above, set()).add(node.value)
        stack.append(node)
        is_open[tag] += 1
    if at < len(page):
        runs.append((stack[-1], page[at:]))
    if runs:
        yield runs


def _formatted(stack: list[Node], node: Node) -> bool:
    """Is the formatting element already open, with the same names, in the block at hand?"""
    for n in reversed(stack):
        if n.tag == node.tag and n.names == node.names:
            return True
        if n.tag not in FORMATTING:
            return False
    return False


def _text(runs: list) -> str:
    """One block's text: references decoded, white space turned into single spaces."""
    return " ".join(entities.unescape("".join([t for _, t in runs])).split())


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def observed(page: str, root: Node) -> list[tuple[int, bool, np.ndarray]]:
    """(node, is content, values): the distinct texts below each node, and each node's presentation, of one page.

    Texts are kept at their own node and added up from the deepest nodes to the root.
    """
    out, kids, below = [], {}, {}
    for runs in parse(page, root, kids):
        for node, text in runs:
            if text := text.strip():
                below.setdefault(node, []).append(_hash(text) >> 32)
    below = {n: [np.array(v, np.int32)] for n, v in below.items()}
    for node in sorted(kids.keys() | below.keys(), key=lambda n: -n.depth):
        if node in below:
            values = below[node][0] if len(below[node]) == 1 and len(below[node][0]) == 1 else np.unique(np.concatenate(below[node]))
            out.append((node.value, True, values))
            if node.parent is not None:
                below.setdefault(node.parent, []).append(values)
        out.append((node.value, False, np.array([_hash(repr(sorted(kids.get(node, ())))) >> 32], np.int32)))
    return out


def new_root() -> Node:
    return Node("#", "", frozenset(), False, None)


def main_text(page: str, root: Node, low: frozenset[int] | set[int] = frozenset(), inside: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, joined by line ends; `low`: the nodes of low importance on this host; `inside`: those so low that they go from an article."""
    blocks = [[(n, t) for n, t in runs if not n.noise] for runs in parse(page, root)]
    known: dict[Node, bool] = {}

    def joined(keep) -> str:
        texts = (_text([(n, t) for n, t in runs if keep(n)]) for runs in blocks if runs)
        return "\n".join(t for t in texts if t)

    def important(n) -> bool:
        way = []
        while n is not None and n not in known:
            way.append(n)
            n = n.parent
        ok = n is None or known[n]
        for n in reversed(way):
            if not n.content:
                ok = ok and (n.value not in low or n.tag in ("#", "html", "body"))
            elif n.parent is None or not n.parent.content:  # the article itself: never low, so that one repeated whole stays
                ok = True
            else:
                ok = ok and (n.value not in inside or not n.names or n.tag in HEADINGS or _whole(n))
            known[n] = ok
        return ok

    def _whole(n) -> bool:
        """Does the host repeat the whole article around the node?"""
        while n.parent.content:
            n = n.parent
        return n.value in inside

    if text := joined(lambda n: n.content and important(n)) or joined(lambda n: n.content):
        if len(outside := joined(lambda n: not n.content and important(n))) > TEASER * len(text):
            return joined(important)
        return text
    return joined(important) or joined(lambda n: True)  # a page that its host repeats whole stays


def importances(rows: DataFrame) -> DataFrame:
    """(host, node, pages, importance) over all pages of each host; `rows` has _host, _html."""
    def run(batches):
        root = new_root()
        for b in slices(batches, "_html"):
            host, node, content, values = [], [], [], [np.empty(0, np.int32)]
            for h, page in zip(b.column("_host").to_pylist(), b.column("_html").to_pylist()):
                for n, c, v in observed(page or "", root):
                    host.append(h)
                    node.append(n)
                    content.append(c)
                    values.append(v)
            size = np.array([len(v) for v in values[1:]], np.int64)
            row = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()).take(row), pa.array(node, pa.int64()).take(row),
                                              pa.array(content, pa.bool_()).take(row), pa.array(np.concatenate(values))],
                                             names=["host", "node", "content", "value"])

    seen = rows.mapInArrow(run, "host string, node long, content boolean, value int").groupBy("host", "node", "content", "value").agg(F.count("*").alias("n"))
    n = F.col("n")
    g = seen.groupBy("host", "node").agg(
        F.sum(F.when(~F.col("content"), n)).alias("pages"), F.sum(F.when(~F.col("content"), 1)).alias("shapes"),
        F.sum(F.when(~F.col("content"), n * F.log(n))).alias("shape_log"),
        F.sum(F.when(F.col("content"), 1)).alias("texts"), F.sum(F.when(F.col("content"), F.log(n))).alias("text_log"))
    m = F.log(F.col("pages"))
    shape = (m - F.col("shape_log") / F.col("pages")) / m
    text = 1 - F.col("text_log") / F.col("texts") / m
    weight = F.pow(F.lit(DECAY), F.col("shapes"))
    return g.select("host", "node", "pages", F.when(F.col("pages") < 2, 1.0).otherwise((1 - weight) * shape + weight * text).alias("importance"))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), _host(F.col(url_col)).alias("_host"))
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "page_text", uuid.uuid4().hex)
    below = lambda bound: (F.col("pages") >= MIN_PAGES) & (F.col("importance") < bound)
    (importances(rows.select("_host", "_html")).groupBy("host")
     .agg(F.max("pages").alias("most"), F.collect_list(F.when(below(LOW), F.col("node"))).alias("low"),  # a host's repeated branches: bounded by its templates
          F.collect_list(F.when(below(INSIDE), F.struct("node", "pages"))).alias("inside"))
     .where(F.size("low") > 0)
     .select("host", "low", F.transform(F.filter("inside", lambda x: 2 * x["pages"] >= F.col("most")), lambda x: x["node"]).alias("inside"))
     .write.parquet(path))
    # From a written table Spark knows the size: it broadcasts a small one, so pages are not shuffled,
    # and joins a large one by host and salt.
    low = spark.read.schema("host string, low array<long>, inside array<long>").parquet(path).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_url", "_id"), F.lit(SALT)).cast("int"))
    joined = salted.join(low, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("salt")), "left").select("_id", "_url", "_html", "low", "inside")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        root = new_root()
        for b in slices(batches, "_html"):
            texts = [main_text(page or "", root, set(low or ()), set(inside or ()))
                     for page, low, inside in zip(*(b.column(c).to_pylist() for c in ("_html", "low", "inside")))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["_id", "_url", "text", "n_chars"])

    out = joined.mapInArrow(run, f"_id {kind}, _url {rows.schema['_url'].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})


def op5_page_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
