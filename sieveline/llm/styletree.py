"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: the children of an element form a style (their tags and classes in
order, runs of one kind taken together), and pages whose element has the same style share the nodes below it. The
importance of an element is the entropy of its styles over the pages that have it, that of a text node the entropy of
its texts, both in units of log(occurrences): 0 where all pages agree, 1 where all differ. A branch goes from a page
when every node in it is noise: an element of low importance on its host, or a text at a place of low importance
that itself recurs across the host's pages. The text and inline elements of a block stay together."""

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, bounded, cut, held_bytes

#: Production parameters: importance below which a node is low, and the occurrences that a judgement takes, for a text
#: the different pages that hold it; nodes seen less often are important.
THRESHOLD, MIN_SEEN = 0.8, 3
#: Low nodes of all hosts that every task may hold (BROADCAST_BYTES of them at most); pages of a host that go to one task
#: beyond that.
BROADCAST_ROWS, GROUP_PAGES = 500_000, 1000

TAG = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|noscript|template|svg)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: A start tag ends an open element of these kinds, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("label", "tag", "children", "text", "key", "value")

    def __init__(self, label: str, tag: str, text: str | None = None):
        self.label, self.tag, self.children, self.text, self.key = label, tag, [], text, 0
        self.value = 0


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed and stray tags, void elements and implied ends are dealt with; comments, scripts and
    styles are dropped."""
    root = Node("#root", "#root")
    stack, at = [root], 0

    def add(raw: str) -> None:
        text = SPACE.sub(" ", htmllib.unescape(raw) if "&" in raw else raw).strip()
        if text:
            stack[-1].children.append(Node("#text", "#text", text))

    for m in TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        tag = name.lower()
        if m.group(2):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    if tag != "tr":
                        break
        elif tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        found = CLASS.search(m.group(4)) if m.group(4) else None
        node = Node(tag + ("." + next(x for x in found.groups() if x is not None) if found else ""), tag)
        stack[-1].children.append(node)
        if tag not in VOID and not m.group(4).endswith("/"):
            stack.append(node)
    add(page[at:])
    return root


def h64(*parts: object) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def observations(root: Node) -> list[tuple[int, int]]:
    """(key, value) of every node: the place of the node in the site style tree, and its style (even) or
    text (odd). Sets the keys of the nodes and the values of texts."""
    root.key = 1
    out, todo, made = [], [root], {}
    while todo:
        node = todo.pop()
        style, places, last = [], [], None
        for c in node.children:
            if c.label != last:
                style.append(c.label)
                last = c.label
            places.append(len(style) - 1)
        sig = "|".join(style)
        out.append((node.key, h64(sig) & ~1))
        for c, place in zip(node.children, places):
            known = (node.key, sig, place)
            if known not in made:
                made[known] = h64(*known)
            c.key = made[known]
            if c.text is None:
                todo.append(c)
            else:
                c.value = h64("#", c.text) | 1
                out.append((c.key, c.value))
    return out


def extract(root: Node, low: set[int] | frozenset[int]) -> tuple[str, int, int]:
    """(text of what stays, nodes, nodes removed). Keys must be set."""
    nodes = 0
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    noise: dict[int, bool] = {}
    for n in reversed(order):
        nodes += 1
        noise[id(n)] = (n.key ^ n.value in low or (n.text is None and not n.children)) and all(noise[id(c)] for c in n.children)
    # A block's run of text and inline elements stays or goes as a whole: no words or stops are lost within it.
    flows: dict[int, list[Node]] = {}
    held: list[tuple[Node, Node]] = [(root, root)]
    while held:
        n, block = held.pop()
        inside = n if n.text is None and (n.tag in BLOCK or n is root) else block
        if inside is block and n is not root:
            flows.setdefault(id(block), []).append(n)
        held += [(c, inside) for c in n.children]
    for flow in flows.values():
        if any(n.text is not None and not noise[id(n)] for n in flow):
            for n in flow:
                noise[id(n)] = False
    removed = sum(noise.values())
    out: list[str] = []
    walk: list[Node | str] = [root]
    while walk:
        n = walk.pop()
        if isinstance(n, str):
            out.append(n)
        elif noise[id(n)] and n is not root:
            continue
        elif n.text is not None:
            out.append(n.text + " ")
        else:
            edge = "\n" if n.tag in BLOCK or n.tag == "br" else ""
            if edge:
                out.append(edge)
                walk.append(edge)
            walk += reversed(n.children)
    lines = (x.strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), nodes, removed


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType()), T.StructField("n", T.LongType())])))
def observe(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [{"key": k, "value": v, "n": n} for (k, v), n in Counter(observations(parse(p))).items()] if p else [])


def host_of(url):
    """Lower-case host of a URL without user and port; null or none: ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def node_counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, key, value, n, pages): occurrences, and different pages of the host that have them. Equal pages count
    once: each of c copies counts 1 / c, so that partial sums do. Counts have partial sums, so a hot host is not a hot
    task."""
    base = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    copies = cut(base.where("html is not null").groupBy("host", "page").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    base = base.join(bounded(copies), ["host", "page"], "left")
    seen = base.select("host", (1 / F.coalesce("c", F.lit(1))).alias("share"), F.explode(observe("html")).alias("o"))
    return seen.groupBy("host", F.col("o.key").alias("key"), F.col("o.value").alias("value")).agg(F.sum("o.n").alias("n"), F.round(F.sum("share"), 3).alias("pages"))


def _by_place(counts: DataFrame, *more) -> DataFrame:
    m, nlogn = F.sum("n"), F.sum(F.col("n") * F.log(F.col("n")))
    sums = counts.groupBy("host", "key").agg(m.alias("seen"), nlogn.alias("s"), *more)
    return sums.withColumn("importance", F.when(F.col("seen") > 1, (F.log("seen") - F.col("s") / F.col("seen")) / F.log("seen")).otherwise(F.lit(1.0))).drop("s")


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, key, seen, importance) of every node of the style trees."""
    return _by_place(node_counts(pages, url_col, html_col))


def noise_keys(pages: DataFrame, url_col: str, html_col: str, threshold: float, min_seen: int) -> DataFrame:
    """(host, key): keys of low elements; key xor value of texts at low places that recur on min_seen pages."""
    element = F.pmod("value", F.lit(2)) == 0
    keys = F.collect_set(F.when(element, F.col("key")).when(F.col("pages") >= min_seen, F.col("key").bitwiseXOR(F.col("value"))))
    places = _by_place(node_counts(pages, url_col, html_col), keys.alias("keys"))
    return places.where((F.col("seen") >= min_seen) & (F.col("importance") < threshold)).select("host", F.explode("keys").alias("key"))


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("nodes", T.IntegerType()), T.StructField("removed", T.IntegerType())])


def _page(page: str | None, low) -> tuple[str | None, int, int]:
    if page is None:
        return None, 0, 0
    root = parse(page)
    observations(root)
    return extract(root, low)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD,
                  min_seen: int = MIN_SEEN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, nodes, removed) of every row.

    Pages without a host form one site. A null page gives null text, an empty one ''; a site of fewer than min_seen
    pages keeps all but empty elements. Equal pages count once, and so does a text that a page repeats. Broken markup
    never fails. An empty table gives no rows; extra columns are ignored.

    The low keys of all hosts are broadcast while there are at most broadcast_rows of them, of BROADCAST_BYTES. Beyond
    that pages meet the keys of their host, which each group of some GROUP_PAGES pages of a host gets once, in a sort."""
    low = cut(noise_keys(pages, url_col, html_col, threshold, min_seen))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if low.count() <= broadcast_rows and held_bytes(low) <= BROADCAST_BYTES:
        got = low.toPandas()
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(k.tolist()) for h, k in got.groupby("host")["key"].apply(np.array).items()} if len(got) else {})

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            lows = shared.value
            for htmls, hosts in batches:
                yield pd.DataFrame([_page(p, lows.get(h, ())) for p, h in zip(htmls, hosts)], columns=["text", "nodes", "removed"])

        return base.withColumn("r", F.pandas_udf(run, RESULT)("html", host_of(F.col("url")))).select("page_id", "url", "r.*")
    return _grouped(base, low)


def _grouped(base: DataFrame, low: DataFrame) -> DataFrame:
    """The pages with the low keys of their host before them: rows of both, by group, sorted. A group is a share of a
    host's pages, so that neither a hot host nor its keys meet in one task alone."""
    hosted = base.withColumn("h", host_of(F.col("url")))
    large = cut(hosted.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_PAGES).select(F.col("h").alias("host"), F.ceil(F.col("n") / GROUP_PAGES).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    pages = hosted.join(bounded(large), F.col("h") == F.col("host"), "left").select("h", F.pmod(F.xxhash64("page_id", "url", "html"), salts).cast("int").alias("s"), F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("low"), "page_id", "url", "html")
    lists = low.groupBy("host").agg(F.collect_list("key").alias("low")).join(bounded(large), "host", "left")
    nulls = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in ("page_id", "url", "html")]
    lists = lists.select(F.col("host").alias("h"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"), F.lit(0).alias("kind"), "low", *nulls)
    both = lists.unionByName(pages).repartition("h", "s").sortWithinPartitions("h", "s", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys = None, frozenset()
        for batch in batches:
            rows, done = [], []
            html = batch.column("html")
            for k, (h, s, kind, some) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("h", "s", "kind")], batch.column("low"))):
                if kind == 0:
                    group, keys = (h, s), frozenset(some.as_py())
                    continue
                if (h, s) != group:
                    group, keys = (h, s), frozenset()
                rows.append(k)
                done.append(_page(html[k].as_py(), keys))
            at = pa.array(rows, pa.int64())
            results = [pa.array([d[j] for d in done], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(at), batch.column("url").take(at), *results], names=["page_id", "url", "text", "nodes", "removed"])

    schema = T.StructType([T.StructField(c, base.schema[c].dataType) for c in ("page_id", "url")] + RESULT.fields)
    return both.mapInArrow(run, schema)
