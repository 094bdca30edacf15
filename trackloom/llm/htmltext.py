"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by path. Every merged node has a presentation importance (entropy of the
child sequences that its pages show) and a content importance (entropy of its texts); every text block is a leaf of its
own, keyed by path and text. What few pages show at all is told by that, so the information of being there counts too.
Both are in units of the entropy of the host's whole pages and smoothed by ``PRIOR``, so a host of copies does not look
like one of templates and two pages are enough to compare. A node's importance is the larger of the two, times the weight
that HTML gives it; blocks on or below a node under the threshold are layout and are removed from each page. A page that
would lose more than all but one n-th of its text on a host of n pages is a copy of others, not their template: it stays.

What HTML itself declares is not left to statistics: menus, footers and the like are removed by element and role. Words of
classes and ids, and forms, only lower a node's importance, the more the less of the page's text it holds, and not at all
where it holds the main element or most of the text; and a page's article (or main element), where it has one, is the region the text is taken from,
in which only containers, never paragraphs or headings, can be layout.

The merged tree is an aggregate over (host, path, value), summed in every task before the exchange, so a host with a
third of all pages is no single group anywhere; decisions go back to pages by (page, path) rows.

Null and empty pages have an empty text. Pages without a readable host form one site. Pages that share an id share
decisions on paths of their hosts. Only page_id, url and html are read. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import HEADINGS, Page
from .registry import query

THRESHOLD, PRIOR = 0.3, 0.25
STYLE, CONTENT = 0, 1
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)
# Paragraphs and the like are told by path and text; the nodes around the whole text are the page.
PROSE = {"p", "pre", "blockquote", "dd", "dt", "td", "th", "caption", "figcaption", "summary", "html", "body", "main", "article"} | HEADINGS


def host(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def read(source: str | None, url: str | None) -> Page:
    return Page(source or "", host(url))


def candidates(page: Page, threshold: float = THRESHOLD) -> list[tuple[int, str, float]]:
    """(node, text, weight) of the blocks that HTML itself leaves to be text: those of the article, if there is one."""
    nodes, weights = page.nodes, page.weights()
    inside = [(node, text, weights[node]) for node, text in page.blocks if weights[node] >= threshold]
    blocks = [b for b in inside if nodes[b[0]].main and weights[b[0]] == 1] or inside
    out = []
    for node, text, weight in blocks:
        names = [nodes[i].name for i in page.lineage(node)]
        if "header" not in names or any(n in HEADINGS for n in names):
            out.append((node, text, weight))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _hash(text: str, seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed))


def _leaf(page: Page, node: int, text: str) -> int:
    return _hash(text, page.nodes[node].path)


def _observed(page: Page) -> list[tuple[int, int, int]]:
    """(path, kind, value) of the page: child sequences and texts of nodes, its blocks by path and text, and the page as a whole (the first path)."""
    blocks = candidates(page)
    rows = {(_signed(page.nodes[0].path), CONTENT, _hash("\n".join(t for _, t, _ in blocks)))}
    texts: dict[int, list[str]] = {}
    for node, text, _ in blocks:
        rows.add((_leaf(page, node, text), CONTENT, 0))
        for i in page.lineage(node):
            texts.setdefault(i, []).append(text)
    for i, ts in texts.items():
        n = page.nodes[i]
        if n.name not in PROSE:
            rows.add((_signed(n.path), CONTENT, _hash("\n".join(ts))))
            rows.add((_signed(n.path), STYLE, _hash("\n".join(n.children), 1)))
    return list(rows)


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, source in zip(*(c.to_pylist() for c in batch.columns)):
            page = read(source, url)
            root = _signed(page.nodes[0].path)
            rows += [(page_id, root, *r) for r in _observed(page)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (batch.column(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["page_id", "site", "path", "kind", "value"])


def style_tree(seen: DataFrame) -> DataFrame:
    """(site, path, pages of the site, importance) of the merged nodes from observations."""
    counts = seen.groupBy("site", "path", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    n, spread = F.sum("c"), F.sum(F.col("c") * F.log("c"))
    entropy = counts.groupBy("site", "path", "kind").agg(n.alias("n"), (F.log(n) - spread / n).alias("h"))
    nodes = entropy.groupBy("site", "path").agg(F.max("n").alias("n"), F.max("h").alias("h"))
    whole = nodes.filter("path = site").select("site", F.col("n").alias("pages"), F.col("h").alias("_of"))
    there = F.greatest(F.log(F.col("pages") / F.col("n")), F.lit(0.0))
    return nodes.filter("path <> site").join(whole, "site").select(
        "site", "path", "pages", ((F.col("h") + there + PRIOR) / (F.col("_of") + PRIOR)).alias("importance"))


def layout(pages: DataFrame) -> DataFrame:
    """page_id with the paths of its branches and blocks of less than full importance, that, and the number of pages of the site."""
    kind = pages.schema["page_id"].dataType.simpleString()
    seen = pages.select("page_id", "url", "html").mapInArrow(_observations, f"page_id {kind}, site long, path long, kind int, value long")
    low = style_tree(seen).filter(F.col("importance") < 1 - 1e-9)
    rows = seen.filter(F.col("path") != F.col("site")).select("page_id", "site", "path").join(low, ["site", "path"])
    return rows.groupBy("page_id").agg(F.collect_set(F.struct("path", "importance", "pages")).alias("layout"))


def judged(page: Page, low: dict[int, float] = {}, pages: int = 1, threshold: float = THRESHOLD) -> list[tuple[str, bool]]:
    """The blocks that HTML leaves to the tree, and whether they stay; ``low``: importance by path, full where there is none."""
    blocks = candidates(page, threshold)
    stays = []
    for node, text, weight in blocks:
        paths = [_leaf(page, node, text), *(_signed(page.nodes[i].path) for i in page.lineage(node))] if low else []
        stays.append(weight * min([1.0, *(low[p] for p in paths if p in low)]) >= threshold)
    lost = sum(len(t) for (_, t, _), s in zip(blocks, stays) if not s)
    copy = lost * pages > sum(len(t) for _, t, _ in blocks) * (pages - 1)
    return [(t, s or copy) for (_, t, _), s in zip(blocks, stays)]


def main_text(page: Page, low: dict[int, float] = {}, pages: int = 1, threshold: float = THRESHOLD) -> str:
    return " ".join(t for t, s in judged(page, low, pages, threshold) if s)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url and the main text of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(read(h, u), {x["path"]: x["importance"] for x in p or ()}, max((x["pages"] for x in p or ()), default=1), threshold)
                     for u, h, p in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html").join(layout(pages), "page_id", "left")
    return rows.select("page_id", "url", "html", "layout").mapInArrow(run, f"page_id {kind}, url string, text string")


@query("op2_html_text")
def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
