"""HTML extraction by differencing a page against the page of nearest URL on its host.

Templates repeat between neighbouring pages, content doesn't.  Pages are paired by URL path within each host: of all other paths of the
host, the nearest is one that shares the longest prefix, and it is always next to the own path in sorted order.  A page's text lines are
aligned with its partner's by longest common subsequence, and the shared lines are deleted.

Paths are sorted by range over all hosts, so a large host is many partitions; the neighbours across the borders of partitions are found
from the border rows.  A pair needs the partner's *line hashes* only, so no page text moves but the page's own, once.

Scheme, query, fragment, a trailing slash and ``.html`` don't count for the path.  Pages of one path are versions of the same page: they share a
partner and are not compared to each other; the version of least id stands for the path.

Defined results: a null or relative URL, and the only path of a host, have no partner and keep all lines; a null html has no lines; a null id
sorts after all ids and stays null; of partners that share equally long prefixes the one sorted before is taken; repeated rows get equal
results; lines are compared by their text after white space is collapsed, and a page equal to its partner loses all lines.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common as C

#: Elements that begin and end a line.
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"])
#: Elements whose content isn't text of the page.
SKIPPED = frozenset(["script", "style", "noscript", "template", "head", "svg", "iframe", "textarea"])
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)[^>]*+>")
_SPACE = re.compile(r"\s+")


def lines_of(page: str) -> list[str]:
    """Text lines of a page, in order, in one pass."""
    out, line, at, lowered = [], [], 0, None
    n = len(page)

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            line.append(page[at:])
            break
        if lt > at:
            line.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = (_TAG.match(page, lt) or _LOOSE.match(page, lt)) if follows == "/" or follows.isalpha() else None
        if tag is None:
            line.append("<")
            at = lt + 1
            continue
        name, at = tag.group(1).lower(), tag.end()
        if name in SKIPPED and follows != "/":
            if page[at - 2] == "/":
                continue
            if lowered is None:
                lowered = page.lower()
                if len(lowered) != n:  # a few characters change length
                    lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = lowered.find(f"</{name}", at)
            if end < 0 and name == "head":
                continue
            at = n if end < 0 else max(page.find(">", end) + 1, end + 2)
            line.append(" ")
        elif name in BLOCKS:
            close()
    close()
    return out


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared(a: list, b: list, store_bits: int = 1 << 28) -> list[int]:
    """Indices of ``a`` in one longest common subsequence with ``b``, ascending."""
    common = set(a) & set(b)
    ia = [i for i, x in enumerate(a) if x in common]
    xa, xb = [a[i] for i in ia], [x for x in b if x in common]
    lead = 0
    while lead < min(len(xa), len(xb)) and xa[lead] == xb[lead]:
        lead += 1
    tail = 0
    while tail < min(len(xa), len(xb)) - lead and xa[-1 - tail] == xb[-1 - tail]:
        tail += 1
    middle = _lcs(xa[lead : len(xa) - tail], xb[lead : len(xb) - tail], store_bits)
    return [ia[i] for i in [*range(lead), *(lead + i for i in middle), *range(len(xa) - tail, len(xa))]]


def _masks(b: list) -> dict:
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    return masks


def _lcs(a: list, b: list, store_bits: int) -> list[int]:
    """Bit-parallel rows with traceback: bit j of the row after i lines is 0 where line j of ``b`` makes the subsequence longer.

    Rows that need more than ``store_bits`` in all are kept at every so many lines only and made again from there, which changes nothing in the result.
    """
    if not a or not b:
        return []
    full = (1 << len(b)) - 1
    masks = _masks(b)

    def following(v: int, x) -> int:
        u = v & masks.get(x, 0)
        return ((v + u) | (v - u)) & full

    step = len(a) if len(a) * len(b) <= store_bits else isqrt(len(a)) + 1
    v, marks = full, []
    for i, x in enumerate(a):
        if i % step == 0:
            marks.append(v)
        v = following(v, x)
    j, out = len(b), []
    for block in range(len(marks) - 1, -1, -1):
        if not j:
            break
        start = block * step
        rows = [marks[block]]
        for x in a[start : start + step]:
            rows.append(following(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    out.append(start + i)
                    j -= 1
    return out[::-1]


def prefix(a: str, b: str) -> int:
    """Characters at the start that two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


_HASHES = pa.list_(pa.int64())


def _lines(batches):
    for batch in batches:
        hashes = [[line_hash(x) for x in lines_of(t)] if t else [] for t in (s.as_py() for s in batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hashes, _HASHES)], names=["host", "path", "k", "hashes"])


NEIGHBOUR = "host string, path string, side int, npath string, nk {k}, nhashes array<bigint>"


def _neighbours(edge: bool):
    """Of rows sorted by host and path: for each its neighbours (side -1 before, 1 after); with ``edge`` also the first and last row of the partition (side 0)."""

    def run(batches):
        schema, last, edges = None, None, []
        for batch in batches:
            schema = batch.schema
            out = []
            for row in batch.to_pylist():
                if last is not None and last["host"] == row["host"]:
                    if last["path"] < row["path"]:
                        out.append((row["host"], row["path"], -1, last["path"], last["k"], last["hashes"]))
                        out.append((row["host"], last["path"], 1, row["path"], row["k"], row["hashes"]))
                if last is None:
                    edges.append(row)
                last = row
            yield table(out, schema)
        if edge and last is not None:
            edges = edges if edges[0] is last else [*edges, last]
            yield table([(r["host"], r["path"], 0, None, r["k"], r["hashes"]) for r in edges], schema)

    def table(rows, schema):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), schema.field("k").type, _HASHES]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["host", "path", "side", "npath", "nk", "nhashes"])

    return run


def _difference(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            lines = lines_of(row["html"]) if row["html"] else []
            before, after = row["before"], row["after"]
            if before is not None and after is not None and prefix(row["path"], after["npath"]) > prefix(row["path"], before["npath"]):
                before = None
            partner = before or after
            gone = set(shared([line_hash(x) for x in lines], partner["nhashes"] or [])) if partner else set()
            out.append((row["k"], row["url"], partner and partner["nk"], len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [batch.schema.field("k").type, pa.string(), batch.schema.field("k").type, pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["k", "url", "partner", "n_lines", "n_shared", "text"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, partner, n_lines, n_shared, text) of every page: its lines that aren't shared with its nearest page."""
    C.settle(pages.sparkSession)
    rows = C.pick(pages, k=id_column, url=url_column, html=html_column)
    kind = rows.schema["k"].dataType.simpleString()
    scheme = "^\\s*[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract("url", scheme + "([^/?#\\s]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", scheme + "[^/?#\\s]*([^?#\\s]*)", 1), "(/|/index\\.html?|\\.html?)+$", "")
    rows = rows.withColumn("host", F.when(host != "", host)).withColumn("path", F.when(host != "", path))
    hashed = rows.where("host is not null").select("host", "path", "k", "html").mapInArrow(C.lean(_lines), f"host string, path string, k {kind}, hashes array<bigint>")
    paths = hashed.groupBy("host", "path").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "hashes")).alias("m")).select("host", "path", "m.k", "m.hashes")
    schema = NEIGHBOUR.format(k=kind)
    near = C.cut(paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path").mapInArrow(C.lean(_neighbours(True)), schema), "url-neighbours")
    borders = near.where("side = 0").select("host", "path", F.col("nk").alias("k"), F.col("nhashes").alias("hashes"))
    # two rows a partition
    across = borders.coalesce(1).sortWithinPartitions("host", "path").mapInArrow(C.lean(_neighbours(False)), schema)
    of = F.struct("npath", "nk", "nhashes")
    best = near.where("side <> 0").union(across).groupBy("host", "path").agg(F.max(F.when(F.col("side") == -1, of)).alias("before"), F.min(F.when(F.col("side") == 1, of)).alias("after"))
    paired = rows.join(best, ["host", "path"], "left").select("k", "url", "html", "path", "before", "after")
    return paired.mapInArrow(C.lean(_difference), f"k {kind}, url string, partner {kind}, n_lines bigint, n_shared bigint, text string").select(F.col("k").alias(id_column), F.col("url").alias(url_column), "partner", "n_lines", "n_shared", "text")
