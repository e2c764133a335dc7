"""Operator 8: main text of web pages by differencing each page with its nearest-URL neighbours.

A page is cut into blocks of text, each with its box: the chain of elements around it. Within each host
pages are ranked by URL path, one of each distinct sequence of blocks, and each is aligned with the ones
before and after it (in groups of `group` pages) by the longest common subsequence of its blocks; copies take
over its answer. A pair counts by its blocks that are not shared, in boxes that mostly differ between the two,
so that near copies (an edited paragraph, a new date) tell little or nothing; a host that has nothing but
copies with a changed box of its own looks like a template. Blocks that a neighbour shares are deleted,
but for boxes in which blocks are mostly not shared in the whole host: there a shared block is a sentence
or licence that two articles happen to have, and it stays. Likewise, in boxes that are mostly shared the
few blocks that differ (a rotating advert, a date) are deleted too. A box that no pair of its host tells
of is judged by all hosts together. Markup breaks what differencing cannot know: boxes named as menu,
advert, comment, form and the like are always deleted, and blocks within an article or main element are
deleted only if they are shared and their box is mostly shared over `SURE` blocks of the host or more.

Only hashes of blocks travel for the pairing; ranks in a host come from a range sort and prefix counts, so
a host with a third of all pages is spread. The html is read twice and joined once with its verdicts.

Tokenising is linear in the page's length. Null or empty html gives an empty text. Repeated rows keep their text. An empty table gives an empty
result. Pages are matched by page_id, url and a hash of the html.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stored, table, with_broadcast_if_small
from ._tokens import slices

#: Pages of one alignment group (the last of a host has less than twice as many).
GROUP = 8
#: Share of shared blocks above which a box is boilerplate, and blocks of a host that make this sure.
MOSTLY, SURE = 0.5, 40

# What is not closed runs to the end of the page, as in browsers, so that no part is scanned again and again.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title|head|math|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=(?:\s*\"[^\"]*(?:\"|\Z)|\s*'[^']*(?:'|\Z))?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

# Elements that do not break a line, that hold nothing, and that end an open one of their kind.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

# Elements and names that mark what is no article.
_CHROME_TAGS = set("nav aside footer form button dialog menu fieldset input".split())
_CHROME_NAMES = set(
    "nav navbar navigation menu sidebar aside footer ad ads advert advertisement adverts advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert "
    "comment comments disqus respond reply replies share sharing social related recommended breadcrumb breadcrumbs pagination pager login signup signin newsletter subscribe "
    "subscription search toolbar widget popup modal overlay form copyright complementary contentinfo".split()
)
_TOP_NAMES = {"header", "masthead", "topbar"}


def _kind(tag: str, attrs: str, inside: str) -> str:
    """chrome, content or the kind of the element around."""
    if inside == "chrome":
        return inside
    names = {n for m in _NAMES.findall(attrs) for n in re.split(r"[^a-z0-9]+", m.strip("\"'").lower())}
    if tag in _CHROME_TAGS or names & _CHROME_NAMES or _HIDDEN.search(attrs):
        return "chrome"
    if inside != "content" and (tag == "header" or names & _TOP_NAMES):
        return "chrome"
    return "content" if tag in ("article", "main") else inside


def _entered(tag: str, attrs: str, box: int, kind: str) -> tuple[str, int, str]:
    """Tag, box and kind within an element that opens in the given box and kind."""
    names = sorted({re.sub(r"\d+", "#", n.strip("\"'").lower()) for n in _NAMES.findall(attrs)})
    return tag, _hash(f"{box}>{tag}.{'.'.join(names)}"), _kind(tag, attrs, kind)


#: Pages of a site repeat their elements; only attributes of up to `_SHORT` characters are remembered.
_remembered, _SHORT = lru_cache(maxsize=1 << 14)(_entered), 200


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(text, box, kind) of every block with text, in page order; a box is a hash of the chain of elements."""
    found: list[tuple[str, int, str]] = []
    stack: list[tuple[str, int, str]] = [("", 0, "plain")]  # tag, box, kind
    open_: Counter[str] = Counter()
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            found.append((text, stack[-1][1], stack[-1][2]))

    at = 0
    for m in _TOKEN.finditer(page):
        start, end = m.span()
        if start > at:
            run.append(entities.unescape(page[at:start]))
        at = end
        closes, tag, attrs = m.group(2, 3, 4)
        if not tag:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            # Inline elements are not on the stack unless their names mark them.
            continue
        if tag == "br":
            run.append(" ")
            continue
        if run:
            flush()
        if closes:
            while open_[tag] and len(stack) > 1:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == tag:
                    break
        elif tag not in _VOID and not attrs.endswith("/"):
            while len(stack) > 1 and stack[-1][0] in _CLOSES.get(tag, ()):
                open_[stack.pop()[0]] -= 1
            stack.append((_remembered if len(attrs) <= _SHORT else _entered)(tag, attrs, *stack[-1][1:]))
            open_[tag] += 1
    run.append(entities.unescape(page[at:]))
    flush()
    return found


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places; Hirschberg's halving over bit-parallel rows, so memory stays linear."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            pairs.append((j, n))
        if i == j or k == n:
            continue
        if j - i == 1:
            where = next((x for x in range(k, n) if b[x] == a[i]), None)
            if where is not None:
                pairs.append((i, where))
            continue
        half = (i + j) // 2
        ahead = _row(a[i:half], b[k:n])
        back = _row(a[half:j][::-1], b[k:n][::-1])[::-1]
        cut = int(np.argmax(ahead + back))
        todo += [(i, half, k, k + cut), (half, j, k + cut, n)]
    return sorted(pairs)


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, from one bit row over b."""
    places: dict[int, int] = {}
    for x, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << x
    ones = (1 << len(b)) - 1
    row = ones
    for v in a:
        both = row & places.get(v, 0)
        row = ((row + both) | (row - both)) & ones
    zero = np.unpackbits(np.frombuffer((row ^ ones).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(zero)))


_PAGE = "page_id long, host string, path string, _key long, _seq binary, lines array<bigint>, boxes array<bigint>"
_ALIGNED = "host string, _seq binary, boxes array<bigint>, shared array<boolean>, weight long"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in slices(batches, "html"):
        cut = [blocks(h.decode(errors="replace")) for h in pages]
        told = [[_hash(t) for t, _, _ in c] for c in cut]
        seq = pa.array([xxhash.xxh128_digest(np.array(x, np.int64).tobytes()) for x in told], pa.binary())
        boxes = pa.array([[b for _, b, _ in c] for c in cut], pa.list_(pa.int64()))
        arrays = [*[batch.column(c) for c in ("page_id", "host", "path", "_key")], seq, pa.array(told, pa.list_(pa.int64())), boxes]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "path", "_key", "_seq", "lines", "boxes"])


def novelty(boxes: list[int], shared: np.ndarray) -> int:
    """Thousandths of a page's blocks that are not shared and lie in boxes that mostly are not, rounded up."""
    _, at = np.unique(np.array(boxes, np.int64), return_inverse=True)
    n, hits = np.bincount(at), np.bincount(at, weights=shared)
    fresh = int((n - hits)[2 * hits < n].sum())
    return -(-1000 * fresh // len(boxes)) if boxes else 0


def _align(rows: pa.Table) -> pa.Table:
    """Which blocks of each page of a group a neighbour shares, and how much that tells (0: nothing).

    Of two neighbours, one that tells less than half as much as the other is left out.
    """
    rows = rows.sort_by([("_rank", "ascending")])
    lines, boxes = rows.column("lines").to_pylist(), rows.column("boxes").to_pylist()
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in lines]
    for i in range(len(lines) - 1):
        a, b = np.zeros(len(lines[i]), bool), np.zeros(len(lines[i + 1]), bool)
        for x, y in lcs(lines[i], lines[i + 1]):
            a[x] = b[y] = True
        weight = max(novelty(boxes[i], a), novelty(boxes[i + 1], b))
        found[i].append((weight, a))
        found[i + 1].append((weight, b))
    weights = [max((w for w, _ in pairs), default=0) for pairs in found]
    shared = [np.any([f for w, f in pairs if 2 * w >= most], axis=0).tolist() if most else [False] * len(x) for x, pairs, most in zip(lines, found, weights, strict=True)]
    return rows.select(["host", "_seq", "boxes"]).append_column("shared", pa.array(shared, pa.list_(pa.bool_()))).append_column("weight", pa.array(weights, pa.int64()))


def with_keys(pages: DataFrame) -> DataFrame:
    """page_id, url, html with host, URL path and a key of the row."""
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return pages.select(
        "page_id",
        "url",
        "html",
        F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.xxhash64("page_id", "url", "html").alias("_key"),
    )


def ranked(pages: DataFrame, group: int) -> DataFrame:
    """_row, host, _seq, `_rank` in the host's URL order and `_group` of the first page of each distinct sequence.

    Only keys are sorted by range; each partition counts for itself.
    """
    first = pages.groupBy("host", "_seq").agg(F.min(F.struct("path", "page_id", "_key", "_row")).alias("_first")).select("host", "_seq", "_first.*")
    first = stored(first.repartitionByRange("host", "path", "page_id", "_key").withColumn("_part", F.spark_partition_id()))
    counts = first.groupBy("host", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("host", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("host")).alias("_all"))
    within = F.row_number().over(Window.partitionBy("host", "_part").orderBy("path", "page_id", "_key"))
    found = first.withColumn("_within", within).join(with_broadcast_if_small(stored(counts)), ["host", "_part"])
    rank = F.col("_before") + F.col("_within") - 1
    last = F.greatest(F.floor(F.col("_all") / group) - 1, F.lit(0))
    return found.withColumn("_rank", rank).select("_row", "host", "_seq", "_rank", F.least(F.floor(F.col("_rank") / group), last).alias("_group"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in slices(batches, "html"):
        out = []
        told = zip(pages, *[batch.column(c).to_pylist() for c in ("shared", "usual")], strict=True)
        for page, shared, usual in told:
            kept = []
            sure = {x >> 1: x & 1 for x in usual or ()}  # places in mostly shared boxes
            for i, (text, _, kind) in enumerate(blocks(page.decode(errors="replace"))):
                gone = kind == "chrome" or (sure.get(i) and shared and shared[i] if kind == "content" else i in sure)
                if not gone:
                    kept.append(text)
            out.append(" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, group: int = GROUP, mostly: float = MOSTLY) -> DataFrame:
    """page_id, url and main text of every row of pages (page_id, url, html)."""
    keyed = with_keys(pages)
    cut = keyed.select("page_id", "host", "path", "_key", "html").mapInArrow(_pages, _PAGE)
    cut = stored(cut.withColumn("_row", F.monotonically_increasing_id()))
    aligned = cut.select("_row", "lines", "boxes").join(ranked(cut, group), "_row").groupBy("host", "_group").applyInArrow(_align, _ALIGNED)
    aligned = stored(aligned)

    each = aligned.where("weight > 0").select("host", "weight", F.explode(F.arrays_zip("boxes", "shared")).alias("x")).select("host", "weight", F.col("x.boxes").alias("box"), F.col("x.shared").cast("long").alias("s"))
    of_host = stored(each.groupBy("host", "box").agg(F.sum(F.col("s") * F.col("weight")).alias("s"), F.sum("weight").alias("n"), F.count("*").alias("blocks")))
    of_all = of_host.groupBy("box").agg(F.sum("s").alias("t"), F.sum("n").alias("m"))
    lines = cut.select("page_id", "_key", "host", F.posexplode("boxes").alias("i", "box"))
    # One row a page and box for the join, with the places of the box's blocks (a set: repeated pages are one).
    lines = lines.groupBy("page_id", "_key", "host", "box").agg(F.collect_set("i").alias("at"))
    judged = lines.join(with_broadcast_if_small(of_host), ["host", "box"], "left").join(with_broadcast_if_small(stored(of_all)), "box", "left")
    usual = F.coalesce(F.col("s") / F.col("n"), F.col("t") / F.col("m"), F.lit(0.0)) > mostly
    # Twice the place, and one more where the host is sure.
    spots = F.transform("at", lambda i: 2 * i.cast("long") + F.when(F.col("blocks") >= SURE, 1).otherwise(0))
    per_page = judged.where(usual).groupBy("page_id", "_key").agg(F.flatten(F.collect_list(spots)).alias("usual"))
    verdict = cut.select("page_id", "_key", "host", "_seq").dropDuplicates(["page_id", "_key"])
    verdict = verdict.join(aligned.select("host", "_seq", "shared"), ["host", "_seq"], "left").join(per_page, ["page_id", "_key"], "left")
    verdict = verdict.select(F.col("page_id").alias("_p"), F.col("_key").alias("_k"), "shared", "usual")
    joined = keyed.join(verdict, keyed["page_id"].eqNullSafe(F.col("_p")) & (keyed["_key"] == F.col("_k")), "left")
    return joined.select("page_id", "url", "html", "shared", "usual").mapInArrow(_texts, "page_id long, url string, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
