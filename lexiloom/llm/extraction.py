"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, told apart by their path, and its text blocks, told apart by their path and words.
Single words are no tokens: a word that all articles of a host share would be cut out of them. Tokens with the same
occurrence vector over the pages of a host, that is as often as each other on each page, form a class. A vector is kept
as two sums of hashes of page and count, so classes come from partial aggregates and no host's pages are gathered. A class
is valid if it has CLASS_SIZE tokens and covers half of the host's pages.

Blocks that occur equally often on all pages are the template's text, and so are those of valid classes that all but a tenth
of the pages (which are of another make) hold equally often. Elements of valid classes that occur once a page
are its frame, nested by their paths; between them lie the slots. The main slot is the smallest element of the frame that
holds all text that varies, links aside. What remains in it is extracted, without slots that the markup itself sets
aside: adverts and comments vary like articles do, so there the element's name decides (see markup.events).

The more pages, the surer a shared text is the template's: a template is taken as such while shared text is less than
1 - 1 / pages of the host's text, equal pages counted once. So a page alone on its host, or copies of one, have none; they
and pages without anything in the main slot are read by their own elements: their article or main, or else the whole.

Defined results: null and empty pages have the empty text; a null url is a host of its own; repeated rows are extracted
one by one and count as one page of the template; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table
from .markup import BLOCKS, ROOT, Element, block_token, blocks, events

#: Tokens in a valid class, the share of a host's pages it covers, and the share that the template's text is on.
CLASS_SIZE, COVER, ALL = 3, 0.5, 0.9
TOKENS = "own string, page long, token long, parent long, block boolean, slot boolean, n int, depth int, chars long"


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_tokens(html: str) -> list[tuple[int, int, bool, bool, int, int, int]]:
    """(token, parent, block, slot, n, depth, chars) of each token of a page: chars of main text that is not of links, slot whether it can be the main slot."""
    page = events(html)
    found: dict[tuple[int, bool], list] = {}

    def add(token: int, parent: int, block: bool, slot: bool, depth: int, chars: int) -> None:
        if known := found.get((token, block)):
            known[4] += 1
            known[6] += chars
        else:
            found[token, block] = [token, parent, block, slot, 1, depth, chars]

    for element, text in blocks(page):
        chars = 0 if element.linked else len(text) - text.count(" ")
        element.chars += chars
        add(block_token(element, text), element.path, True, False, element.depth + 1, chars)
    for kind, e, _ in page:
        if kind == "close" and not e.aside:
            add(e.path, e.above.path if e.above is not None else ROOT, False, e.name in BLOCKS, e.depth, e.chars)
            if e.above is not None:
                e.above.chars += e.chars
    return [tuple(v) for v in found.values()]


def tokens_of(pages: DataFrame) -> DataFrame:
    """TOKENS of pages (own, page, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int64())
        for batch in slices(batches, "html"):
            rows = [(own, page, *token) for own, page, html in zip(*(batch.column(c).to_pylist() for c in ("own", "page", "html")), strict=True) for token in page_tokens(html)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in TOKENS.split(", ")])

    return pages.select("own", "page", "html").mapInArrow(run, TOKENS)


def classes(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    """The tokens of each host (own, token, parent, block, slot, depth, chars, on, once, same, vector) with the size of their class.

    once: it occurs once on each page it is on; same: what it holds is on all pages alike. hosts: own, rows, pages.
    """
    h = F.xxhash64("page", "n")
    vector = F.struct(F.sum(h.bitwiseAND(0x7FFFFFFF)).alias("a"), F.sum(F.shiftright(h, 32).bitwiseAND(0x7FFFFFFF)).alias("b"), F.count(F.lit(1)).alias("on"))
    seen = tokens.groupBy("own", "token", "block").agg(
        vector.alias("vector"), F.count(F.lit(1)).alias("on"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("parent").alias("parent"), F.first("slot").alias("slot"), F.min("depth").alias("depth"), F.sum("chars").alias("chars")
    )
    # a token on fewer pages is in no valid class and holds none that is
    held = cut(seen.join(hosts, "own").where(F.col("on") >= COVER * F.col("rows")))
    size = held.groupBy("own", "vector").agg(F.count(F.lit(1)).alias("size"))
    once, equal = F.col("high") == 1, F.col("low") == F.col("high")
    same = equal & ((F.col("on") == F.col("rows")) | ((F.col("on") >= ALL * F.col("rows")) & (F.col("size") >= CLASS_SIZE)))
    return held.join(size, ["own", "vector"]).select("own", "token", "parent", "block", "slot", "depth", "chars", "on", once.alias("once"), same.alias("same"), "vector", "size", "pages")


def slot_of(frame, pages: int):
    """The main slot's path (null: the root) and the template's blocks, from a host's tokens; null if its text is no template's."""
    elements = {r["token"]: r for r in frame if not r["block"]}
    shared = [r for r in frame if r["block"] and r["same"]]
    total = elements[ROOT]["chars"]
    constant = sum(r["chars"] for r in shared)
    if constant * pages >= total * (pages - 1):
        return None
    below = dict.fromkeys(elements, 0)  # shared characters below each element
    for r in shared:
        if r["parent"] in below:
            below[r["parent"]] += r["chars"]
    for r in sorted(elements.values(), key=lambda r: -r["depth"]):
        if r["token"] != ROOT and r["parent"] in below:
            below[r["parent"]] += below[r["token"]]
    slots = [r for r in elements.values() if r["slot"] and r["once"] and r["size"] >= CLASS_SIZE and r["chars"] - below[r["token"]] == total - constant]
    main = max(slots, key=lambda r: (r["depth"], -r["token"]), default=None)
    return main and main["token"], sorted(r["token"] for r in shared)


def templates(pages: DataFrame) -> DataFrame:
    """(own, main, shared) of each host of pages (own, page, html) that has a template: the path of its main slot and the tokens of its own text blocks."""
    hosts = cut(pages.groupBy("own", "page").agg(F.count(F.lit(1)).alias("rows")).groupBy("own").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("pages")).where("pages > 1"))
    tokens = tokens_of(pages).join(hosts.select("own"), "own", "left_semi")
    # what is on half of the pages or more is about as many rows as two pages have tokens
    frames = classes(tokens, hosts).groupBy("own").agg(F.collect_list(F.struct("token", "parent", "block", "slot", "once", "same", "size", "depth", "chars")).alias("frame"), F.max("pages").alias("pages"))
    slot = F.udf(slot_of, "main long, shared array<long>")
    return frames.select("own", slot("frame", "pages").alias("slot")).where("slot is not null").select("own", "slot.main", "slot.shared")


def main_text(html: str, main: int | None = None, shared: list[int] | None = None) -> str:
    """The text of a page's main slot without its template's blocks; without a template (shared is None), or if nothing is left, that of its own article or main, or else all that is not aside."""
    page = events(html)
    if shared is not None:
        known = set(shared)
        found = [text for element, text in blocks(page, None if main is None else {main}) if block_token(element, text) not in known]
        if found or main is None:
            return "\n".join(found)
    said: list[Element] = []
    open_ = 0
    for kind, e, _ in page:  # outermost ones that hold text
        if kind == "open" and e.main and not e.aside:
            if not open_ and e.plain:
                said.append(e)
            open_ += 1
        elif kind == "close" and e.main and not e.aside:
            open_ -= 1
    return "\n".join(text for _, text in blocks(page, {e.path for e in said} or None))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    hosted = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), host_of("url").alias("own"), F.xxhash64(html).alias("page"))
    joined = hosted.join(templates(hosted), "own", "left").select("page_id", "url", "html", "main", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "shared")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
