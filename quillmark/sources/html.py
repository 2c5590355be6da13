"""Cards and frames out of crawled HTML.

Pages are read where they lie, by the standard library's streaming parser: one
pass, with the open elements on a stack and no tree.  A page that can't be read
gives a row with ``error`` instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tr ul".split())
UNSEEN = frozenset("script style noscript template head title".split())
IMAGE = re.compile(r"url\([\"']?([^\"')]+)")
#: An element of one of these ends an open one of its kind.
ENDED_BY = {"li": ("li",), "p": tuple(BLOCK - {"br", "body"}), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}


@dataclass(frozen=True)
class Pick:
    """An element that has one of the classes, or whose class attribute holds ``part``."""

    classes: tuple[str, ...] = ()
    part: str = ""

    def meets(self, attribute: str) -> bool:
        return bool(attribute) and (not set(self.classes).isdisjoint(attribute.split()) or bool(self.part and self.part in attribute))


@dataclass(frozen=True)
class CardRules:
    """What marks a card and its parts. The class names of a widely used recommendation widget."""

    card: tuple[str, ...] = ("videoCube", "trc_spotlight_item")
    sponsored: str = "syndicatedItem"
    title: Pick = Pick(("video-title", "trc_ellipsis"), "title")
    description: Pick = Pick(("video-description",), "description")
    advertiser: Pick = Pick(("branding",), "branding")


class Text:
    """Visible text with line breaks at blocks."""

    def __init__(self):
        self.parts: list[str] = []

    def __str__(self) -> str:
        lines = (re.sub(r"[ \t\r\n\f]+", " ", line).strip(" ") for line in "".join(self.parts).split("\0"))
        return "\n".join(line for line in lines if line)


@dataclass
class Card:
    depth: int
    sponsored: bool
    text: Text = field(default_factory=Text)
    #: Of each part the depth of its element and its text; the first element that meets a pick counts.
    parts: dict[str, tuple[int, Text]] = field(default_factory=dict)
    landing_url: str = ""
    image_url: str | None = None


class Reader(HTMLParser):
    """Cards, links, alternative texts and visible text of one page."""

    def __init__(self, page_url: str, rules: CardRules):
        super().__init__(convert_charrefs=True)
        self.page_url, self.rules = page_url or "", rules
        self.open: list[str] = []
        self.cards: list[Card] = []
        self.inside: list[Card] = []
        self.links: list[str] = []
        self.alts: list[str] = []
        self.text = Text()
        self.unseen = 0

    def _absolute(self, url: str) -> str:
        try:
            return urljoin(self.page_url, url.strip())
        except ValueError:
            return url

    def _sinks(self) -> Iterator[Text]:
        yield self.text
        for card in self.inside:
            yield card.text
            for depth, text in card.parts.values():
                if depth <= len(self.open):
                    yield text

    def _break(self, tag: str) -> None:
        if tag in BLOCK:
            for text in self._sinks():
                text.parts.append("\0")

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self.open and tag in ENDED_BY.get(self.open[-1], ()):
            self._close(len(self.open) - 1)
        found = {k: v or "" for k, v in reversed(attributes)}  # of a repeated attribute the first counts
        classes = found.get("class", "")
        self._break(tag)
        if tag not in VOID:
            self.open.append(tag)
            self.unseen += tag in UNSEEN
        depth = len(self.open) + (tag in VOID)
        for card in self.inside:
            self._meet(card, depth, tag, classes, found)
        if set(self.rules.card) <= set(classes.split()) and self.rules.card and tag not in VOID:
            card = Card(depth, self.rules.sponsored in classes.split())
            self.cards.append(card)
            self.inside.append(card)
        if tag == "a" and "href" in found:
            self.links.append(self._absolute(found["href"]))
        if tag == "img" and found.get("alt"):
            self.alts.append(found["alt"])

    def _meet(self, card: Card, depth: int, tag: str, classes: str, found: dict[str, str]) -> None:
        for name in ("title", "description", "advertiser"):
            if name not in card.parts and getattr(self.rules, name).meets(classes):
                card.parts[name] = (depth, Text())
        if tag == "a" and "href" in found and not card.landing_url:
            card.landing_url = self._absolute(found["href"])
        if card.image_url is None and (tag == "img" or "background-image" in found.get("style", "")):
            inner = IMAGE.search(found.get("style", ""))
            card.image_url = (self._absolute(found["src"]) if found.get("src") else "") if tag == "img" else (inner[1] if inner else "")

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self._close(len(self.open) - 1 - self.open[::-1].index(tag))

    def _close(self, down_to: int) -> None:
        while len(self.open) > down_to:
            self._break(self.open[-1])
            tag = self.open.pop()
            self.unseen -= tag in UNSEEN
            for card in self.inside:  # a part that ended takes no more text
                card.parts = {k: ((d if d <= len(self.open) else 1 << 30), t) for k, (d, t) in card.parts.items()}
            self.inside = [c for c in self.inside if c.depth <= len(self.open)]

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            for text in self._sinks():
                text.parts.append(data)


CARD = "page_id long, page_url string, place int, sponsored boolean, title string, description string, advertiser string, raw_text string, landing_url string, image_url string, error string"
FRAME = "page_id long, page_url string, text string, links array<string>, alts array<string>, error string"


def _read(html: str | None, page_url: str | None, rules: CardRules) -> tuple[Reader, str | None]:
    reader = Reader(page_url or "", rules)
    try:
        reader.feed(html or "")
        reader.close()
    except Exception as e:  # noqa: BLE001 - one bad page must not end the job
        return Reader("", rules), f"{type(e).__name__}: {e}"
    return reader, None


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("page_url"), F.col("html").cast("string").alias("html"))


def cards(pages: DataFrame, rules: CardRules = CardRules()) -> DataFrame:
    """CARD rows of pages (page_id, url, html): each card in the order of the page, as ``creatives.parsed_cards`` takes them.

    Pages that are null or empty or have no card give no row; one that can't be
    read gives a row with ``error`` alone.  Links are absolute.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split() for c in CARD.split(", ")), strict=True)
        types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[k] for k in kinds]
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "page_url", "html")), strict=True):
                reader, error = _read(html, url, rules)
                if error:
                    rows.append((page_id, url, *[None] * 8, error))
                for place, card in enumerate(reader.cards):
                    said = [str(card.parts[n][1]) if n in card.parts else "" for n in ("title", "description", "advertiser")]
                    rows.append((page_id, url, place, card.sponsored, *said, str(card.text), card.landing_url, card.image_url or "", None))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

    return _pages(pages).mapInArrow(run, CARD)


def frames(pages: DataFrame, most: int = 5) -> DataFrame:
    """FRAME rows of pages: visible text, and the first links and alternative texts, as ``creatives.parsed_frames`` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            read = [_read(h, u, CardRules(card=())) for u, h in zip(batch["page_url"].to_pylist(), batch["html"].to_pylist(), strict=True)]
            texts = [str(r.text) if e is None else None for r, e in read]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["page_url"], pa.array(texts, pa.string()), pa.array([r.links[:most] for r, _ in read], strings), pa.array([r.alts[:most] for r, _ in read], strings), pa.array([e for _, e in read], pa.string())],
                ["page_id", "page_url", "text", "links", "alts", "error"],
            )

    return _pages(pages).mapInArrow(run, FRAME)
