"""Main text of pages by comparing each page with its neighbours in URL order within its host.

A page becomes lines: the blocks of its body in page order, each with the chain of elements it stands in. Markup says what is
never content (scripts, styles, navigation, headers and footers of the page, asides) and what names itself a part that is not:
forms, and elements with a class, id or role that is such a name, or begins or ends with such a word (``related-posts``, but not
``has-sidebar`` or ``layout-sidebar-right``; of paragraphs, headings and inline elements only a class that is the whole name). Such
a part is content after all if it holds at least half of the page's declared content (a wrapper, a form around the page), or,
where a page declares none, more than half of its text and does not name itself comments. Content is declared by article and
main; one whose whole class, id or role is such a name is a part that is never content, and one with such a word in a longer name
declares nothing. Inside declared content a name with ``header`` marks its heading and is no part. Pages of a host are put in order of
their URL path, and the lines of pages next to each other are aligned by longest common subsequence.

A line outside declared content goes if the page before or the page after has it too; if all lines of a page are shared with one
of these, the two are copies, and that one says nothing. A line inside declared content goes only if at least ``SUPPORT`` of the
``NEAREST`` nearest pages of the host have it in the same place, counted from the start or from the end of their declared
content; a page that shares more than half of the declared text is a near copy and says nothing. So a passage that some articles
quote, or that near copies share, stays, and a host of up to ``SUPPORT`` pages loses no declared line.

Cases: null and empty html give an empty text. A page without ``://`` in its url is compared under an empty host. Repeated rows
are pages of their own; equal neighbours are copies. Broken markup is read as far as it goes. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.common import partitions
from wavelane.runtime import write_through

NEAREST, SUPPORT = 6, 4      # pages looked at for a line of declared content, and how many of them must have it
BLOCK = 256                  # places of a block
BROADCAST_LINES = 1_000_000  # pages and lines that go, up to which every task gets the whole list
# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
    thead tr ul""".split())
NEVER = frozenset("""script style noscript template head title nav aside button select option textarea input iframe object svg
    canvas audio video dialog menu footer""".split())
CONTENT = frozenset(("article", "main"))
CLOSES_P = BLOCKS - {"html", "body"}
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
# Words of class, id and role that name a part which is not content.
PARTS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disqus footer form header menu modal nav navbar navigation newsletter notice notices popup promo promoted
    related respond reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo
    dialog alert""".split())
_words = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")
_unfinished = re.compile(r"<[a-zA-Z/!][^<>]*\Z")  # a tag cut off by the end of the page
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")


MODIFIERS = frozenset("has no not with without is hide show open page layout".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())


def _names(attributes, words_only: bool):
    """Part names in class, id and role: whole ones, and unless ``words_only`` those a name begins or ends with."""
    for name, value in attributes:
        if not value or name not in ("class", "id", "role") or (words_only and name == "id"):
            continue
        for token in value.split():
            words = _words.findall(_camel.sub(" ", token).lower())
            if not words:
                continue
            if len(words) > 1 and words_only:
                words = ["".join(words)]
            elif words[0] in MODIFIERS:
                continue
            yield from PARTS.intersection((words[0], words[-1], "".join(words), "".join(words[:2]), "".join(words[-2:])))


def _hidden(attributes) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attributes)


def _any_word(attributes) -> bool:
    return any(value and name in ("class", "id", "role") and not PARTS.isdisjoint(_words.findall(_camel.sub(" ", value).lower()))
               for name, value in attributes)


def _whole_part(attributes) -> bool:
    """Whether a whole class, id or role names a part; ``has-sidebar`` or ``comments-open`` of an article does not."""
    return any(name == "hidden" or (name == "aria-hidden" and value == "true")
               or (value and name in ("class", "id", "role") and not PARTS.isdisjoint(value.lower().split())) for name, value in attributes)


class _Blocks(HTMLParser):
    """Blocks of text as (chain of open block elements, text, is content declared)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []  # name, skips, declares, number of the named part or -1
        self.parts: list[str] = []
        self.found: list[tuple[str, str, bool, tuple[int, ...]]] = []
        self.named: list[bool] = []  # of each named part: does it name itself comments

    def _flush(self):
        text = _space.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            chain = "/".join(e[0] for e in self.open if e[0] in BLOCKS)
            self.found.append((chain, text, any(e[2] for e in self.open), tuple(e[3] for e in self.open if e[3] >= 0)))

    def _skips(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag, attributes):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            if not self._skips():
                self._flush()
            if tag in CLOSES_P:
                self._close("p")
        if tag in VOID:
            return
        for siblings in (("li",), ("dd", "dt"), ("td", "th"), ("tr",), ("option",)):
            if tag in siblings and self.open and self.open[-1][0] in siblings:
                self.open.pop()
        inside = any(e[0] in CONTENT for e in self.open)
        # The header of an article belongs to it; the header of a page does not.
        skip = self._skips() or tag in NEVER or (tag == "header" and not inside) or _hidden(attributes) or (
            tag in CONTENT and _whole_part(attributes))
        part = -1
        if not skip and tag not in CONTENT and tag not in ("html", "body"):
            names = set(_names(attributes, tag not in BLOCKS or tag in TEXTUAL)) - ({"header"} if inside else set())
            if names or tag == "form":
                part = len(self.named)
                self.named.append(not COMMENTS.isdisjoint(names))
        self.open.append((tag, skip, tag in CONTENT and not _any_word(attributes), part))

    def _close(self, tag):
        """Close the nearest open element of that name, if none but inline ones are open inside it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in BLOCKS:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        names = [e[0] for e in self.open]
        if tag not in names:
            return
        if tag in BLOCKS and not self._skips():
            self._flush()
        at = len(names) - 1 - names[::-1].index(tag)
        if tag not in BLOCKS and any(n in BLOCKS for n in names[at + 1:]):
            del self.open[at]  # a misnested inline element
        else:
            del self.open[at:]

    def handle_data(self, data):
        if not self._skips():
            self.parts.append(data)

    def close(self):
        super().close()
        if not self._skips():
            self._flush()
        text, declared = np.zeros(len(self.named) + 1), np.zeros(len(self.named) + 1)  # characters in each part; the last is the page
        for _, value, says, parts in self.found:
            for p in (*parts, -1):
                text[p] += len(value)
                declared[p] += len(value) * says
        content = [2 * declared[p] >= declared[-1] if declared[-1] else 2 * text[p] > text[-1] and not comments
                   for p, comments in enumerate(self.named)]
        return [(chain, value, says) for chain, value, says, parts in self.found if all(content[p] for p in parts)]


def blocks(html: str | None) -> list[tuple[str, str, bool]]:
    """(chain, text, declared content) of the blocks of a page that markup does not rule out."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(_unfinished.sub("", html))
    return parser.close()


def shared_lines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Mask of the lines of ``one`` in a longest common subsequence with ``two``; memory grows with the shorter part only.

    Common ends are taken first. The rest is solved by halving (Hirschberg), so long pages need no table of all pairs.
    """
    mask = np.zeros(len(one), bool)
    both = np.isin(one, two)
    if not both.all():  # lines that only one of them has are in no common subsequence
        mask[both] = shared_lines(one[both], two[np.isin(two, one)]) if both.any() else False
        return mask

    def lengths(a, b):
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))
        return row

    stack = [(0, len(one), 0, len(two))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and one[a0] == two[b0]:
            mask[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and one[a1 - 1] == two[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            mask[a1] = True
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            mask[a0] |= bool((two[b0:b1] == one[a0]).any())
            continue
        middle = (a0 + a1) // 2
        best = int(np.argmax(lengths(one[a0:middle], two[b0:b1]) + lengths(one[middle:a1][::-1], two[b0:b1][::-1])[::-1])) + b0
        stack += [(a0, middle, b0, best), (middle, a1, best, b1)]
    return mask


def own_lines(lines: np.ndarray, neighbours: list[np.ndarray]) -> np.ndarray:
    """Mask of the lines of a page that no neighbour shares; a neighbour that shares all is a copy."""
    template = np.zeros(len(lines), bool)
    for other in neighbours:
        common = shared_lines(lines, other)
        if not common.all():
            template |= common
    return ~template


def declared_template(lines: np.ndarray, chars: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Mask of declared lines that at least ``SUPPORT`` of the declared contents ``others`` have in the same place."""
    held = np.zeros(len(lines), np.int64)
    if len(others) < SUPPORT or sum(np.isin(lines, other).astype(np.int64) for other in others).max() < SUPPORT:
        return held > 0  # no line is in so many of them
    for other in others:
        common = shared_lines(lines, other)
        if 2 * chars[common].sum() > chars.sum():
            continue  # a near copy
        n = min(len(lines), len(other))
        same = np.zeros(len(lines), bool)
        same[:n] = lines[:n] == other[:n]
        same[len(lines) - n:] |= lines[len(lines) - n:] == other[len(other) - n:]
        held += common & same
    return held >= SUPPORT


def kept_lines(k: int, pages: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mask of the lines that page ``k`` of pages in order, as (host, lines, which are declared, characters), keeps."""
    host, lines, declared, chars = pages[k]
    near = sorted((j for j in range(max(k - NEAREST, 0), min(k + NEAREST + 1, len(pages))) if j != k and pages[j][0] == host),
                  key=lambda j: (abs(j - k), j))[:NEAREST]
    keep = np.ones(len(lines), bool)
    if not declared.all():
        keep = own_lines(lines, [pages[j][1] for j in near if abs(j - k) == 1])
    if declared.any():
        keep[declared] = ~declared_template(lines[declared], chars[declared], [pages[j][1][pages[j][2]] for j in near])
    return keep


def _lines(batches):
    for batch in batches:
        out = []
        for key, row, host, path, html in zip(batch["key"], batch["row"], batch["host"], batch["path"], batch["html"]):
            found = blocks(html)
            hashes = [xxhash.xxh3_64_intdigest(f"{c}\n{t}".encode("utf-8", "surrogatepass")) - (1 << 63) for c, t, _ in found]
            out.append((key, row, host, path, hashes, [d for _, _, d in found], [len(t) for _, t, _ in found], [t for _, t, _ in found]))
        yield pd.DataFrame(out, columns=["key", "row", "host", "path", "hashes", "declared", "chars", "texts"])


def _dropped(block: pd.DataFrame) -> pd.DataFrame:
    """(id, positions of the lines that go) of the pages of a block of places that lose lines; pages beside the block are copies."""
    block = block.sort_values("place")
    pages = [(host, np.asarray(lines, np.int64), np.asarray(declared, bool), np.asarray(chars, np.int64))
             for host, lines, declared, chars in zip(block["host"], block["hashes"], block["declared"], block["chars"])]
    out = []
    for k, (own, copy) in enumerate(zip(block["id"], block["copy"])):
        if not copy:
            gone = np.flatnonzero(~kept_lines(k, pages))
            if len(gone):
                out.append((own, gone.tolist()))
    return pd.DataFrame(out, columns=["id", "gone"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """key, url, text, n_chars for every row; blocks are joined by an empty line."""
    value = F.coalesce(F.col(url), F.lit(""))
    parsed = write_through(pages.select(F.col(key).alias("key"), F.col(url).alias("row"), F.regexp_extract(value, r"(?s)://([^/?#]*)", 1).alias("host"),
                                        F.regexp_extract(value, r"(?s)://[^/?#]*([^#]*)", 1).alias("path"), F.col(html).alias("html")).mapInPandas(
        _lines, "key long, row string, host string, path string, hashes array<long>, declared array<boolean>, chars array<int>, texts array<string>")
        .withColumn("id", F.monotonically_increasing_id()))
    # Place of every page in the order of host and path: the range partition's offset plus the place in the partition.
    ordered = write_through(parsed.select("id", "host", "path", "key").repartitionByRange(partitions(pages.sparkSession), "host", "path", "key", "id")
                            .sortWithinPartitions("host", "path", "key", "id").select("id", "host", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = F.broadcast(pages.sparkSession.createDataFrame(offsets, "part long, start long"))
    placed = ordered.withColumn("part", part).join(starts, "part").select(
        "id", "host", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))
    # Blocks of places, each with copies of the pages within reach on both sides.
    near = placed.join(parsed.select("id", "hashes", "declared", "chars"), "id").withColumn("block", F.explode(F.array_distinct(F.array(*[
        F.floor((F.col("place") + reach) / BLOCK) for reach in (-NEAREST, 0, NEAREST)]))))
    dropped = write_through(near.withColumn("copy", F.col("block") != F.floor(F.col("place") / BLOCK)).groupBy("block").applyInPandas(
        _dropped, "id long, gone array<int>"))
    # Texts move only if there are too many pages that lose lines for every task to hold their lists.
    size = dropped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gone")).alias("lines")).first()
    few = size["n"] + (size["lines"] or 0) <= broadcast_lines
    told = parsed.select("id", "key", "row", "texts").join(F.broadcast(dropped) if few else dropped.hint("shuffle_merge"), "id", "left")
    text = F.when(F.col("gone").isNull(), F.array_join("texts", "\n\n")).otherwise(F.array_join(F.filter(
        "texts", lambda _, at: ~F.array_contains("gone", at)), "\n\n"))
    return told.select(F.col("key").alias(key), F.col("row").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
