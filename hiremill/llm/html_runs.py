"""HTML extraction: blocks by markup, and boilerplate by the substrings that the pages of a host share.

1. Each page becomes blocks of text. A block is content (inside an article or main element), chrome (menus, headers, footers, sidebars,
   notices, adverts, forms, comments) or open (neither). Chrome never comes back; content is never taken away, however often other
   pages repeat it. On a page without content elements the open blocks decide.
2. Repeated substrings of a host's pages: every suffix of a chrome or open block, cut at `RUN_TOKENS` tokens, is a hash. Shorter blocks of
   one kind that follow one another are a substring together, from each of them on until they have so many tokens. Spark deals the hashes
   by (host, hash); one that two or more distinct bodies have is a repeated substring of at least that length. These are the intervals
   of a suffix array at that depth; it is not sorted further, since all positions of a longer repeat lie in repeats of that length.
   Pages with equal blocks are one body, so that copies under other keys do not take each other's text.
3. Positions of open blocks that lie in repeated substrings are covered; blocks keep their uncovered runs.

Only pages with open blocks and no content element take part in step 3. No page, host or interval is gathered in one place.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.arrays import mixed
from hiremill.llm.shared import ship_package, written
from hiremill.llm.url_rules import split_url

#: Tokens of a repeated substring at least, and distinct pages that hold it.
RUN_TOKENS, PAGES = 6, 2
CONTENT, CHROME, OPEN = 0, 1, 2

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose text is dropped up to their end tag, whatever it holds.
_RAW = frozenset({"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "head"})
_CHROME_TAGS = frozenset({"nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "select", "label", "fieldset"})
_CONTENT_TAGS = frozenset({"article", "main"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
_INLINE = frozenset({"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "mark", "q", "s",
                     "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"})
#: Words in a class or id that mark chrome anywhere, and those that do so outside content only (an article has a header of its own).
_CHROME_WORDS = (r"ads?|advert\w*|promo\w*|sponsor\w*|nav\w*|menu|breadcrumbs?|footer|sidebar|aside|widget|related|share|social|cookies?|consent|gdpr|notice|alert|popup|modal|"
                 r"overlay|newsletter|subscribe|signup|login|comments?|disqus|replies|reply|respond|pagination|pager")
_OUTER_WORDS = r"banner|header|masthead|side|copyright|legal|toolbar|search"
#: Parts that a class or id of chrome may have beside such a word: what kind of box it is and where it stands.
_BOX_WORDS = (r"box|bar|block|container|wrap|wrapper|area|section|list|links?|slot|unit|inner|outer|top|bottom|left|right|site|page|main|global|fixed|sticky|buttons?|icons?|items?|"
              r"content|form|thread|user|reader|primary|secondary|col|column|row|text|js|is|has|open|active|[0-9]+")
_CHROME_NAMES = {inside: re.compile(rf"(?:{_CHROME_WORDS}{'' if inside else '|' + _OUTER_WORDS})\Z", re.I) for inside in (False, True)}
_BOX_NAME, _PARTS = re.compile(rf"(?:{_BOX_WORDS})\Z", re.I), re.compile("[_-]+")


def _names_chrome(value: str, inside_content: bool) -> bool:
    """Whether a whole name of a class or id is a word of chrome, or a compound of such words and words for boxes."""
    word = _CHROME_NAMES[inside_content]
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        found = [bool(word.match(p)) for p in parts]
        if any(found) and all(f or _BOX_NAME.match(p) for p, f in zip(parts, found)):
            return True
    return False


_CHROME_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"})
#: Elements that an open start tag of the key ends.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BLOCK_ENDS_P = frozenset({"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main",
                           "nav", "ol", "pre", "section", "table", "ul"})


def _is_chrome(tag: str, attributes: str, inside_content: bool) -> bool:
    if tag in _CHROME_TAGS:
        return not (tag == "header" and inside_content)
    if not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and tag not in _CONTENT_TAGS and tag != "body" and _names_chrome(value, inside_content):
            return True
        if name == "role" and value.lower() in _CHROME_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
    return False


def blocks_of(source: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order: references decoded, white space single, trimmed, never empty."""
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # element and the kind outside of it
    kind, position, lowered = OPEN, 0, None

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append((kind, text))
            buffer.clear()

    while True:
        tag = _TAG.search(source, position)
        if tag is None:
            buffer.append(source[position:])
            break
        if tag.start() > position:
            buffer.append(source[position:tag.start()])
        position = tag.end()
        name = tag.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "br":
                buffer.append(" ")
            if name in _VOID:
                continue
            if not tag.group(1) and not _is_chrome(name, tag.group(3), kind == CONTENT):
                continue
            if tag.group(1) and not any(t == name for t, _ in stack):
                continue
        flush()
        if tag.group(1):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                kind = stack[at][1]
                del stack[at:]
            continue
        if name in _RAW:
            lowered = lowered if lowered is not None else source.lower()
            end = lowered.find(f"</{name}", position)
            if name == "head":
                body = re.compile(r"</head|<body", re.I).search(source, position)
                end = body.start() if body else -1
                position = len(source) if end < 0 else end
                continue
            close = source.find(">", end) if end >= 0 else -1
            position = len(source) if close < 0 else close + 1
            continue
        if name in _BLOCK_ENDS_P or name == "p":
            while stack and stack[-1][0] == "p":
                kind = stack.pop()[1]
        for ended in _ENDS.get(name, ()):
            if stack and stack[-1][0] == ended:
                kind = stack.pop()[1]
        if name in _VOID or tag.group(3).endswith("/"):
            continue
        stack.append((name, kind))
        if kind != CHROME:
            if _is_chrome(name, tag.group(3), kind == CONTENT):
                kind = CHROME
            elif name in _CONTENT_TAGS:
                kind = CONTENT
    flush()
    return out


def _token_hashes(tokens: list[str]) -> np.ndarray:
    import xxhash

    return np.asarray([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)


def suffix_keys(tokens: list[str], length: int = RUN_TOKENS) -> np.ndarray:
    """Sort keys of the suffixes: hashes of their first `length` tokens. Shorter suffixes have none."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    own, key = _token_hashes(tokens), np.full(n, np.uint64(length))
    for k in range(length):
        key = mixed(key ^ own[k:k + n])
    return key.view(np.int64)


def short_runs(blocks: list[tuple[int, str]], length: int = RUN_TOKENS) -> list[tuple[int, int, int]]:
    """(key, first block, end block): blocks of one kind, each of fewer than `length` tokens, that have so many only together."""
    import xxhash

    size, out = [text.count(" ") + 1 for _, text in blocks], []
    for i, (kind, _) in enumerate(blocks):
        end, total = i, 0
        while kind != CONTENT and total < length and end < len(blocks) and blocks[end][0] == kind and size[end] < length:
            total += size[end]
            end += 1
        if total >= length:
            out.append((xxhash.xxh64_intdigest("\n".join(t for _, t in blocks[i:end]), length) - (1 << 63), i, end))
    return out


def _body(blocks: list[tuple[int, str]]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\n".join(f"{kind}{text}" for kind, text in blocks)) - (1 << 63)


def repeated_runs(pages: DataFrame, run_tokens: int, page_count: int) -> DataFrame:
    """(host, suffix): suffix keys of chrome and open blocks that stand in `page_count` or more distinct bodies of a host.

    The streams of `pages` (url, html) are cut into suffixes where they are read; within a page a key counts once, so a hot host
    or a frequent interval is summed before it is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, owners = [], [], []
            for url, source in zip(*(c.to_pylist() for c in batch.columns)):
                host, blocks = split_url(url)[0], blocks_of(source or "")
                found = [suffix_keys(text.split(" "), run_tokens) for kind, text in blocks if kind != CONTENT]
                own = np.unique(np.concatenate([*found, np.asarray([key for key, _, _ in short_runs(blocks, run_tokens)], np.int64)]))
                hosts += [host] * len(own)
                owners += [_body(blocks)] * len(own)
                keys.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(owners, pa.int64())], names=["host", "suffix", "body"])

    suffixes = pages.mapInArrow(run, "host string, suffix long, body long")
    if page_count <= 2:
        return suffixes.groupBy("host", "suffix").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("host", "suffix")
    return suffixes.distinct().groupBy("host", "suffix").agg(F.count("*").alias("n")).where(F.col("n") >= page_count).select("host", "suffix")


def _joined(blocks: list[tuple[int, str]], kind: int) -> str:
    return "\n".join(text for k, text in blocks if k == kind)


def _undecided(blocks: list[tuple[int, str]]) -> bool:
    """Open blocks and no content: other pages have to tell what is boilerplate."""
    kinds = {k for k, _ in blocks}
    return OPEN in kinds and CONTENT not in kinds


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", run_tokens: int = RUN_TOKENS, page_count: int = PAGES) -> DataFrame:
    """(key, url, text, n_chars) of every page: content blocks, or without any the open blocks' runs that no other body of the host repeats.

    Null or empty html gives an empty text. A null url has an empty host, which is a host like others. Pages of equal blocks are one
    body, so repeated rows and copies under other keys do not count as a repetition, and each of them is returned. Other columns are not
    read; an empty table gives an empty result.
    """
    ship_package(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    rows = rows.withColumn("page", F.xxhash64(F.col("key").cast("string"), "url", "html"))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [blocks_of(markup or "") for markup in batch.column(2).to_pylist()]
            keep = pa.array([not _undecided(b) for b in blocks])
            texts = pa.array([_joined(b, CONTENT) for b in blocks], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["key", "url", "text"]).filter(keep)

    def pending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_undecided(blocks_of(markup or "")) for markup in batch.column(2).to_pylist()]))

    # Pages that their markup settles go straight to the result; only the others are written, shuffled and joined.
    schema = f"key {kind}, url string, html string, page long"
    open_rows = written(rows.mapInArrow(pending, schema), "pages")
    open_pages = open_rows.select("page", "url", "html").dropDuplicates(["page"])
    repeated = repeated_runs(rows.select("url", "html"), run_tokens, page_count)

    def open_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"page": [], "host": [], "suffix": [], "block": [], "at": []}
            for page, link, markup in zip(*(c.to_pylist() for c in batch.columns)):
                host, blocks = split_url(link)[0], blocks_of(markup or "")
                places = [(key, i, at) for i, (kind, text) in enumerate(blocks) if kind == OPEN for at, key in enumerate(suffix_keys(text.split(" "), run_tokens).tolist())]
                places += [(key, i, 0) for key, first, end in short_runs(blocks, run_tokens) if blocks[first][0] == OPEN for i in range(first, end)]
                out["page"] += [page] * len(places)
                out["host"] += [host] * len(places)
                for name, values in zip(("suffix", "block", "at"), zip(*places)):
                    out[name] += values
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["page"], pa.int64()), pa.array(out["host"], pa.string()), pa.array(out["suffix"], pa.int64()), pa.array(out["block"], pa.int32()), pa.array(out["at"], pa.int32())],
                names=list(out))

    covered = (open_pages.select("page", "url", "html").mapInArrow(open_suffixes, "page long, host string, suffix long, block int, at int")
               .join(repeated, ["host", "suffix"], "left_semi").groupBy("page").agg(F.collect_list(F.struct("block", "at")).alias("covered")))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for markup, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                blocks = [(k, t.split(" ")) for k, t in blocks_of(markup or "")]
                hidden = [np.zeros(len(t), bool) for _, t in blocks]
                for hit in hits or ():
                    hidden[hit["block"]][hit["at"]:hit["at"] + run_tokens] = True
                kept = [" ".join(w for w, h in zip(t, mask) if not h) for (k, t), mask in zip(blocks, hidden) if k == OPEN]
                texts.append("\n".join(t for t in kept if t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page", "run_text"])

    runs = open_pages.select("page", "html").join(covered, "page", "left").mapInArrow(second, "page long, run_text string")
    late = open_rows.select("key", "url", "page").join(runs, "page", "left").select("key", "url", F.coalesce("run_text", F.lit("")).alias("text"))
    out = rows.mapInArrow(settled, f"key {kind}, url string, text string").unionByName(late)
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
