"""Main text of web pages: a suffix array over the host's pages finds the text that pages share; what is theirs alone stays, and an article as it stands.

A page's blocks are those inside its ``article``, less what markup excludes (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments); without an ``article``, those within ``main``, or else the whole body.
Every page is judged by what it shares with others of its host and kind (with an article or without). Pages that a task
parses together, about ``PIECE_BYTES`` of them, are a piece, so that a host, or a row that is repeated, with a third of all
pages is spread over many tasks. In each piece the pages' blocks form one word stream, sorted into a suffix array (page and block
ends are separators). Neighbours that agree in ``MIN_WORDS`` words are one window; a piece sends the distinct windows of each
host, as sorted codes of host and words, with how many of its pages have them. Sums over all pieces, by ranges of codes, tell
which windows ``MIN_PAGES`` distinct pages of the host have or more, wherever these pages lie, and each piece gets back those
of its own. So texts do not depend on how the input is cut. Such windows mark shared words; longer shared passages are unions
of them. Codes have ``SPARE_BITS`` more bits than the input's size takes, so that a window shares its code with a different
one with a chance of about 1 in 8,000 at any size; that matters only if more than half of a block's words are so covered. A
block whose words are mostly shared is boilerplate and goes, unless it is part of an article: many articles share sentences,
and the contract has an article whole. ``judge_pages`` also tells how many of a page's blocks are shared, gone or not.

Defined cases: a null or empty page has an empty text. Pages without an ``article`` that are copies of each other lose their
text, for it is shared. Repeated rows are pages of their own. Broken markup (unclosed tags, cut character references) is read
as browsers do where that is simple: a block tag ends an open paragraph, an end tag closes what it encloses. Extra columns
are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts, suffix_array
from .urls import host_of

MIN_WORDS = 5
MIN_PAGES = 3
#: Bytes of html, about, of the pages that share a suffix array, and of those whose windows' counts are summed at once.
PIECE_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
#: Ranges of codes at least, so that small tables are dealt out evenly.
RANGES = 64
#: Bits of a code beyond those of the number of html bytes (a window takes six bytes or more).
SPARE_BITS = 10
#: Words that one suffix array covers, besides the overlap; a longer stream takes several.
STREAM_WORDS = 1 << 20
MESSAGE = "part int, piece long, n int, codes binary, counts binary"
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Tells the articles of a host from its other pages.
_ARTICLE = 0x2545F4914F6CDD1D
#: A block goes if more of it is shared.
MOST = 0.5

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.DOTALL | re.IGNORECASE
)
_label = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
# Tag names by their role in a page.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form menu dialog head button select option label".split())
# Words of class, id and role attributes that name what is not the main text.
_AWAY = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|banner|footer|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|replies|disqus|contentinfo|complementary|search)(?:$|[\s_-])", re.IGNORECASE)


# Which open elements a start tag ends, up to the nearest enclosing container.
_ENDS = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}}
_HOLDS = frozenset("article aside blockquote body details dialog div dl footer form header main nav ol section table ul".split())


def blocks_of(page: str | None) -> tuple[list[str], list[str]]:
    """The page's text blocks in order: those inside an article; where there is none, those that markup doesn't exclude."""
    inside: list[str] = []
    body: list[str] = []
    main: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # tag, excluded, in an article, in main
    run: list[str] = []
    has_article = has_main = False

    def flush() -> None:
        """End a block; ``run`` never holds excluded text."""
        if run:
            text = " ".join(htmllib.unescape("".join(run)).split())
            run.clear()
            if text:
                (inside if stack[-1][2] else body).append(text)
                if stack[-1][3]:
                    main.append(text)

    page = page or ""
    at = 0
    for m in _token.finditer(page):
        if m.start() > at and not stack[-1][1]:
            run.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        is_block = name in _BLOCK
        if name == "br":
            if not stack[-1][1]:
                run.append(" ")
        elif m[2]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if i and (is_block or not any(x[0] in _BLOCK for x in stack[i:])):
                if is_block:
                    flush()
                del stack[i:]
        else:
            if is_block:
                flush()
                ends = _ENDS.get(name, {"p"})
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in _HOLDS:
                        break
                    if stack[i][0] in ends:
                        del stack[i:]
            if name in _VOID:
                continue
            _, out, art, mn = stack[-1]
            if not out:
                labels = " ".join(a or b or c for a, b, c in _label.findall(m[4])) if m[4] else ""
                out = name in _OUT or name == "header" and not art or bool(labels and name not in ("html", "body", "article", "main") and _AWAY.search(labels))
                if not out and name == "article":
                    art = has_article = True
                if not out and name == "main":
                    mn = has_main = True
            stack.append((name, out, art, mn))
    if at < len(page) and not stack[-1][1]:
        run.append(page[at:])
    flush()
    if has_article:
        return inside, []
    return [], main if has_main else body


class Stream:
    """The blocks (lists of words) of pages as one sequence of word numbers, a 0 after each block."""

    def __init__(self, pages: list[list[list[str]]], hosts: np.ndarray | None = None, bits: int = 48):
        self.bits = bits
        number: dict[str, int] = {}
        seq: list[int] = []
        page_of: list[int] = []
        for p, blocks in enumerate(pages):
            for words in blocks:
                seq += [number.setdefault(w, len(number) + 1) for w in words]
                seq.append(0)
                page_of += [p] * (len(words) + 1)
        self.pages = pages
        self.s, self.page = np.array(seq, np.int64), np.array(page_of, np.int64)
        self.hashes = np.array([0, *[xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number]], np.uint64)
        self.hosts = (hosts if hosts is not None else np.zeros(len(pages), np.int64)).astype(np.uint64)
        self.place = np.empty(len(pages), np.int64)  # pages in the order of hosts
        self.place[np.argsort(self.hosts, kind="stable")] = np.arange(len(pages))

    def codes(self, at: np.ndarray, min_words: int) -> np.ndarray:
        """The codes of the windows that begin at ``at``: a hash of the host and the words."""
        h = self.hosts[self.page[at]] * _MUL
        for k in range(min_words):
            h = (h ^ self.hashes[self.s[at + k]]) * _MUL
            h ^= h >> np.uint64(29)
        return h * _MUL >> np.uint64(64 - self.bits)

    def starts(self, min_words: int) -> np.ndarray:
        """Where windows of words of one block begin."""
        n = len(self.s)
        ends = np.flatnonzero(self.s == 0)
        return np.flatnonzero(ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) >= min_words)

    def groups(self, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each overlapping part of the stream: where windows begin, equal ones of a host beside each other and by page, and where such a group begins.

        Neighbours in the suffix array that agree in ``min_words`` words are one window.
        """
        inside = np.zeros(len(self.s), bool)
        inside[self.starts(min_words)] = True
        for at in range(0, len(self.s), STREAM_WORDS):
            sa, _ = suffix_array(np.append(self.s[at : at + STREAM_WORDS + min_words - 1], 0), len(self.hashes))
            rows = sa[sa < min(STREAM_WORDS, len(self.s) - at)] + at
            rows = rows[inside[rows]]
            other = np.zeros(len(rows), bool)
            other[:1] = True
            for k in range(min_words):
                word = self.s[rows + k]
                other[1:] |= word[1:] != word[:-1]
            window = np.cumsum(other)
            order = np.argsort(window * len(self.pages) + self.place[self.page[rows]])
            rows, window = rows[order], window[order]
            host = self.hosts[self.page[rows]]
            other[1:] = (window[1:] != window[:-1]) | (host[1:] != host[:-1])
            yield rows, np.flatnonzero(other)

    def counts(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes in order, and how many pages have each."""
        codes, counts, pages = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, begin in self.groups(min_words):
            page = self.page[rows]
            new = np.ones(len(rows), bool)
            new[1:] = page[1:] != page[:-1]
            new[begin] = True
            codes.append(self.codes(rows[begin], min_words))
            counts.append(np.add.reduceat(new.astype(np.int64), begin) if len(begin) else counts[0])
            pages.append(page[new])
        code, n = np.concatenate(codes), np.concatenate(counts)
        if len(codes) > 2:  # a page that the parts cut counts once
            code, page = np.repeat(code, n), np.concatenate(pages)
            order = np.lexsort((page, code))
            code, page = code[order], page[order]
            new = np.append(True, (code[1:] != code[:-1]) | (page[1:] != page[:-1]))
            return np.unique(code[new], return_counts=True)
        order = np.argsort(code)
        code, n = code[order], n[order]
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        return code[begin], np.add.reduceat(n, begin) if len(begin) else n

    def shares(self, shared: np.ndarray, min_words: int) -> list[list[float]]:
        """For each page's blocks: the share of a block's words that stand in windows with a code of ``shared``."""
        cover = np.zeros(len(self.s) + 1, np.int64)
        for rows, begin in self.groups(min_words) if len(shared) else ():
            hit = rows[np.repeat(np.isin(self.codes(rows[begin], min_words), shared), np.diff(begin, append=len(rows)))]
            cover[hit] += 1
            np.subtract.at(cover, hit + min_words, 1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        out, at = [], 0
        for blocks in self.pages:
            shares = []
            for words in blocks:
                k = len(words)
                shares.append(float(covered[at + k] - covered[at]) / k if k else 0.0)
                at += k + 1
            out.append(shares)
        return out


def shared_words(streams: list[list[list[str]]], min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES) -> list[list[float]]:
    """For each page's blocks (lists of words): the share of a block's words that stand in windows which enough pages have."""
    stream = Stream(streams)
    code, n = stream.counts(min_words)
    return stream.shares(code[n >= min_pages], min_words)


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as the bytes of their differences, low bytes first, compressed."""
    steps = np.diff(values.astype("<u8"), prepend=np.uint64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def freeze(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def thaw(packs: pa.Array | pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs])


def text_of(article: bool, blocks: list[str], shares: list[float]) -> str:
    """A page's blocks less those of which more than half is shared; an article's all stay, for the contract has them whole."""
    return "\n\n".join(b for b, share in zip(blocks, shares, strict=True) if article or share <= MOST)


def main_texts(pages: list[str | None], min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES) -> list[str]:
    """Main texts of a run of one host's pages."""
    both = [blocks_of(p) for p in pages]
    stream = Stream([[b.split(" ") for b in keep or rest] for keep, rest in both], np.array([_ARTICLE if keep else 0 for keep, _ in both], np.int64))
    code, n = stream.counts(min_words)
    return [text_of(bool(keep), keep or rest, sh) for (keep, rest), sh in zip(both, stream.shares(code[n >= min_pages], min_words), strict=True)]


def judge_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text, n_chars, n_blocks, n_shared) of every page: its blocks, and those of them of which more than half is shared."""
    kind = df.schema[id_col].dataType.simpleString()
    size = df.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    ranges = max(RANGES, size // RANGE_BYTES)
    src = df.select(F.xxhash64(host_of(url_col)).alias("host"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    bits = min(60, max(36, int(size).bit_length() + SPARE_BITS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each piece: its number, and its pages' blocks."""
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(parts(batches, 3, PIECE_BYTES)):
            both = [blocks_of(p) for p in batch.column(3).to_pylist()]
            article = pa.array([bool(keep) for keep, _ in both], pa.bool_())
            blocks = pa.array([keep or rest for keep, rest in both], pa.list_(pa.string()))
            pages = pa.table([*batch.columns[:3], article, blocks], names=["host", "id", "url", "article", "blocks"])
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([freeze(pages)], pa.binary())], names=["piece", "pages"])

    def stream_of(pages: pa.Table) -> tuple[list[list[str]], Stream]:
        blocks = pages.column("blocks").to_pylist()
        host = pages.column("host").to_numpy() ^ np.where(pages.column("article").to_numpy(), _ARTICLE, 0)
        return blocks, Stream([[b.split(" ") for b in r] for r in blocks], host, bits)

    def message(to: list, about: list, codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.Table:
        counts = [pa.compress(np.minimum(n, min_pages).astype("<i4").tobytes(), codec="zstd", asbytes=True) for n in counts]
        cols = [pa.array(to, pa.int32()), pa.array(about, pa.int64()), pa.array([len(c) for c in codes], pa.int32()), pa.array(list(map(pack, codes)), pa.binary()), pa.array(counts, pa.binary())]
        return pa.table(cols, names=["part", "piece", "n", "codes", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece's distinct windows and their pages, cut by ranges of codes."""
        for batch in batches:
            for k in range(batch.num_rows):
                code, n = stream_of(thaw(batch.column(1).slice(k, 1)))[1].counts(min_words)
                part = ((code >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                used, at = np.unique(part, return_index=True)
                cuts = [slice(a, b) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(code)], strict=False)]
                yield from message(used.tolist(), [batch.column(0)[k].as_py()] * len(used), [code[c] for c in cuts], [n[c] for c in cuts]).to_batches()

    def total(sent: pa.Table) -> pa.Table:
        """Which windows of each piece enough pages of all pieces have."""
        rows = sent.to_pylist()
        codes = [unpack(r["codes"], r["n"]) for r in rows]
        counts = [np.frombuffer(pa.decompress(r["counts"], 4 * r["n"], codec="zstd", asbytes=True), "<i4") for r in rows]
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        begin = np.flatnonzero(np.diff(every[order], prepend=every[order[0]] + np.uint64(1)))
        many = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), begin) >= min_pages
        shared = np.empty(len(every), bool)
        shared[order] = np.repeat(many, np.diff(begin, append=len(every)))
        back, at = [], 0
        for c in codes:
            back.append(c[shared[at : at + len(c)]])
            at += len(c)
        some = [(r, c) for r, c in zip(rows, back, strict=True) if len(c)]
        return message([r["part"] for r, _ in some], [r["piece"] for r, _ in some], [c for _, c in some], [np.zeros(0)] * len(some))

    def finish(packs: pa.Table, back: pa.Table) -> pa.Table:
        pages = thaw(packs.column("pages"))  # a piece with windows has pages
        blocks, stream = stream_of(pages)
        shared = np.concatenate([np.zeros(0, np.uint64), *[unpack(r["codes"], r["n"]) for r in back.to_pylist()]])
        shares = stream.shares(shared, min_words)
        texts = [text_of(a, r, sh) for a, r, sh in zip(pages.column("article").to_pylist(), blocks, shares, strict=True)]
        counts = [map(len, texts), map(len, blocks), (sum(x > MOST for x in sh) for sh in shares)]
        return pa.table([pages.column("id"), pages.column("url"), pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["id", "url", "text", "n_chars", "n_blocks", "n_shared"])

    packs = materialize(src.mapInArrow(parse, "piece long, pages binary"))
    back = materialize(packs.mapInArrow(send, MESSAGE).groupBy("part").applyInArrow(total, MESSAGE))
    out = f"id {kind}, url string, text string, n_chars long, n_blocks long, n_shared long"
    return packs.groupBy("piece").cogroup(back.groupBy("piece")).applyInArrow(finish, out).withColumnRenamed("id", id_col)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    return judge_pages(df, id_col, url_col, html_col, min_words, min_pages).drop("n_blocks", "n_shared")
