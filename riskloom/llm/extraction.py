"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.toxicity import Chains, forward_backward

FEATURE_BITS = 16
ROUNDS, RATE, PENALTY = 80, 0.5, 1e-3
# these elements hold text, no tags, up to their end tag or the end of the page; it is never content
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title")}
# what stands in these elements is not content either; one that is never closed hides nothing
HIDDEN = {"template", "noscript", "iframe", "svg", "select", "object"}
# all else ends an open head
HEAD = {"head", "base", "basefont", "bgsound", "link", "meta", *RAW, "noscript", "template"} - {"textarea"}
# these tags end an open svg, unless it has an element open that holds HTML
LEAVES_SVG = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul video button label legend".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends the open element of these kinds, unless one of the fences lies between
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
ENDS = {tag: (kinds, fences | HIDDEN) for tag, (kinds, fences) in ENDS.items()}
NO_PARAGRAPH = BLOCKS - {"button", "label", "legend", "option", "body", "html", "tbody", "td", "th", "thead", "tfoot", "tr"}
FENCES = {"button", "table", "td", "th", "article", "section", "div", "body", "li", "blockquote"} | HIDDEN
# what publishers call the parts around an article, and the article itself
MARKS = set(
    "ad ads advert advertisement sponsored promo banner sidebar aside widget menu nav navigation navbar breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay "
    "comment comments respond reply disqus discussion feedback share sharing social related recommended more popular "
    "trending newsletter subscribe subscription signup login search form toolbar pagination pager tags byline meta "
    "copyright legal disclaimer skip hidden article content main post entry story body text".split()
)
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^"'>])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A stretch of text between block-level tags: its words, the marks of its ancestors, its part inside links."""

    text: str
    tag: str
    marks: frozenset
    linked: int


class Pages:
    """Cuts pages into leaf blocks. Keeps the marks of tags that it has met."""

    def __init__(self):
        self.known: dict[tuple, frozenset] = {}

    def marks(self, above: frozenset, tag: str, attrs: str) -> frozenset:
        key = (above, tag, attrs)
        if (found := self.known.get(key)) is None:
            own = {f"<{tag}>"}
            for name, value in NAMED.findall(attrs):
                if name.lower() in ("class", "id", "role", "itemprop"):
                    own |= {f".{w}" for w in WORDS.findall(value.lower()) if w in MARKS}
            if "data-main" in attrs:
                own.add("#main")
            if len(self.known) > 20_000:
                self.known.clear()
            found = self.known[key] = above | own
        return found

    def blocks(self, html: str) -> list[Block]:
        # texts as (text, part inside links), ends of blocks as (tag, marks)
        parts: list[tuple] = []
        stack: list[tuple[str, frozenset]] = [("", frozenset())]
        count: Counter = Counter()
        # open hidden elements: their depth in the stack, and the parts before them
        hidden: list[tuple[int, int]] = []
        at, filled = 0, False

        def flush() -> None:
            nonlocal filled
            if filled:
                parts.append(next(((t, m) for t, m in reversed(stack) if t in BLOCKS), ("", stack[-1][1])))
                filled = False

        def add(value: str, linked: int) -> None:
            nonlocal filled
            parts.append((value, linked))
            filled = True

        def text(value: str) -> None:
            if value:
                value = unescape(value)
                if count["head"] and not hidden and not value.isspace():
                    close({"head"}, set())
                add(value, len(value) if count["a"] else 0)

        def close(kinds: set, fences: set, whole: bool = False) -> None:
            """Ends the innermost open element of these kinds; ``whole``: by its own end tag."""
            if not any(count[k] for k in kinds):
                return
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in kinds:
                    for tag, _ in stack[depth:]:
                        count[tag] -= 1
                    del stack[depth:]
                    while hidden and hidden[-1][0] >= depth:
                        opened, before = hidden.pop()
                        if whole and opened == depth:
                            del parts[before:]
                            add(" ", 0)
                    return
                if stack[depth][0] in fences:
                    return

        while found := TAG.search(html, at):
            text(html[at : found.start()])
            at = found.end()
            if start := found["start"]:
                tag, alone = start.lower(), found["attrs"].endswith("/")
                if count["svg"] and tag in LEAVES_SVG and not (count["foreignobject"] or count["desc"]):
                    close({"svg"}, set())
                if count["head"] and not hidden and tag not in HEAD:
                    close({"head"}, set())
                if tag in RAW and not (alone and count["svg"]):
                    last = RAW[tag].search(html, at)
                    at = last.end() if last else len(html)
                    add(" ", 0)
                    continue
                if tag in BLOCKS:
                    flush()
                    if tag in NO_PARAGRAPH:
                        close({"p"}, FENCES)
                    if tag in ENDS:
                        close(*ENDS[tag])
                elif tag == "br":
                    add(" ", 0)
                if tag not in VOID and not alone:
                    if tag in HIDDEN:
                        hidden.append((len(stack), len(parts)))
                        add(" ", 0)
                    stack.append((tag, self.marks(stack[-1][1], tag, found["attrs"])))
                    count[tag] += 1
            elif end := found["end"]:
                tag = end.lower()
                if tag in BLOCKS:
                    flush()
                close({tag}, set(), whole=True)
        text(html[at:])
        flush()
        out: list[Block] = []
        pieces: list[str] = []
        linked = 0
        for first, second in parts:
            if isinstance(second, int):
                pieces.append(first)
                linked += second
            else:
                if words := " ".join("".join(pieces).split()):
                    out.append(Block(words, first, second, linked))
                pieces.clear()
                linked = 0
        return out


def number(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << FEATURE_BITS) - 1)


class Features:
    def __init__(self):
        self.known: dict = {}

    def of(self, block: Block, place: int, count: int) -> tuple[int, ...]:
        text = block.text
        share = 4 * block.linked // max(1, len(text))
        key = (
            block.tag,
            block.marks,
            min(12, len(text).bit_length()),
            min(4, share),
            text[-1] in ".!?:;…\"»”",
            min(4, text.count(",") + text.count(". ")),
            "©" in text or "|" in text,
            place == 0,
            place == count - 1,
        )
        if (found := self.known.get(key)) is None:
            tag, marks, length, linked, stop, clauses, sign, first, last = key
            names = ["bias", f"t:{tag}", f"l:{length}", f"a:{linked}", f"s:{stop}", f"c:{clauses}", f"©:{sign}", f"f:{first}", f"e:{last}"]
            names += [f"m:{m}" for m in marks if m != "#main"] + [f"t:{tag}|l:{length}", f"t:{tag}|a:{linked}", f"l:{length}|s:{stop}|a:{linked}"]
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[key] = tuple(sorted({number(n) for n in names}))
        return found


AROUND = {f"<{t}>" for t in ("nav", "aside", "footer", "form", "dialog", "button", "menu")} | {
    f".{w}" for w in MARKS - set("article content main post entry story body text header meta".split())
}


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by the publisher's own markup: what stands in an article or main element and in none of the parts
    around it. None if the page has no such element."""
    labels = [int(bool({"<article>", "<main>"} & b.marks) and not AROUND & b.marks) for b in blocks]
    return labels if any(labels) else None


SENTENCES = (
    "The account moved funds through three banks before the review began.",
    "Investigators traced the payments, and the totals did not match the declared income of the firm.",
    "A second transfer followed within hours; nobody at the branch asked for documents.",
    "What remains is a pattern of small deposits, each below the reporting limit, made on the same day.",
    "According to the report, the counterparties shared one address and one device.",
    "None of the alerts was escalated until the quarter had ended.",
)


def labelled_pages() -> list[str]:
    """Pages of other make-ups than a single marked article; content elements carry ``data-main``."""
    long, some, brief = " ".join(SENTENCES), " ".join(SENTENCES[1:4]), SENTENCES[0]
    links = "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(("Home", "Markets", "Opinion", "Contact us")))
    talk = f'<div class="comment"><p>{brief}</p><p>Reply</p></div><div class="comment"><p>{some}</p></div>'
    story = f"<p data-main>{long}</p><p data-main>{brief}</p><ul><li data-main>{brief}</li><li data-main>{SENTENCES[4]}</li></ul><h2 data-main>Findings</h2><blockquote data-main>{some}</blockquote><p data-main>{some}</p>"
    cookie = '<div class="cookie-notice"><p>We use cookies to improve this site. By going on you agree.</p><button>Accept</button></div>'
    form = '<form class="newsletter"><label>Your address</label><input><p>Subscribe to our newsletter for weekly news.</p><button>Subscribe</button></form>'
    foot = "<footer><p>&copy; 2024 Example. All rights reserved.</p><a href='/terms'>Terms</a></footer>"
    related = f'<div class="related"><h3>Related</h3><ul>{links}</ul></div>'
    ad = f'<div class="ad">{brief}</div>'
    return [
        f'{cookie}<header class="site-header"><h1>Example News</h1><nav><ul>{links}</ul></nav></header><main><h1 data-main>Funds moved through three banks</h1>{story}</main><aside class="sidebar"><h3>Popular</h3><p>{some}</p></aside>{foot}',
        f'<div id="menu"><ul>{links}</ul></div><div id="content"><h2 data-main>Small deposits</h2>{story}{ad}<p data-main>{some}</p></div><div id="sidebar"><p>{brief}</p>{form}</div><div id="footer">Copyright Example</div>',
        f'<nav>{links}</nav><article><header><h1 data-main>Review began late</h1><p class="byline">By a reporter</p></header>{story}{form}<section class="comments"><h3>Comments</h3>{talk}</section></article>{foot}',
        f'<div class="banner">{brief}</div><div class="post"><h1 data-main>A pattern</h1><div data-main>{long}</div><p data-main>{some}</p></div><div id="comments">{talk}</div>{related}{foot}',
        f'<article><h1 data-main>One address</h1>{story}<aside><p>{brief}</p></aside>{related}</article><article class="comment"><p>{some}</p></article><article class="comment"><p>{long}</p></article><div class="popup"><p>{brief}</p></div>',
        f'<div class="notice"><p>{brief}</p></div><table><tr><td><ul>{links}</ul></td><td><h1 data-main>The quarter</h1>{story}</td></tr></table><div class="share"><a href="/s">Share this</a></div>{foot}',
        f'<nav><ul>{links}</ul></nav>{ad}<article><h1 data-main>Short notes</h1><p data-main>First note here<p data-main>{brief}</p><p data-main>A last note, too.</p></article>{foot}',
        f'<div class="alert">{some}</div><main><p data-main>{brief}</p><p data-main>{long}</p><form><p>{brief}</p><label>Name</label></form><p data-main>{some}</p></main><div class="promo"><p>{some}</p></div>{foot}',
    ]


class Extractor:
    def __init__(self):
        self.weight = np.zeros(1 << FEATURE_BITS)
        self.move = np.zeros((2, 2))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weight=self.weight, move=self.move)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> "Extractor":
        found = cls()
        with np.load(io.BytesIO(data)) as arrays:
            found.weight, found.move = arrays["weight"], arrays["move"]
        return found

    def viterbi(self, rows: list[tuple[int, ...]]) -> list[int]:
        """The likeliest states; ties go to content."""
        weight, move = self.weight, self.move.tolist()
        best, back = (0.0, 0.0), []
        for number, row in enumerate(rows):
            emission = float(weight[list(row)].sum())
            if not number:
                best = (0.0, emission)
                continue
            zero = (best[0] + move[0][0], best[1] + move[1][0])
            one = (best[0] + move[0][1], best[1] + move[1][1])
            back.append((int(zero[1] >= zero[0]), int(one[1] >= one[0])))
            best = (max(zero), max(one) + emission)
        state = int(best[1] >= best[0])
        states = [state]
        for choice in reversed(back):
            state = choice[state]
            states.append(state)
        return states[::-1] if rows else []


def fitted(pages: list[str]) -> Extractor:
    """Maximum likelihood over labelled chains: each given page that its publisher marked, once with and once
    without the marking elements, and the labelled pages."""
    cutter, features = Pages(), Features()
    chains: list[tuple[list[tuple[int, ...]], list[int]]] = []
    for html in pages:
        blocks = cutter.blocks(html)
        if (labels := marked_labels(blocks)) is not None:
            for hidden in (frozenset(), frozenset({"<article>", "<main>", ".article", ".content", ".main", ".post"})):
                seen = [Block(b.text, b.tag if f"<{b.tag}>" not in hidden else "div", b.marks - hidden, b.linked) for b in blocks]
                chains.append(([features.of(b, i, len(seen)) for i, b in enumerate(seen)], labels))
    for html in labelled_pages() * max(1, len(chains) // 40):
        blocks = cutter.blocks(html)
        chains.append(([features.of(b, i, len(blocks)) for i, b in enumerate(blocks)], [int("#main" in b.marks) for b in blocks]))
    found = Extractor()
    first = np.r_[0, np.cumsum([len(rows) for rows, _ in chains])]
    flat = np.array([f for rows, _ in chains for row in rows for f in row])
    owner = np.repeat(np.arange(first[-1]), [len(row) for rows, _ in chains for row in rows])
    target = np.array([x for _, labels in chains for x in labels], float)
    seen = np.zeros((2, 2))
    for _, labels in chains:
        np.add.at(seen, (labels[:-1], labels[1:]), 1)
    blocks = Chains(first).blocks
    squares = [np.zeros(1 << FEATURE_BITS), np.zeros((2, 2))]
    for _ in range(ROUNDS):
        odds = np.exp(np.clip(np.bincount(owner, weights=found.weight[flat], minlength=first[-1]), -30, 30))
        move, moves, marginal = np.exp(found.move), np.zeros((2, 2)), np.zeros(first[-1])
        for places, inside in blocks:
            here = np.where(inside, odds[places], 1.0)
            ahead, behind, both = forward_backward(here, inside, move)
            marginal[places[inside]] = (both / (1 + both))[inside]
            if len(here) > 1:
                before, after = ahead[:-1], here[1:] * behind[1:]
                joint = np.stack([np.full_like(before, move[0, 0]), move[0, 1] * after, before * move[1, 0], before * move[1, 1] * after])
                moves += (joint / joint.sum(axis=0))[:, inside[1:]].sum(axis=1).reshape(2, 2)
        slopes = [np.bincount(flat, weights=(target - marginal)[owner], minlength=1 << FEATURE_BITS) - PENALTY * found.weight, seen - moves]
        for value, gradient, square in zip((found.weight, found.move), slopes, squares):
            square += gradient**2
            value += RATE * gradient / (np.sqrt(square) + 1e-8)
        found.move -= found.move[0, 0]
    return found


def train_extractor(pages: DataFrame, *, key: str = "page_id", html: str = "html", sample: int = 400) -> bytes:
    """Fits the field on the labelled pages of this module and on at most ``sample`` pages (those with the smallest
    digests of their keys) whose publishers mark the article; without such pages, on the labelled ones alone."""
    slim = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("_key")).distinct()
    digest = F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("null")))
    chosen = slim.where("_key IS NOT NULL").orderBy(digest, "_key").limit(sample)
    rows = pages.select(F.col(key).alias("_key"), F.col(html).cast("string").alias("html")).join(F.broadcast(chosen), "_key")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [fitted(sorted(h for h in group["html"] if h is not None)).packed()]})

    models = rows.select("html", F.lit(1).alias("_all")).groupBy("_all").applyInPandas(fit, "model binary").collect()
    return bytes(models[0]["model"]) if models else fitted([]).packed()


def extract_main_text(pages: DataFrame, model: bytes, *, html: str = "html") -> DataFrame:
    """All input columns plus ``text`` (the content blocks in page order, one per line) and ``n_chars``.

    The project has no web pages: this works on any table with a column of HTML. References are decoded, white
    space inside a block becomes one blank; nothing else is dropped or cut. NULL and empty pages, and pages
    without content, give an empty text; broken markup is read as far as it goes: an open head ends at the first
    text or tag that belongs to the body, a template, noscript, iframe, svg, select or object without its end tag
    hides nothing. Repeated rows are repeated; input columns named text or n_chars are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars")])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, features, field = Pages(), Features(), Extractor.unpacked(shared.value)
        for batch in batches:
            texts = []
            for page in batch.column(html).to_pylist():
                blocks = cutter.blocks(page or "")
                states = field.viterbi([features.of(b, i, len(blocks)) for i, b in enumerate(blocks)])
                texts.append("\n".join(b.text for b, s in zip(blocks, states) if s))
            columns = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "text", "n_chars"])

    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(extract, f"{schema}, text string, n_chars bigint")
