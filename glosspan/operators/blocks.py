"""Blocks, admonitions, sentences and words of one document: the state machine behind the relational tables."""

from __future__ import annotations

import bisect
import itertools
import re
from dataclasses import dataclass

from ..functions import vocab
from .regions import CONTENT, MARKERS, MASK, mask, protected_regions

_REGISTER = {"danger": "danger", "warning": "warning", "caution": "caution", "attention": "caution", "important": "caution",
             "note": "note", "tip": "note", "hint": "note", "info": "note"}
_COLLAPSE = r"(?:!!!|\?\?\?\+?)"  # fixed and folding admonitions
_OPENERS = (
    re.compile(r"^\s*>?\s*\[!(\w+)\]"), re.compile(rf"^\s*{_COLLAPSE}\s+(\w+)"), re.compile(r"^\s*:{3,}\s*\{?\s*(\w+)\}?"),
    re.compile(r"^\s*\.\.\s+(?:admonition::\s+)?(\w+)(?:::)?"), re.compile(r"^\s*\[(\w+)\]\s*$"), re.compile(r"^\s*\**(\w+)\**\s*[:!]"),
    re.compile(r"^\s*(DANGER|WARNING|CAUTION|NOTE)\b"))
_BARE = re.compile(r"^\s*(?:>?\s*\[!\w+\]|" + _COLLAPSE + r"\s+\w+(?:\s+\"[^\"]*\")?|:{3,}\s*\{?\w*\}?.*|\.\.\s+(?:admonition::\s+)?\w+(?:::)?|\[\w+\]|\**\w+\**\s*[:!]|DANGER|WARNING|CAUTION|NOTE)\s*$")


_ANY_REGISTER = re.compile("|".join(_REGISTER), re.I)


def detect_admonition(line: str) -> str:
    """The register an opener line announces, or none; the first form that matches wins."""
    if not _ANY_REGISTER.search(line):
        return "none"
    for rx in _OPENERS:
        m = rx.match(line)
        if m:
            register = _REGISTER.get(m[1].lower())
            if register:
                return register
    return "none"


_LABEL = re.compile(r"^\s*\**\w+\**\s*[:!]")


def is_bare_opener(line: str) -> bool:
    return bool(_BARE.match(line)) and detect_admonition(line) != "none"


def is_label_line(line: str) -> bool:
    return bool(_LABEL.match(line)) and detect_admonition(line) != "none"


# == openers

_LEAD = re.compile(r"^[\s>*_~#\"'(\[•–—-]*(?:\d+[.)]\s+|[a-zA-Z][.)]\s+)?")
_VERBS = frozenset(vocab.words("opener_verbs"))
_FUNCTION = frozenset(vocab.words("function_words"))


_ORDERS = re.compile(r"(?i)(?:do not|don['’]t|never|always)\b")
_LETTERS = re.compile(r"[A-Za-z]+")


def opens_imperative(text: str, extra: frozenset[str] = frozenset()) -> bool:
    """Whether a sentence starts like an instruction, by lexicon: a listed base verb, or do not / never / always."""
    t = text[_LEAD.match(text).end():]
    if _ORDERS.match(t):
        return True
    m = _LETTERS.match(t)
    if not m:
        return False
    word = m[0].lower()
    after = t[m.end():m.end() + 1]
    if after == ":" or after == MASK:
        return False
    if word in ("list", "vacuum") and word not in extra:
        return False
    return word in _VERBS or word in extra


# == units


@dataclass
class Block:
    kind: str
    start: int
    end: int
    admonition: str = "none"
    depth: int = 0
    in_list: bool = False
    ordinal: int | None = None
    mode: str = "descriptive"
    id: str = ""
    sentences: int = 0


_LIST = re.compile(r"^([ \t]*)([-+*]|(\d{1,9})[.)])([ \t]+)")
_QUOTE = re.compile(r"^[ \t]*>")
_FENCE_END = re.compile(r"^\s*:{3,}\s*$")
_FENCE_START = re.compile(r"^\s*:{3,}")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+|$)")
_UNDERLINE = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_SHOUTED = re.compile(r"^\s*(?:DANGER|WARNING|CAUTION|NOTE)\b")
_SEEN = re.compile(rf"[^\s{MASK}]")
#: A line of three or more of one mark, spaced or not.
_RULE = re.compile(r"^ {0,3}(?:-[ \t]*){3,}$|^ {0,3}(?:\*[ \t]*){3,}$|^ {0,3}(?:_[ \t]*){3,}$")


def split_cells(line: str) -> list[tuple[int, int]]:
    """Ranges between unescaped pipes."""
    bars = [m.end() - 1 for m in re.finditer(r"(?<!\\)(?:\\\\)*\|", line)]
    edges = [-1, *bars, len(line)]
    return [(a + 1, b) for a, b in zip(edges, edges[1:]) if line[a + 1:b].strip()]


def text_blocks(raw: str) -> list[Block]:
    """Paragraphs between blank lines."""
    out = []
    for m in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|\Z))+", raw):
        a, b = _trim(raw, m.start(), m.end())
        if b > a:
            out.append(Block("paragraph", a, b, admonition=detect_admonition(raw[a:b].split("\n", 1)[0])))
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def markdown_blocks(raw: str, masked: str, regions: list[tuple[str, int, int]]) -> list[Block]:
    """Headings, paragraphs, list items, quotes and table cells with their admonition and list position.

    One-shot openers (a label, a bare capital word) reach the rest of their own block; container openers (quoted,
    ``!!!``, ``:::`` and directive forms) reach until their container ends.
    """
    opaque = [False] * (raw.count("\n") + 2)
    starts, at = [], 0
    for line in raw.split("\n"):
        starts.append(at)
        at += len(line) + 1
    block_kinds = {"front-matter", "fenced-code", "indented-code", "comment", "html-block", "reference-definition"}
    for kind, a, b in regions:
        if kind in block_kinds:
            for i in range(bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, b)):
                lo, hi = starts[i], starts[i] + len(raw[starts[i]:].split("\n", 1)[0]) if i + 1 == len(starts) else starts[i + 1] - 1
                if a <= lo + (len(raw[lo:hi]) - len(raw[lo:hi].lstrip())) and b >= len(raw[lo:hi].rstrip()) + lo:
                    opaque[i] = True
    tables = {bisect.bisect_right(starts, a) - 1 for kind, a, b in regions if kind == "table-markup"}
    out: list[Block] = []
    current: Block | None = None
    container = ("none", "")  # register, what ends it
    once = "none"

    def close():
        nonlocal current, once
        if current is not None:
            current.start, current.end = _trim(raw, current.start, current.end)
            if _SEEN.search(masked, current.start, current.end) or raw[current.start:current.end].strip(" >-*+#|\n\t") and current.end > current.start:
                out.append(current)
        current = None

    for i, a in enumerate(starts):
        line = raw[a:starts[i + 1] - 1 if i + 1 < len(starts) else len(raw)]
        b = a + len(line)
        if opaque[i] or not line.strip():
            close()
            if not line.strip() and container[1] in ("quote",):
                container = ("none", "")
            once = "none" if not line.strip() else once
            continue
        quote = _QUOTE.match(line)
        if container[1] == "quote" and not quote or container[1] == "indent" and not line.startswith(("    ", "\t")) or container[1] == "fence" and _FENCE_END.match(line):
            close()
            ended_fence = container[1] == "fence"
            container = ("none", "")
            if ended_fence:
                continue
        if i in tables:
            close()
            if not re.fullmatch(r"[ \t|:\-\r]*", line):
                for lo, hi in split_cells(line):
                    c, d = _trim(raw, a + lo, a + hi)
                    if d > c:
                        out.append(Block("table-cell", c, d, admonition=container[0]))
            continue
        if _RULE.match(line):
            close()
            continue
        body = line[quote.end():] if quote else line
        shift = a + (len(line) - len(body))
        if is_bare_opener(line) or (quote and is_bare_opener(body)):
            register = detect_admonition(line if not quote else ">" + body)
            close()
            if quote:
                container = (register, "quote")
            elif line.lstrip().startswith(("!" * 3, "?" * 3, "..")):
                container = (register, "indent")
            elif _FENCE_START.match(line):
                container = (register, "fence")
            else:
                once = register
            continue
        h = _HEADING.match(body)
        if h:
            close()
            block = Block("heading", shift + h.end(), b)
            block.start, block.end = _trim(raw, block.start, block.end)
            if block.end > block.start:
                out.append(block)
            continue
        if current is not None and current.kind == "paragraph" and _UNDERLINE.match(body):
            current.kind = "heading"
            close()
            continue
        item = _LIST.match(body)
        if item:
            close()
            current = Block("list-item", shift + item.end(), b, container[0] if container[0] != "none" else once, len(item[1].expandtabs(4)) // 2, True,
                            int(item[3]) if item[3] else None)
        elif current is None:
            lead = detect_admonition(body) if is_label_line(body) or _SHOUTED.match(body) else "none"
            register = container[0] if container[0] != "none" else (lead if lead != "none" else once)
            current = Block("block-quote" if quote else "paragraph", shift, b, register)
        else:
            current.end = b
    close()
    for k, block in enumerate(out):
        block.id = f"b{k + 1}"
    return out


# == sentences and words

_ABBREVIATIONS = frozenset(a.lower() for a in vocab.words("splitter_abbreviations"))
_STOP = re.compile(r"(?:[.!?]+|…)[\"'”’)\]]*(?=\s|$)")
_WORD = re.compile(r"[^\W_](?:[^\W_]|['’](?=[^\W_])|[-.](?=[^\W_]))*")


_INITIALS = re.compile(r"[a-z]\.(?:[a-z]\.)*")
_LETTERED = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]")
_NOT_SPACE = re.compile(r"\S")


def _last_word(text: str, a: int, b: int) -> str:
    """What follows the last white space of a range, not counting a line end at its end."""
    if b > a and text[b - 1] == "\n":
        b -= 1
    at = b
    while at > a and not text[at - 1].isspace():
        at -= 1
    return text[at:b]


def sentence_ranges(masked: str, start: int, end: int) -> list[tuple[int, int]]:
    """Sentences of a block: at closing marks before white space, unless an abbreviation or initial ends there."""
    text, out, at = masked[start:end], [], 0
    for m in _STOP.finditer(text):
        if m[0].startswith(".") and len(m[0].rstrip("\"'”’)]")) == 1:
            word = _last_word(text, at, m.start()).lstrip("(\"'[").lower() + "."
            if word in _ABBREVIATIONS or _INITIALS.fullmatch(word):
                continue
            nxt = _NOT_SPACE.search(text, m.end())
            if nxt and nxt[0].islower():
                continue
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    ranges = []
    for a, b in out:
        a, b = _trim(masked, start + a, start + b)
        if _SEEN.search(masked, a, b):
            ranges.append((a, b))
    return ranges


def words_of(raw: str, masked: str, start: int, end: int, content: list[tuple[str, int, int]]) -> list[tuple]:
    """(start, end, text, lower, kind) of the words of a sentence; each content-bearing region is one word of its own kind."""
    out = []
    for m in _WORD.finditer(masked[start:end]):
        a, b = m.span()
        a, b = start + a, start + b
        if masked[b:b + 1] == "." and "." in m[0] and _LETTERED.fullmatch(m[0]):
            b += 1
        text = raw[a:b]
        out.append((a, b, text, text.lower(), None))
    if content:
        for kind, a, b in content:
            if a < end and start < b:
                a, b = max(a, start), min(b, end)
                out.append((a, b, raw[a:b], raw[a:b].lower(), kind))
        out.sort(key=lambda w: w[:2])
    return out


#: What one pass can tell of a document; ``words`` are those of the sentences.
PARTS = ("masked", "regions", "blocks", "sentences", "words")


def read(text: str, fmt: str, options: dict, parts=PARTS) -> tuple[str, list, list, list]:
    """(masked, regions, blocks, sentences) of one document in tuples, as far as ``parts`` asks for them; every offset
    indexes the given text.

    Regions are (kind, start, end), sentences (id, block, start, end, masked, opens, words).
    """
    raw = re.sub("\r(?=\n)", " ", text) if "\r" in text else text
    regions = protected_regions(raw, fmt, options)
    masked = mask(raw, [(a, b) for _, a, b in regions])
    if not {"blocks", "sentences", "words"} & set(parts):
        return masked, regions, [], []
    extra = frozenset(v.lower() for v in options.get("imperative_verbs", ()))
    blocks = markdown_blocks(raw, masked, regions) if fmt == "markdown" else text_blocks(raw)
    for k, block in enumerate(blocks):
        block.id = f"b{k + 1}"
        if block.kind != "heading" and opens_imperative(masked[block.start:block.end], extra):
            block.mode = "procedural"
    sentences = []
    content = [r for r in regions if r[0] in CONTENT]
    whole = "sentences" in parts or "words" in parts  # else they are only counted
    starts, reach = [r[1] for r in content], list(itertools.accumulate((r[2] for r in content), max))  # both grow, so the regions of a sentence are a slice
    for block in blocks:
        ranges = sentence_ranges(masked, block.start, block.end)
        block.sentences = len(ranges)
        for a, b in ranges if whole else ():
            own = content[bisect.bisect_right(reach, a):bisect.bisect_left(starts, b)] if content else content
            seen = masked[a:b]
            sentences.append((f"s{len(sentences) + 1}", block, a, b, seen, opens_imperative(seen, extra), words_of(text, masked, a, b, own) if "words" in parts else None))
    return masked, regions, blocks, sentences


def analyse(text: str, fmt: str, options: dict) -> dict:
    """``read`` in full, as nested dictionaries."""
    masked, regions, blocks, sentences = read(text, fmt, options)
    return {
        "masked": masked,
        "regions": [{"kind": k, "start": a, "end": b, "opaque": True, "marker": k in MARKERS} for k, a, b in regions],
        "blocks": [{"id": b.id, "kind": b.kind, "start": b.start, "end": b.end, "mode": b.mode, "admonition": b.admonition, "depth": b.depth,
                    "in_list": b.in_list, "ordinal": b.ordinal, "sentences": b.sentences} for b in blocks],
        "sentences": [{"id": i, "block_id": k.id, "kind": k.kind, "start": a, "end": b, "raw": text[a:b], "masked": seen, "mode": k.mode, "admonition": k.admonition,
                       "opens": opens, "words": [dict(zip(("start", "end", "text", "lower", "protected_kind"), w)) for w in words]} for i, k, a, b, seen, opens, words in sentences],
    }
