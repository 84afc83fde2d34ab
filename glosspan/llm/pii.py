"""Personal data by bootstrapped contextual extraction.

Base patterns find seed entities (mail, address, card, phone); keys with a public prefix and long mixed hexadecimal
strings, which only machines write, are seeds too.  The word before a token with the marks that bind it, and the marks
and word after it, are lexical patterns; Spark builds the bipartite graph of patterns and instances and scores it
iteratively: a pattern is as good as the mean of the instances it extracts, an instance that is no seed as good as the
best trusted pattern that extracts it.  Rounds go on until no new pattern is trusted.  There is no list of telling words:
a pattern gets trust from seeds alone, at once or over instances it shares with trusted patterns.  Trusted patterns
discover identifiers no base pattern knows.  Base spans always stay; discovered spans that overlap none are added.

Defined cases: null text is empty; spans are code-point offsets into the whole text, end exclusive; texts of any
length are read whole and in linear time; copies and repeated rows count once per distinct text as evidence, so a
mirrored page cannot promote a pattern; equal scores do not matter, since bounds and not ranks decide; an empty table
gives no rows; other columns, whatever their names, are not read, and those that ``redact`` carries stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, release, slices, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
#: Seeds beside the base kinds: access keys whose public prefix gives them away, and long hexadecimal strings.
_KEYS = re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}(?![A-Za-z0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _ips(text: str) -> Iterator[Span]:
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            n = sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield "ip", at, at + n
            at += n + 1


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by kind as listed, then by start: leftmost, non-overlapping, failures dropped."""
    out = list(_emails(text))
    if _ANY_DIGIT.search(text):
        out += _ips(text)
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


# == candidate instances and their lexical contexts

_TOKEN_TAIL = re.compile(r"[A-Za-z0-9_%+@./:-]+")
_LEFT = re.compile(r"(?:([^\W\d_]+)[^\S\n]*)?([=:#\"'(<\[ \t]*)\Z")
_RIGHT = re.compile(r"([\"')>\]]*[ \t]*[=:#(\[]+[ \t]*)([^\W\d_]+)")
_SIDE_CHARS = 48


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with at least six characters and two digits, without closing marks; a lone long number counts."""
    if not _ANY_DIGIT.search(text):
        return
    done = 0
    for d in _ANY_DIGIT.finditer(text):
        if d.start() < done:
            continue
        lo = d.start()
        while lo > done and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "_%+@./-")):
            lo -= 1
        m = _TOKEN_TAIL.match(text, d.start())
        done = hi = m.end()
        while hi > lo and text[hi - 1] in ".:/-":
            hi -= 1
        token = text[lo:hi]
        if len(token) >= 6 and sum(c in "0123456789" for c in token) >= 2:
            yield lo, hi


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a token: ``<`` its last word and marks before, ``>`` marks and next word after.

    Only a word that marks bind to the token (``=``, ``:`` or ``#``; after it an opening bracket too) makes one: a bare
    word such as an article stands beside seeds by chance.
    """
    out = []
    m = _LEFT.search(text[max(0, start - _SIDE_CHARS):start])
    if m and m[1] is not None:
        marks = "".join(dict.fromkeys("".join(m[2].split())))
        if not _BINDING.isdisjoint(marks):
            out.append(f"<{m[1].lower()}{marks}")
    m = _RIGHT.match(text[end:end + _SIDE_CHARS])
    if m:
        out.append(f">{''.join(m[1].split())}{m[2].lower()}")
    return out


_BINDING = frozenset("=:#")


def seed_spans(text: str) -> list[tuple[int, int]]:
    return [(a, b) for _, a, b in base_spans(text)] + [m.span() for rx in (_KEYS, _HEX) for m in rx.finditer(text)]


def occurrences(docs: DataFrame) -> DataFrame:
    """(pattern, instance, seed) per distinct text, pattern and instance; ``seed`` if it is a seed as it stands."""
    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            rows = set()
            for text in part.column("text").to_pylist():
                known = None
                for lo, hi in candidates(text):
                    own = patterns_at(text, lo, hi)
                    if own:
                        if known is None:
                            known = seed_spans(text)
                        seed = any(a < hi and lo < b for a, b in known)
                        digest = hashlib.blake2b(text[lo:hi].encode("utf-8", "surrogatepass"), digest_size=8).digest()
                        rows |= {(pattern, int.from_bytes(digest, "little", signed=True), seed) for pattern in own}
            rows = sorted(rows)
            yield pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())],
                           names=["pattern", "instance", "seed"])

    found = map_batches(docs.select(F.coalesce("text", F.lit("")).alias("text")), run, "pattern string, instance long, seed boolean")
    return found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def score_patterns(edges: DataFrame, rounds: int = 10, support: int = 5, confidence: float = 0.6) -> DataFrame:
    """(pattern, n, seeds, pattern_score, round): patterns with ``support`` distinct instances whose score reaches
    ``confidence``, with the round that trusted them; rounds end, at ``rounds`` at the latest, when one trusts no more.

    An instance that is a seed under one pattern is one under all.  Scores only grow from round to round.
    """
    known = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    frequent = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    graph = materialise(edges.select("pattern", "instance").join(frequent.select("pattern"), "pattern", "left_semi").join(known, "instance"), "pii-graph")
    trusted = None
    for k in range(1, rounds + 1):
        scored = graph.withColumn("score", F.col("seed").cast("double"))
        if trusted is not None:
            best = graph.join(trusted.select("pattern", "pattern_score"), "pattern").groupBy("instance").agg(F.max("pattern_score").alias("best"))
            scored = graph.join(best, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))))
        now = scored.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("seed").alias("seeds"), F.avg("score").alias("pattern_score")).where(F.col("pattern_score") >= confidence)
        before = 0 if trusted is None else trusted.count()
        now = now.withColumn("round", F.lit(k)) if trusted is None else now.join(trusted.select("pattern", "round"), "pattern", "left").withColumn("round", F.coalesce("round", F.lit(k)))
        previous, trusted = trusted, materialise(now, "pii-trusted")
        release(*[previous] if previous is not None else [])
        if trusted.count() == before:
            break
    release(graph)
    return trusted


#: The driver holds at most this many learned patterns; more stay in a table that is joined instead.
MAX_DRIVER_PATTERNS = 20_000


def learn_patterns(docs: DataFrame, **bounds) -> DataFrame:
    edges = materialise(occurrences(docs), "pii-occurrences")
    trusted = score_patterns(edges, **bounds)
    release(edges)
    return trusted


def discovered(text: str, base: list[Span], patterns) -> list[Span]:
    """Access keys, and identifiers that a learned pattern introduces, that touch no base span."""
    keys = [("secret", *m.span()) for m in _KEYS.finditer(text)]
    out = [k for k in keys if not any(a < k[2] and k[1] < b for _, a, b in base)]
    known = base + out
    for lo, hi in candidates(text) if patterns else ():
        if any(p in patterns for p in patterns_at(text, lo, hi)) and not any(a < hi and lo < b for _, a, b in known):
            out.append(("context", lo, hi))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _pattern_set(learned: DataFrame) -> set[str] | None:
    rows = learned.select("pattern").limit(MAX_DRIVER_PATTERNS + 1).collect()
    return {r.pattern for r in rows} if len(rows) <= MAX_DRIVER_PATTERNS else None


def find(docs: DataFrame, learned: DataFrame, keep: list[str], emit) -> DataFrame:
    """Apply ``emit(text, base, extra) -> dict`` to every text; ``emit.schema`` names its columns."""
    patterns = _pattern_set(learned)
    extra_names = [f.split()[0] for f in emit.schema.split(", ")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_text"))
    if patterns is None:
        source, keep_all = _with_local_patterns(source, learned, keep), True
    else:
        keep_all = False
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(patterns or ()))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), emit.schema])
    from pyspark.sql.types import _parse_datatype_string

    arrow = _arrow_schema(_parse_datatype_string(schema))

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "_text"):
            local = part.column("_patterns").to_pylist() if keep_all else None
            rows = []
            for i, text in enumerate(part.column("_text").to_pylist()):
                base = base_spans(text)
                rows.append(emit(text, base, discovered(text, base, set(local[i] or ()) if keep_all else shared.value)))
            columns = [part.column(c) for c in keep] + [pa.array([r[n] for r in rows], arrow.field(n).type) for n in extra_names]
            yield pa.table(columns, names=[*keep, *extra_names])

    return map_batches(source, run, schema)


def _arrow_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def _with_local_patterns(source: DataFrame, learned: DataFrame, keep: list[str]) -> DataFrame:
    """Attach to each row the learned patterns its own text holds, for pattern sets too large to broadcast."""
    def run(batch: pa.RecordBatch):
        for part in slices(batch, "_text"):
            own = [sorted({p for span in candidates(t) for p in patterns_at(t, *span)}) for t in part.column("_text").to_pylist()]
            yield pa.table([*part.columns, pa.array(own, pa.list_(pa.string()))], names=[*part.schema.names, "_own"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    tagged = map_batches(source, run, fields + ", _own array<string>").withColumn("_row", F.monotonically_increasing_id())
    tagged = materialise(tagged, "pii-tagged")
    hits = (tagged.select("_row", F.explode("_own").alias("pattern")).join(learned.select("pattern"), "pattern")
            .groupBy("_row").agg(F.collect_set("pattern").alias("_patterns")))
    return tagged.join(hits, "_row", "left").drop("_row", "_own")


def _digest(text: str, base: list[Span], extra: list[Span]) -> dict:
    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return dict(zip(("n_email", "n_ip", "n_card", "n_phone"), counts)) | {
        "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(base + extra)}


_digest.schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def op9_pii_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered spans of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, learn_patterns(docs), ["doc_id"], _digest)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked and ``n_chars``, where it is a column, brought up to date."""
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]

    def emit(text: str, base: list[Span], extra: list[Span]) -> dict:
        spans = base + extra
        return {"_masked": mask(text, spans) if spans else text}

    emit.schema = "_masked string"
    carried = docs.withColumn("_null", F.col("text").isNull())
    out = find(carried, learn_patterns(docs), [*keep, "_null"], emit).withColumn("text", F.when(~F.col("_null"), F.col("_masked")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
