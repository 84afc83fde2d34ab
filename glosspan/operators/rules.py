"""The fourteen rules as DataFrame functions over the span relations.

Every rule takes the analysed relations and a configuration and returns ``(findings, candidates)``.  Each is a
filter, a higher-order expression over the words of one sentence, a broadcast join with a small dictionary, or a
window inside one document; none collects anything.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, vocab
from .analyse import Analysed

FINDING = ("doc_id", "rule_id", "category", "message", "start", "end", "evidence", "suggestions", "fix", "meta")
CANDIDATE = ("doc_id", "id", "rule_id", "evaluator_id", "start", "end", "passage", "passage_offset", "payload", "reason", "mode", "admonition")

NO_FIX = "cast(null as struct<start:int,end:int,text:string,safe:boolean>)"


@dataclass
class RuleConfig:
    """Options by rule id, over the pack's dictionaries and limits."""

    pack: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    adjudicate: bool = True

    def get(self, rule: str, name: str, default):
        return self.options.get(rule, {}).get(name, default)

    def limit(self, name: str):
        return {**vocab.LIMITS, **self.pack.get("limits", {})}[name]

    def dictionary(self, name: str) -> dict:
        return self.pack.get(name) if self.pack.get(name) is not None else vocab.lists()[name]


def finding(df: DataFrame, rule: str, message: Column, start: Column | str = "start", end: Column | str = "end", category: str = "deterministic-violation",
            evidence: Column | None = None, suggestions: Column | None = None, fix: Column | None = None, meta: Column | None = None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        "doc_id", F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), message.alias("message"), col(start).cast("int").alias("start"), col(end).cast("int").alias("end"),
        (evidence if evidence is not None else F.lit(None).cast("string")).alias("evidence"),
        (suggestions if suggestions is not None else F.array().cast("array<string>")).alias("suggestions"),
        (fix if fix is not None else F.expr(NO_FIX)).alias("fix"), (meta if meta is not None else F.expr("map()").cast("map<string,string>")).alias("meta"))


def candidate(df: DataFrame, rule: str, evaluator: str, payload: Column, reason: str, suffix: Column | None = None, start: Column | str = "start", end: Column | str = "end") -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [F.lit(rule), F.col("sentence_id")] + ([suffix.cast("string")] if suffix is not None else [])
    return df.select("doc_id", F.concat_ws(":", *parts).alias("id"), F.lit(rule).alias("rule_id"), F.lit(evaluator).alias("evaluator_id"),
                     col(start).cast("int").alias("start"), col(end).cast("int").alias("end"), F.col("masked").alias("passage"),
                     F.col("s_start").alias("passage_offset"), F.to_json(payload).alias("payload"), F.lit(reason).alias("reason"), "mode", "admonition")


def _sentences(a: Analysed) -> DataFrame:
    return (a.sentences.withColumnRenamed("id", "sentence_id").withColumn("s_start", F.col("start")).withColumn("s_end", F.col("end")))


def prose(words: Column) -> Column:
    return F.filter(words, lambda w: w["protected_kind"].isNull())


def _fix(start: Column, end: Column, text: Column, safe: Column) -> Column:
    return F.when(safe, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), F.lit(True).alias("safe")))


def _in_sentence(df: DataFrame, hits: Column) -> DataFrame:
    """One row per span of ``hits``, moved from the sentence to the document."""
    return (df.withColumn("hit", F.explode(hits)).withColumn("start", F.col("s_start") + F.col("hit.start")).withColumn("end", F.col("s_start") + F.col("hit.end"))
            .withColumn("match", F.col("hit.text")).drop("hit"))


# == sentence length (both modes)


def sentence_length(a: Analysed, config: RuleConfig, mode: str) -> DataFrame:
    rule = f"sentence-length-{mode}"
    limit = float(config.get(rule, "maxGradeLevel", config.limit(f"{mode}MaxGradeLevel")))
    floor = int(config.get(rule, "floorWords", config.limit("sentenceReadabilityFloorWords")))
    skip = [k for k, o in (("heading", "includeHeadings"), ("table-cell", "includeTableCells")) if not config.get(rule, o, False)]
    s = _sentences(a).where((F.col("mode") == mode) & (F.size("words") >= floor))
    if skip:
        s = s.where(~F.col("kind").isin(skip))
    s = s.withColumn("grade", spans.grade_level(F.col("masked"))).where(F.col("grade") > limit)
    return finding(s, rule, F.format_string(f"This sentence reads at grade %.1f; the limit is {limit:g}.", "grade"), evidence=spans.excerpt(F.col("raw")),
                   meta=F.create_map(F.lit("grade"), F.format_string("%.1f", "grade"), F.lit("words"), F.size("words").cast("string")))


# == dictionary rules


def phrase_hits(s: DataFrame, phrases: DataFrame, longest: int, leads: list[str]) -> DataFrame:
    """Occurrences of dictionary phrases in sentences by an equi join on word n-grams.

    ``phrases`` has phrase (lower case, single spaces), n (its words) and whatever else; it is broadcast, being a
    rule pack.  Only n-grams that start with the first word of a phrase are formed.
    """
    plain = lambda c: F.regexp_replace(c, "’", "'")
    words = F.transform(prose(F.col("words")), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), plain(w["lower"]).alias("lower")))
    grams = s.withColumn("pw", words).withColumn("g", F.explode(F.flatten(F.transform("pw", lambda w, i: F.when(
        w["lower"].isin(leads), F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("pw") - i)), lambda n: F.struct(
            w["start"].alias("start"), F.get("pw", i + n - 1)["end"].alias("end"), n.alias("n"),
            F.array_join(F.transform(F.slice("pw", i + 1, n), lambda x: x["lower"]), " ").alias("phrase")))).otherwise(
                F.array().cast("array<struct<start:int,end:int,n:int,phrase:string>>"))))))
    hits = (grams.drop("pw", "start", "end").select("*", "g.start", "g.end", "g.phrase").drop("g").join(F.broadcast(phrases), "phrase"))
    gap_free = F.substring(F.col("masked"), F.col("start") - F.col("s_start") + 1, F.col("end") - F.col("start"))
    return hits.where(F.lower(plain(F.regexp_replace(gap_free, r"(?U)\s+", " "))) == F.col("phrase")).withColumn("match", gap_free)


def claims(hits: DataFrame) -> DataFrame:
    """Per sentence, longer phrases first, then dictionary order, then place: hits that overlap no earlier claim.

    The hits of a sentence meet as one array, so the sentences are read once.
    """
    rest = [c for c in hits.columns if c not in ("doc_id", "sentence_id", "words")]
    key = lambda h: F.struct((-F.length(h["phrase"])).alias("l"), h["rank"].alias("r"), h["start"].alias("start"), h["end"].alias("end"))
    per = hits.groupBy("doc_id", "sentence_id").agg(F.collect_list(F.struct(*rest)).alias("all"))
    empty = F.array().cast("array<struct<l:int,r:int,start:int,end:int>>")
    kept = F.aggregate(F.sort_array(F.transform("all", key)), empty, lambda acc, x: F.when(
        F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(
            x["l"].alias("l"), x["r"].alias("r"), x["start"].alias("start"), x["end"].alias("end"))))))
    chosen = per.withColumn("kept", kept).withColumn("h", F.explode(F.filter("all", lambda h: F.exists("kept", lambda k: (k["r"] == h["rank"]) & (k["start"] == h["start"])))))
    return chosen.select("doc_id", "sentence_id", "h.*")


def _dictionary(a: Analysed, entries: dict, allow=()) -> tuple[DataFrame, int, list[str]]:
    spark = a.documents.sparkSession
    allowed = {x.lower() for x in allow}
    rows = []
    for rank, term in enumerate(sorted((t for t in entries if t.lower() not in allowed), key=lambda t: (-len(t), t))):
        use = entries[term]["use"]
        rows.append((" ".join(term.lower().split()), rank, [use] if isinstance(use, str) else list(use), bool(entries[term].get("safe")), term))
    table = spark.createDataFrame(rows, "phrase string, rank int, use array<string>, safe boolean, term string")
    return table, max((len(r[0].split()) for r in rows), default=1), sorted({r[0].split()[0] for r in rows})


def _term_findings(hits: DataFrame, rule: str, message: Column) -> DataFrame:
    use = F.get("use", F.lit(0))
    capital = spans.match_capitals(F.col("match"), F.coalesce(use, F.lit("")))
    usable = F.size("use") > 0
    return finding(hits, rule, message, evidence=spans.excerpt(F.col("raw")),
                   suggestions=F.transform("use", lambda u: spans.match_capitals(F.col("match"), u)),
                   fix=_fix(F.col("start"), F.col("end"), capital, F.col("safe") & usable), meta=F.create_map(F.lit("term"), F.col("term")))


def unapproved_vocabulary(a: Analysed, config: RuleConfig) -> tuple[DataFrame, DataFrame | None]:
    rule = "unapproved-vocabulary"
    entries = {**config.dictionary("unapproved"), **{t: {"use": u, "safe": False} for t, u in config.get(rule, "additional", {}).items()}}
    table, longest, leads = _dictionary(a, entries, config.get(rule, "allow", ()))
    hits = claims(phrase_hits(_sentences(a), table, longest, leads))
    found = _term_findings(hits, rule, F.concat(F.lit('"'), F.col("match"), F.lit('" is not an approved term.'), F.when(
        F.size("use") > 0, F.concat(F.lit(' Use "'), F.array_join("use", '" or "'), F.lit('".'))).otherwise("")))
    if not config.get(rule, "adjudicateSense", False):
        return found, None
    return found, candidate(hits, rule, "approved-word-sense", F.struct(F.col("match").alias("term")), "Dictionary term in running text.", F.col("start"))


def preferred_terminology(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "preferred-terminology"
    entries = {**config.dictionary("preferred"), **{t: {"use": u, "safe": False} for t, u in config.get(rule, "additional", {}).items()}}
    table, longest, leads = _dictionary(a, entries, config.get(rule, "allow", ()))
    hits = claims(phrase_hits(_sentences(a), table, longest, leads))
    return _term_findings(hits, rule, F.concat(F.lit('Write "'), F.get("use", F.lit(0)), F.lit('", not "'), F.col("match"), F.lit('".')))


def no_contractions(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "no-contractions"
    table, longest, leads = _dictionary(a, config.dictionary("contractions"), config.get(rule, "allow", ()))
    hits = phrase_hits(_sentences(a), table, longest, leads)
    note = F.when(~F.col("safe"), F.lit(" The short form has more than one meaning.")).otherwise("")
    return _term_findings(hits, rule, F.concat(F.lit('Write "'), F.col("match"), F.lit('" in full.'), note))


# == mechanics


_MARKS = "array<struct<start:int,end:int,name:string,n:int>>"


def punctuation_constraints(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "punctuation-constraints"
    s = _sentences(a)
    on = lambda name: config.get(rule, name, True)
    masked = F.col("masked")
    checks = [("semicolon", on("forbidSemicolon"), ";", None), ("slash", on("forbidSlash"), r"(?<=[A-Za-z])/(?=[A-Za-z])", None), ("exclamation", on("forbidExclamation"), "!", None),
              ("ellipsis", on("forbidEllipsis"), r"\.{3}|…", None), ("parenthesis", on("forbidParentheses"), r"\([^)]*\)", "procedural")]
    none = F.array().cast(_MARKS)

    def marks(found: Column, name: str, n: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(name).alias("name"), n.cast("int").alias("n")))

    hits = []
    for name, enabled, rx, mode in checks:
        if enabled:
            at = marks(spans.find_spans(masked, rx), name, F.lit(None))
            hits.append(F.when(masked.rlike(rx) & (F.lit(True) if mode is None else F.col("mode") == mode), F.slice(at, 1, 1) if mode else at).otherwise(none))
    most = int(config.get(rule, "maxCommas", 3))
    if most:
        n = F.regexp_count(masked, F.lit(","))
        hits.append(F.when(n > most, marks(F.slice(spans.find_spans(masked, ","), -1, 1), "commas", n)).otherwise(none))
    rows = s.withColumn("hit", F.explode(F.concat(*hits) if hits else none))  # all marks of a sentence at once, so that it is read once
    name, n = F.col("hit.name"), F.col("hit.n")
    message = F.when(n.isNull(), F.concat(F.lit("Do not use this mark here: "), name, F.lit("."))).otherwise(F.format_string(f"This sentence has %d commas; the limit is {most}.", n))
    meta = F.when(n.isNull(), F.create_map(F.lit("check"), name)).otherwise(F.create_map(F.lit("check"), name, F.lit("count"), n.cast("string")))
    return finding(rows, rule, message, F.col("s_start") + F.col("hit.start"), F.col("s_start") + F.col("hit.end"), evidence=spans.excerpt(F.col("raw")), meta=meta)


def no_repeated_words(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "no-repeated-words"
    allow = [w.lower() for w in config.get(rule, "allow", ("had", "that"))]
    s = _sentences(a).withColumn("pw", prose(F.col("words"))).where(F.size("pw") > 1)
    pair = F.zip_with(F.slice("pw", F.lit(1), F.size("pw") - 1), F.slice("pw", F.lit(2), F.size("pw") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    rows = s.withColumn("p", F.explode(F.filter(pair, lambda p: (p["x"]["lower"] == p["y"]["lower"]) & ~p["x"]["lower"].isin(allow))))
    gap = F.substring(F.col("masked"), F.col("p.x.end") - F.col("s_start") + 1, F.col("p.y.start") - F.col("p.x.end"))
    rows = rows.where(gap.rlike(r"^(?U)\s+$"))
    return finding(rows, rule, F.concat(F.lit('The word "'), F.col("p.y.text"), F.lit('" is repeated.')), F.col("p.y.start"), F.col("p.y.end"), evidence=spans.excerpt(F.col("raw")),
                   fix=_fix(F.col("p.x.end"), F.col("p.y.end"), F.lit(""), F.lit(True)), meta=F.create_map(F.lit("word"), F.col("p.x.lower")))


def abbreviation_introduction(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "abbreviation-introduction"
    lo, hi = int(config.get(rule, "minLength", 2)), int(config.get(rule, "maxLength", 6))
    known = [*config.get(rule, "wellKnown", vocab.words("well_known")), *config.get(rule, "additionalWellKnown", ())]
    rx = rf"(?<![A-Za-z0-9_])[A-Z]{{{lo},{hi}}}s?(?![A-Za-z0-9_])"
    rows = _in_sentence(_sentences(a).where(F.col("masked").rlike(rx)), spans.find_spans(F.col("masked"), rx))
    rows = rows.withColumn("token", F.regexp_replace("match", "s$", "")).where(~F.col("token").isin(known))
    first = Window.partitionBy("doc_id", "token").orderBy("start")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    at = F.col("start") - F.col("s_start")
    after = F.substring(F.col("masked"), at + F.length("match") + 1, F.lit(4))
    before = F.when(at > 0, F.substring(F.col("masked"), at, F.lit(1))).otherwise("")
    rows = rows.where(~after.contains("(") & (before != "("))
    return finding(rows, rule, F.concat(F.lit('"'), F.col("token"), F.lit('" is used before it is introduced.')), evidence=spans.excerpt(F.col("raw")), meta=F.create_map(F.lit("abbreviation"), F.col("token")))


def number_unit_format(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "number-unit-format"
    spacing = config.get(rule, "unitSpacing", "required")
    tight = list(config.get(rule, "noSpaceUnits", ("%", "°")))
    r = a.documents.select("doc_id", "text", F.explode("regions").alias("r")).where("r.kind = 'numeric-expression'")
    r = r.select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.expr("substring(text, r.start + 1, r.end - r.start)").alias("literal"))
    parts = r"^([-+±]?\d+(?:[.,]\d+)*)(\s*)([A-Za-zµ°%Ω][^\d\s]*)$"
    r = r.withColumn("gap", F.regexp_extract("literal", parts, 2)).withColumn("unit", F.regexp_extract("literal", parts, 3))
    exempt = F.col("unit").isin(tight) | F.substring("unit", 1, 1).isin(tight)
    hit = lambda check, text: F.struct(F.lit(check).alias("check"), F.lit(text).alias("text"))
    hits = []
    if spacing in ("required", "forbidden"):
        wrong = (F.col("gap") == "") if spacing == "required" else (F.col("gap") != "")
        word = "Put a space" if spacing == "required" else "Put no space"
        hits.append(F.when((F.col("unit") != "") & ~exempt & wrong, hit("spacing", f"{word} between the number and the unit.")))
    if config.get(rule, "forbidDecimalComma", True):
        hits.append(F.when(F.col("literal").rlike(r"(?<!\d)\d+,(?:\d{1,2}|\d{4,})(?!\d)"), hit("decimal-comma", "Use a point as the decimal mark.")))
    hits = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<check:string,text:string>>")
    return finding(r.withColumn("hit", F.explode(hits)), rule, F.col("hit.text"), evidence=F.col("literal"), meta=F.create_map(F.lit("check"), F.col("hit.check")))


# == structure


def list_items(a: Analysed) -> DataFrame:
    """List items with the number of their run of contiguous items of equal depth, the run's size, and what the rule asks of their text:
    ``terminal`` and ``capital`` (null where the item begins with protected text or has no letter)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    cut = lambda text, b: F.substring(F.col(text), b["start"] + 1, b["end"] - b["start"])

    def traits(b: Column) -> Column:
        body = cut("text", b)
        plain = ~cut("masked", b).rlike(f"^[\\s]*{spans.MASK}") & body.rlike(r"^[^\p{L}]*\p{L}")
        return F.when(b["kind"] == "list-item", F.struct(body.rlike(r"[.!?]\s*$").alias("terminal"), F.when(plain, F.regexp_extract(body, r"(\p{L})", 1).rlike(r"\p{Lu}")).alias("capital")))

    b = a.documents.select("doc_id", F.posexplode(F.transform("blocks", lambda b: F.struct(b.alias("b"), traits(b).alias("t")))).alias("pos", "x")).select("doc_id", "pos", "x.b.*", "x.t.*")
    item = F.col("kind") == "list-item"
    new = F.when(item & F.lag("kind").over(w).eqNullSafe("list-item") & (F.lag("depth").over(w) == F.col("depth")), 0).otherwise(1)
    runs = b.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(item)
    return runs.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "run")))


def list_instruction_structure(a: Analysed, config: RuleConfig) -> DataFrame:
    """Steps of too many sentences, and items unlike the most of their run; blocks are read once and shuffled without their text."""
    rule = "list-instruction-structure"
    most = int(config.get(rule, "maxSentencesPerStep", config.limit("maxSentencesPerProceduralStep")))
    group = Window.partitionBy("doc_id", "run")
    hit = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    hits = [F.when(F.col("ordinal").isNotNull() & (F.col("sentences") > most), hit("step", F.format_string(f"This step has %d sentences; the limit is {most}.", "sentences")))]
    items = list_items(a)
    for name, option, text in (("terminal", "checkTerminalPunctuation", "End the items of a list in the same way."), ("capital", "checkInitialCapital", "Start the items of a list in the same way.")):
        if config.get(rule, option, True):
            with_n, all_n = F.col(f"with_{name}"), F.col(f"all_{name}")
            items = items.withColumn(f"with_{name}", F.count_if(F.col(name)).over(group)).withColumn(f"all_{name}", F.count(name).over(group))
            prefer = with_n * 2 >= all_n  # at a tie the items without are odd
            hits.append(F.when((with_n > 0) & (with_n < all_n) & (F.col(name) != prefer), hit(name, F.lit(text))))
    rows = items.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return finding(rows, rule, F.col("hit.text"), meta=F.create_map(F.lit("check"), F.col("hit.name")))


def one_instruction_per_sentence(a: Analysed, config: RuleConfig, space=None) -> tuple[DataFrame, DataFrame]:
    """With a workspace the sentences of two verbs, of which both results are made, are written once."""
    rule = "one-instruction-per-sentence"
    joins = [c.lower() for c in config.get(rule, "conjunctions", ("and", "then", "and then", "or"))]
    verbs = vocab.words("opener_verbs") + [v.lower() for v in config.get(rule, "imperativeVerbs", ())]
    s = _sentences(a).where((F.col("mode") == "procedural") & F.col("opens")).withColumn("pw", prose(F.col("words"))).where(F.size("pw") > 1)
    verb_at = lambda k: F.when(F.get("pw", k)["lower"] == "then", F.get("pw", k + 1)).otherwise(F.get("pw", k))
    joined = F.filter(F.transform("pw", lambda w, i: F.struct(w["lower"].alias("c"), i.alias("i"), verb_at(i + 1).alias("v"))),
                      lambda x: (x["i"] > 0) & x["c"].isin(joins) & F.coalesce(x["v"]["lower"].isin(verbs), F.lit(False)))
    s = s.withColumn("second", F.get(joined, F.lit(0))["v"])
    comma = F.instr("masked", ",")
    s = s.withColumn("later", F.when(F.col("second").isNull() & (comma > 0), F.get(F.filter("pw", lambda w: (w["start"] > F.col("s_start") + comma - 1) & w["lower"].isin(verbs)), 0)))
    s = s.where("second IS NOT NULL OR later IS NOT NULL").withColumn("first", F.get("pw", F.lit(0))).drop("pw", "words")
    s = s if space is None else space.write(s, "instructions")
    found = finding(s.where("second IS NOT NULL"), rule, F.concat(F.lit('This instruction has two actions ("'), F.col("first.text"), F.lit('" and "'), F.col("second.text"), F.lit('").')),
                    evidence=spans.excerpt(F.col("raw")), meta=F.create_map(F.lit("firstVerb"), F.col("first.lower"), F.lit("secondVerb"), F.col("second.lower")))
    return found, candidate(s.where("later IS NOT NULL"), rule, "one-instruction-per-sentence", F.struct(F.array(F.col("first.text"), F.col("later.text")).alias("candidateVerbs")),
                            "A clause after a comma holds a second possible instruction.")


# == candidate rules


def tagged(tagger):
    """A part-of-speech tagger as an Arrow-batched function; any callable over one sentence and one offset will do."""
    @F.pandas_udf("string")
    def tag(masked: pd.Series, offset: pd.Series) -> pd.Series:
        return pd.Series([tagger(m, int(o)) for m, o in zip(masked, offset)], dtype=object)

    return tag


_BE = ("being", "been", "were", "gets", "was", "are", "get", "got", "is", "be")


def passive_voice(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "passive-voice-candidate"
    forms = "|".join(vocab.words("participles"))
    rx = spans.bounded(rf"(?i)(?:{'|'.join(_BE)})\s+(?:[a-z]+ly\s+)?(?:[a-z]{{3,}}ed|{forms})(?![A-Za-z0-9_])(?:\s+by(?![A-Za-z0-9_]))?")
    rows = _in_sentence(_sentences(a).where(F.col("masked").rlike(rx)), spans.find_spans(F.col("masked"), rx))
    agent = F.col("match").rlike(r"(?i)\sby$")
    tagger = config.get(rule, "tagger", None)
    if tagger is not None:  # (masked sentence, offset of the participle) -> tag, asked only for what the pattern found
        at = F.col("start") - F.col("s_start") + F.length(F.regexp_extract("match", r"(?i)^([\s\S]*?)\w+(?:\s+by)?$", 1))
        rows = rows.where(tagged(tagger)(F.col("masked"), at) == "VERB")
    if config.get(rule, "requireByAgent", False):
        rows = rows.where(agent)
    payload = F.struct(F.col("match").alias("construction"), F.lower(F.regexp_extract("match", r"^(\w+)", 1)).alias("auxiliary"),
                       F.regexp_extract("match", r"(?i)(\w+)(?:\s+by)?$", 1).alias("participle"), agent.alias("hasExplicitAgent"), (F.col("start") - F.col("s_start")).alias("offsetInPassage"))
    return candidate(rows, rule, "passive-voice-adjudication", payload, "A form of be or get before a participle.", F.col("start"))


def noun_clusters(a: Analysed, config: RuleConfig) -> DataFrame:
    """Maximal runs of content words longer than the limit: one fold over the words of a sentence, no window."""
    rule = "noun-cluster-candidate"
    limit = int(config.get(rule, "maxClusterLength", config.limit("maxNounClusterLength")))
    nouns = set(vocab.words("noun_verbs"))  # verbs that are as often nouns part no cluster
    other = vocab.words("function_words") + [v for v in vocab.words("opener_verbs") if v not in nouns] + vocab.words("auxiliaries")
    content = lambda w: w["protected_kind"].isNull() & ~w["lower"].isin(other) & w["lower"].rlike(r"^\p{L}[\p{L}'’-]*$") & ~w["lower"].rlike("ly$|ing$|ed$")
    flat = F.transform("words", lambda w: F.struct((w["start"] - F.col("s_start")).alias("start"), (w["end"] - F.col("s_start")).alias("end"), content(w).alias("content")))
    s = _sentences(a).where(F.size("words") > limit).withColumn("flat", flat).where(F.size(F.filter("flat", lambda w: w["content"])) > limit)
    run = "struct<start:int,end:int,n:int>"
    state = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit(None).cast(run).alias("now"))
    joined = lambda now, w: F.substring(F.col("masked"), now["end"] + 1, w["start"] - now["end"]).rlike(r"^[\s ]*$")
    made = lambda start, end, n: F.struct(start.alias("start"), end.alias("end"), n.cast("int").alias("n"))
    closed = lambda acc: F.when(acc["now"]["n"] > limit, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
    step = lambda acc, w: (F.when(~w["content"], F.struct(closed(acc).alias("done"), F.lit(None).cast(run).alias("now")))
                           .when(acc["now"].isNotNull() & joined(acc["now"], w), F.struct(acc["done"].alias("done"), made(acc["now"]["start"], w["end"], acc["now"]["n"] + 1).alias("now")))
                           .otherwise(F.struct(closed(acc).alias("done"), made(w["start"], w["end"], F.lit(1)).alias("now"))))
    runs = s.withColumn("r", F.explode(F.aggregate("flat", state, step, closed)))
    runs = runs.withColumn("start", F.col("s_start") + F.col("r.start")).withColumn("end", F.col("s_start") + F.col("r.end"))
    cluster = F.substring(F.col("masked"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start"))
    return candidate(runs, rule, "noun-cluster-adjudication", F.struct(cluster.alias("cluster"), F.col("r.n").cast("long").alias("length")), "A run of content words above the limit.", F.col("start"))


def ambiguous_pronouns(a: Analysed, config: RuleConfig) -> DataFrame:
    rule = "ambiguous-pronoun-candidate"
    least = int(config.get(rule, "minAntecedents", 2))
    stop = vocab.words("function_words")
    followers = vocab.words("demonstrative_followers")
    nouns = lambda ws: F.transform(F.filter(ws, lambda w: w["protected_kind"].isNotNull() | (~w["lower"].isin(stop) & (F.length(w["lower"]) > 2))),
                                   lambda w: F.when(w["protected_kind"].isNotNull(), F.concat(F.lit("«"), w["protected_kind"], F.lit("»"))).otherwise(w["lower"]))
    none = F.array().cast("array<string>")
    own = a.documents.withColumn("own", F.transform("sentences", lambda s: nouns(s["words"])))  # the sentence before is in the same row: no shuffle of words
    s = own.select("doc_id", F.posexplode(F.arrays_zip("sentences", "own", F.concat(F.array(none), "own").alias("before"))).alias("pos", "x")).where("x.sentences IS NOT NULL")
    s = s.select("doc_id", "pos", "x.sentences.*", "x.own", "x.before").withColumnRenamed("id", "sentence_id").withColumn("s_start", F.col("start")).withColumn("s_end", F.col("end"))
    s = s.withColumn("antecedents", F.slice(F.array_distinct(F.concat("before", "own")), 1, 12)).withColumn("pw", prose(F.col("words"))).where(F.size("pw") > 0)
    first, second = F.get("pw", F.lit(0)), F.get("pw", F.lit(1))
    bare = first["lower"].isin(["this", "these", "those"]) & F.coalesce(second["lower"].isin(followers), F.lit(False))
    loose = F.filter("pw", lambda w: w["lower"].isin(["it", "they", "them"]))
    hit = F.when(bare, F.array(first)).otherwise(F.when(F.size("antecedents") >= least, loose).otherwise(F.slice(loose, 1, 0)))
    rows = s.withColumn("p", F.explode(hit)).withColumn("start", F.col("p.start")).withColumn("end", F.col("p.end"))
    return candidate(rows, rule, "pronoun-reference", F.struct(F.col("p.text").alias("pronoun"), F.col("antecedents").alias("antecedents")), "A pronoun with more than one possible antecedent.", F.col("start"))


ORDER = ("sentence-length-procedural", "sentence-length-descriptive", "unapproved-vocabulary", "preferred-terminology", "no-contractions", "punctuation-constraints",
         "no-repeated-words", "abbreviation-introduction", "number-unit-format", "list-instruction-structure", "one-instruction-per-sentence", "passive-voice-candidate",
         "noun-cluster-candidate", "ambiguous-pronoun-candidate")
#: Rules that may carry a fix.
FIXABLE = ("unapproved-vocabulary", "preferred-terminology", "no-contractions", "no-repeated-words")
#: Rules that read protected text on purpose.
READS_PROTECTED = ("number-unit-format", "list-instruction-structure")


def parts_of(rules) -> tuple[str, ...]:
    """The parts of an analysis that some rules read."""
    return tuple(sorted({p for r in rules for p in _READS.get(r, ("sentences", "words"))}))


#: Rules that do not read the words of the sentences.
_READS = {"punctuation-constraints": ("sentences",), "abbreviation-introduction": ("sentences",), "passive-voice-candidate": ("sentences",),
          "number-unit-format": ("regions",), "list-instruction-structure": ("masked", "blocks")}


def run_rules(a: Analysed, config: RuleConfig, enabled=ORDER, space=None) -> tuple[DataFrame | None, DataFrame | None]:
    """Findings and candidates of the enabled rules; the plan holds only those."""
    found, cands = [], []
    for rule in (r for r in ORDER if r in set(enabled)):
        if rule.startswith("sentence-length-"):
            found.append(sentence_length(a, config, rule.rpartition("-")[2]))
        elif rule == "unapproved-vocabulary":
            f, c = unapproved_vocabulary(a, config)
            found.append(f)
            cands += [c] if c is not None else []
        elif rule == "one-instruction-per-sentence":
            f, c = one_instruction_per_sentence(a, config, space)
            found.append(f)
            cands.append(c)
        elif rule in _CANDIDATE_RULES:
            cands.append(_CANDIDATE_RULES[rule](a, config))
        else:
            found.append(_RULES[rule](a, config))
    union = lambda xs: None if not xs else xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
    return union(found), union(cands)


_RULES = {"preferred-terminology": preferred_terminology, "no-contractions": no_contractions, "punctuation-constraints": punctuation_constraints, "no-repeated-words": no_repeated_words,
          "abbreviation-introduction": abbreviation_introduction, "number-unit-format": number_unit_format, "list-instruction-structure": list_instruction_structure}
_CANDIDATE_RULES = {"passive-voice-candidate": passive_voice, "noun-cluster-candidate": noun_clusters, "ambiguous-pronoun-candidate": ambiguous_pronouns}
