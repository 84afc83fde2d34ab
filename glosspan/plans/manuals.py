"""Queries that run the analysis, rule by rule and as a whole, over manuals written from the parts.

A manual has every structure the rules look at, so where each finding lies follows from the lengths of the part's
columns; the SQL says so for every row without tokenising anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import Workspace
from ..operators.analyse import analyse_documents
from ..operators.rules import RuleConfig, parts_of, run_rules
from .pipeline import lint
from .registry import query, table

#: Text between the columns k (p_partkey), n (p_name), z (p_size) and b (p_brand), each in braces.
MANUAL = """# Part {k}

Utilise the e-mail of the {n} prior to noon; it is closed by the clerk.

The sensor cable bracket plate edge of unit {k} was checked in order to verify the PLC, and the operator, the manager, the clerk, the guard and the visitor commence an exhaustive examination!

> [!WARNING]
> Don't open `{b}` at {z}mm.

1. Lift the part and turn the the knob {z}mm. Don't stop.
2. press the key
3. Clean the filter, check the seal.

<!-- glosspan-disable no-contractions -- quoted text -->

We can't read {n}.

<!-- glosspan-enable -->

We can't write to it.
"""
_COLUMNS = {"k": "p_partkey", "n": "p_name", "z": "p_size", "b": "p_brand"}


def _parts(template: str) -> list[str]:
    """Literal text and column names in turn."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [head, _COLUMNS[name]]
    return [*out, rest]


def filled(template: str) -> Column:
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(_parts(template))])


def filled_sql(template: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(x if i % 2 else quoted(x) for i, x in enumerate(_parts(template)))


def documents(spark, sf_dir: str, template: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), filled(template).alias("text"))


#: rule -> [(context that occurs once, what of it is found, category, refusal, admonition, replacement)]
_V, _R = "deterministic-violation", "review-required"
_GUARD = "the text is in an admonition"
EXPECTED = {
    "sentence-length-descriptive": [("The sensor cable bracket plate edge of unit {k} was checked in order to verify the PLC, and the operator, the manager, the clerk, the guard and the visitor commence an exhaustive examination!", "", _V, None, "none", None)],
    "unapproved-vocabulary": [("Utilise the", "Utilise", _V, None, "none", "Use"), ("prior to noon", "prior to", _V, None, "none", "before"), ("in order to verify", "in order to", _V, None, "none", "to"),
                              ("commence an", "commence", _V, None, "none", None)],
    "preferred-terminology": [("the e-mail of", "e-mail", _V, None, "none", "email")],
    "no-contractions": [("> Don't open", "Don't", _V, _GUARD, "warning", None), ("mm. Don't stop", "Don't", _V, None, "none", "Do not"), ("can't write", "can't", _V, None, "none", "cannot")],
    "punctuation-constraints": [("noon; it", ";", _V, None, "none", None), ("examination!", "!", _V, None, "none", None), (", the guard", ",", _V, None, "none", None)],
    "no-repeated-words": [("turn the the knob", "the@9", _V, None, "none", "")],
    "abbreviation-introduction": [("the PLC,", "PLC", _V, None, "none", None)],
    "number-unit-format": [("` at {z}mm.", "{z}mm", _V, None, "warning", None), ("the knob {z}mm.", "{z}mm", _V, None, "none", None)],
    "list-instruction-structure": [("Lift the part and turn the the knob {z}mm. Don't stop.", "", _V, None, "none", None), ("press the key", "", _V, None, "none", None), ("press the key", "", _V, None, "none", None)],
    "one-instruction-per-sentence": [("Lift the part and turn the the knob {z}mm.", "", _V, None, "none", None), ("Clean the filter, check the seal.", "", _R, None, "none", None)],
    "passive-voice-candidate": [("is closed by the", "is closed by", _R, None, "none", None), ("was checked in", "was checked", _R, None, "none", None)],
    "noun-cluster-candidate": [("sensor cable bracket plate edge", "", _R, None, "none", None)],
    "ambiguous-pronoun-candidate": [("noon; it is", "it@6", _R, None, "none", None), ("write to it.", "it@9", _R, None, "none", None)],
}
#: What the directive withholds: it is a finding of the rule, and not of the whole analysis.
WITHHELD = ("We can't read", "can't", _V, None, "none", None)
_SEVERITY = {_V: "error", _R: "info"}


def _span_sql(context: str, found: str) -> tuple[str, str]:
    found, _, place = (found or context).partition("@") if found else (context, "", "")
    shift = place or f"instr({filled_sql(context)}, {filled_sql(found)}) - 1"
    start = f"(instr(text, {filled_sql(context)}) - 1 + {shift})"
    return f"{start}::INT", f"({start} + length({filled_sql(found)}))::INT"


def _rows_sql(rule: str, cases: list, gated: bool) -> list[str]:
    out = []
    for context, found, category, refusal, admonition, fix in cases:
        start, end = _span_sql(context, found)
        text = lambda x: "NULL" if x is None else "'" + x + "'"
        more = f", '{_SEVERITY[category]}' AS severity, {text(refusal)} AS refusal, '{admonition}' AS admonition, {text(fix)} AS fix" if gated else ""
        out.append(f"SELECT p_partkey AS doc_id, '{rule}' AS rule_id, '{category}' AS category, {start} AS \"start\", {end} AS \"end\"{more} FROM m")
    return out


_BASE = f"WITH m AS (SELECT *, {filled_sql(MANUAL)} AS text FROM part)\n"


def _register(rule: str, cases: list) -> None:
    cases = [*cases, WITHHELD] if rule == "no-contractions" else cases  # a rule does not know of suppression

    @query("rule_" + rule.replace("-", "_"), _BASE + "\nUNION ALL\n".join(_rows_sql(rule, cases, False)))
    def one_rule(spark, sf_dir):
        a = analyse_documents(documents(spark, sf_dir, MANUAL), parts=parts_of((rule,)))
        found, candidates = run_rules(a, RuleConfig(), (rule,), Workspace(spark))
        rows = [df.select("doc_id", "rule_id", c.alias("category"), "start", "end") for df, c in ((found, F.col("category")), (candidates, F.lit(_R))) if df is not None]
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


for _rule, _cases in EXPECTED.items():
    _register(_rule, _cases)


@query("lint_manuals", _BASE + "\nUNION ALL\n".join(x for r, c in EXPECTED.items() for x in _rows_sql(r, c, True)))
def lint_manuals(spark, sf_dir):
    """Rules, suppression, gate, overlaps and severities together: every finding of every manual."""
    f = lint(documents(spark, sf_dir, MANUAL)).findings
    none = F.coalesce("admonition", F.lit("none"))
    return f.select("doc_id", "rule_id", "category", "start", "end", "severity", "refusal", none.alias("admonition"), F.col("fix.text").alias("fix"))


_AT = _span_sql(*WITHHELD[:2])[0]


@query("suppression_records", _BASE + f"SELECT p_partkey AS doc_id, 'no-contractions' AS rule_id, {_AT} AS \"start\", (instr(text, '<!-- glosspan-disable') - 1)::INT AS d_start, 'quoted text' AS reason FROM m")
def suppression_records(spark, sf_dir):
    return lint(documents(spark, sf_dir, MANUAL)).suppressions


_DIGEST = "WITH m AS (SELECT *, {} AS text FROM part)\n"


# == structure

SENTENCES = "The {n} is small. Is it {z} wide? See fig. 3 for it! It is blue, e.g. like {b}. The end"
_STARTS = ["The {n}", "Is it", "See fig.", "It is blue", "The end"]
_ENDS = ["small.", "wide?", "for it!", "{b}.", "The end"]


@query("sentence_spans", _DIGEST.format(filled_sql(SENTENCES)) + "\nUNION ALL\n".join(
    f"SELECT p_partkey AS doc_id, {_span_sql(a, '')[0]} AS \"start\", {_span_sql(b, '')[1]} AS \"end\" FROM m" for a, b in zip(_STARTS, _ENDS)))
def sentence_spans(spark, sf_dir):
    """Abbreviations end no sentence, a block's end does."""
    return analyse_documents(documents(spark, sf_dir, SENTENCES), fmt="text", parts=("sentences",)).sentences.select("doc_id", "start", "end")


REGIONS = "Mail a.b@c{k}.example or see https://d.example/{k}/x now. Set `{b}` to {z} mm in /etc/p{k}/conf, call run_part_{k}() or GB{k}00 and stop.\n"
_REGIONS = [("email", "a.b@c{k}.example"), ("url", "https://d.example/{k}/x"), ("inline-code", "`{b}`"), ("numeric-expression", "{z} mm"), ("file-path", "/etc/p{k}/conf"), ("identifier", "run_part_{k}()"), ("identifier", "GB{k}00")]


@query("region_spans", _DIGEST.format(filled_sql(REGIONS)) + "\nUNION ALL\n".join(
    f"SELECT p_partkey AS doc_id, '{kind}' AS kind, {_span_sql(x, '')[0]} AS \"start\", {_span_sql(x, '')[1]} AS \"end\" FROM m" for kind, x in _REGIONS))
def region_spans(spark, sf_dir):
    return analyse_documents(documents(spark, sf_dir, REGIONS), parts=("regions",)).regions.select("doc_id", "kind", "start", "end")


@query("html_comment_regions", """
SELECT page_id, len(regexp_extract_all(html, '<!--(?:[^-]|-[^-])*-->'))::BIGINT AS n_comments,
       list_aggregate(list_transform(regexp_extract_all(html, '<!--(?:[^-]|-[^-])*-->'), lambda x: length(x)), 'sum')::BIGINT AS n_chars
FROM pages WHERE regexp_matches(html, '<!--(?:[^-]|-[^-])*-->')""")
def html_comment_regions(spark, sf_dir):
    r = analyse_documents(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), parts=("regions",)).regions.where("kind = 'comment'")
    return r.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n_comments"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("n_chars"))


@query("corroborated_constants", """
WITH p AS (SELECT p_partkey AS doc_id, p_type, 'Set ' || p_type || '_MODE=on. Use ECONOMY or STANDARD or PROMO now.' AS text FROM part),
w AS (SELECT *, unnest(['ECONOMY', 'STANDARD', 'PROMO']) AS w FROM p)
SELECT doc_id, w AS literal, (instr(text, ' Use ') + instr(substr(text, instr(text, ' Use ') + 1), w) - 1)::INT AS "start" FROM w WHERE w = p_type""")
def corroborated_constants(spark, sf_dir):
    """Capitals are constants where an identifier of the text has them as a segment."""
    text = F.concat(F.lit("Set "), "p_type", F.lit("_MODE=on. Use ECONOMY or STANDARD or PROMO now."))
    a = analyse_documents(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), parts=("regions",))
    r = a.documents.select("doc_id", "text", F.explode("regions").alias("r")).where("r.kind = 'constant'")
    return r.select("doc_id", F.expr("substring(text, r.start + 1, r.end - r.start)").alias("literal"), F.col("r.start").alias("start"))


_JOINED = "t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id)"


def _conversations(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    return c.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("text"))


@query("paragraph_blocks", f"""
WITH {_JOINED},
l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM t),
m AS (SELECT conv_id, i, line, trim(line) = '' AS blank, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS island FROM l),
b AS (SELECT conv_id, island, string_agg(line, chr(10) ORDER BY i) AS block FROM m WHERE NOT blank GROUP BY conv_id, island)
SELECT conv_id AS doc_id, count(*) AS n_blocks, sum(length(trim(block)))::BIGINT AS n_chars FROM b GROUP BY conv_id""")
def paragraph_blocks(spark, sf_dir):
    b = analyse_documents(_conversations(spark, sf_dir), fmt="text", parts=("blocks",), spread=False).blocks
    return b.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("n_chars"))


@query("word_tokens", f"""
WITH {_JOINED}
SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(body, '[\\pL\\pN]+(?:[''’.-][\\pL\\pN]+)*')) AS w FROM t) GROUP BY 1""")
def word_tokens(spark, sf_dir):
    words = analyse_documents(_conversations(spark, sf_dir), fmt="text", parts=("sentences", "words"), spread=False).words
    return words.groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("n"))
