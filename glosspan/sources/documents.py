"""Readers and writers: documents, rule packs, shared configuration, prompts, corpus files and reports."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans, vocab
from ..operators.adjudicate import EVALUATORS, parse_json_strict
from ..operators.analyse import infer_format
from ..operators.rules import ORDER


def read_files(spark: SparkSession, paths: list[str], fmt: str | None = None) -> DataFrame:
    """(doc_id, path, format, text), one row per file; the format follows the name unless given."""
    paths = [p if "://" in p else os.path.abspath(p) for p in paths]
    d = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return d.select(F.col("path").alias("doc_id"), "path", (F.lit(fmt) if fmt else infer_format(F.col("path"))).alias("format"), "text")


def read_table(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


class PackError(ValueError):
    """A rule pack that cannot be read or is not valid."""


def load_rule_pack(spec=None, base: str = ".") -> dict:
    """None: the bundled pack; a mapping: itself; a string: a JSON file below ``base``."""
    if spec is None:
        return {"metadata": {"id": "bundled", "authority": "provisional", "conformanceClaim": "none"}, "limits": dict(vocab.LIMITS), "rules": []}
    if isinstance(spec, str):
        try:
            spec = parse_json_strict(Path(base, spec).read_text("utf-8"), spec)
        except (OSError, ValueError) as e:
            raise PackError(f"rule pack {spec}: {e}") from e
    if not isinstance(spec, dict) or not isinstance(spec.get("metadata"), dict) or "id" not in spec["metadata"]:
        raise PackError("a rule pack needs metadata with an id")
    for name, value in spec.get("limits", {}).items():
        if name not in vocab.LIMITS or not isinstance(value, (int, float)) or isinstance(value, bool):
            raise PackError(f"limit {name!r} is unknown or not a number")
    out = dict(spec)
    d = spec.get("dictionary", {})
    if "unapproved" in d:
        out["unapproved"] = {x["term"]: {"use": x.get("alternatives", []), "safe": x.get("safeSubstitution", False)} for x in d["unapproved"]}
    for source, name in ((d.get("preferred"), "preferred"), (spec.get("contractions"), "contractions")):
        if source is not None:
            out[name] = {x["from"]: {"use": x["to"], "safe": x.get("safeSubstitution", False)} for x in source}
    return out


def strip_comments(text: str) -> str:
    """JSON with line and block comments blanked outside strings."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)


NAMES = ("glosspan.config.json", "glosspan.config.jsonc", ".glosspanrc.json")


def find_config(base: str | None = None, variable: str = "GLOSSPAN_CONFIG") -> str | None:
    """The file the environment names, else the first known name below ``base``, else below the working directory."""
    if os.environ.get(variable):
        return os.environ[variable]
    for folder in filter(None, (base, os.getcwd())):
        for name in NAMES:
            if Path(folder, name).is_file():
                return str(Path(folder, name))
    return None


def load_config(base: str | None = None) -> dict:
    path = find_config(base)
    return json.loads(strip_comments(Path(path).read_text("utf-8"))) if path else {}


# == prompts

_VARIABLE = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}")


def parse_prompt(text: str, path: str = "") -> dict:
    """A prompt file: a header of ``key: value`` lines, then sections ``system`` and ``user`` between ``---`` lines."""
    parts = re.split(r"^---[ \t]*$", text, flags=re.M)
    if len(parts) != 3:
        raise ValueError(f"{path}: a prompt needs a header and two sections")
    head = dict(re.findall(r"^(\w+):[ \t]*(.+?)[ \t]*$", parts[0], re.M))
    if path and not Path(path).stem == f"{head.get('id')}.v{head.get('version')}":
        raise ValueError(f"{path}: id and version do not match the file name")
    return {**head, "system": parts[1].strip(), "user": parts[2].strip(), "variables": sorted(set(_VARIABLE.findall(parts[1] + parts[2])))}


def format_value(value) -> str:
    if value is None or value == []:
        return "none"
    if isinstance(value, list):
        return "\n".join(f"- {v}" for v in value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def render(template: str, values: dict) -> str:
    """Replace ``{{name}}``; a missing and an unused variable are both errors."""
    wanted = set(_VARIABLE.findall(template))
    if wanted - set(values) or set(values) - wanted:
        raise ValueError(f"missing {sorted(wanted - set(values))}, unused {sorted(set(values) - wanted)}")
    return _VARIABLE.sub(lambda m: format_value(values[m[1]]), template)


def normalise_url(url):
    """Column: without the fragment and trailing slashes."""
    return F.regexp_replace(F.split(url, "#")[0], "/+$", "")


# == corpus files

MANIFEST = ("id string, title string, category string, split string, originalPath string, compliantPath string, annotationPath string, originalSha256 string, "
            "compliantSha256 string, licence string, provenanceKey string, sourceUrl string, retrievedAt string, notes string")
ANNOTATION = ("fixtureId string, original string, compliant string, split string, changes array<struct<passageId:string,originalText:string,rewrittenText:string,"
              "ruleIds:array<string>,originalSpans:array<struct<start:int,end:int>>,reason:string,status:string,reviewer:string>>, "
              "candidateAdjudications array<struct<passageId:string,ruleId:string,evaluatorId:string,quote:string,span:struct<start:int,end:int>,verdict:string,"
              "reason:string,reviewer:string>>, protectedLiterals array<string>")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).json(path, multiLine=True, mode="FAILFAST")


# == sinks


def json_report(findings: DataFrame, tool: str = "glosspan") -> DataFrame:
    """One JSON object per document; rows are nested per document, never over the whole run."""
    rows = F.sort_array(F.collect_list(F.struct("start", "end", "rule_id", "category", "severity", "message")))
    return findings.groupBy("doc_id").agg(rows.alias("f")).select(F.to_json(F.struct(
        F.lit(tool).alias("tool"), F.lit("none").alias("conformance"), "doc_id", F.col("f").alias("findings"))).alias("value"))


def text_report(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """``document:line:column severity message [rule]`` lines with columns from 1 for people."""
    d = findings.join(documents.select("doc_id", "text"), "doc_id")
    return d.select("doc_id", "start", F.format_string("%s:%d:%d %s %s [%s]", F.col("doc_id").cast("string"), spans.line_of(F.col("text"), F.col("start")),
                                                       spans.column_of(F.col("text"), F.col("start")) + 1, "severity", "message", "rule_id").alias("value"))


def host_report(findings: DataFrame, rule: str) -> DataFrame:
    """One rule's findings as a host linter wants them: code 2, 1 or 0, at most three suggestions, fix range."""
    code = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return findings.where(F.col("rule_id") == rule).select("doc_id", F.concat(F.lit(f"{rule}: "), "message").alias("message"), code.alias("severity_code"), "start", "end",
                                                           F.slice("suggestions", 1, 3).alias("suggestions"), "fix")


def candidate_packets(candidates: DataFrame, documents: DataFrame, context: int = 320) -> DataFrame:
    """Candidates with the text around them for reviewers."""
    d = candidates.join(documents.select("doc_id", "text"), "doc_id")
    lo = F.greatest(F.col("start") - context, F.lit(0))
    return d.select("doc_id", "id", "rule_id", "evaluator_id", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("quote"), "payload",
                    F.substring(F.col("text"), lo + 1, F.col("end") + context - lo).alias("context"))


def rule_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r) for i, r in enumerate(ORDER)], "position int, rule_id string")


def evaluator_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, list(k)) for e, k in EVALUATORS.items()], "evaluator_id string, required array<string>")
