"""Command line: ``python -m glosspan lint FILE... [--json] [--only RULE] [--format F] [--min-severity S] [--no-fix]``.

Exit codes: 0 clean, 1 errors found, 2 wrong usage, 3 the model service failed for every candidate.
"""

from __future__ import annotations

import argparse
import json
import sys


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.print_usage(sys.stderr)
        self.exit(2, f"{message}\n")


def _arguments(argv: list[str] | None):
    p = _Parser(prog="glosspan")
    sub = p.add_subparsers(dest="command", required=True)
    lint = sub.add_parser("lint")
    lint.add_argument("files", nargs="+")
    lint.add_argument("--json", action="store_true")
    lint.add_argument("--only")
    lint.add_argument("--format", choices=("markdown", "text"))
    lint.add_argument("--min-severity", choices=("info", "warning", "error"), default="info")
    lint.add_argument("--no-fix", action="store_true")
    lint.add_argument("--endpoint")
    lint.add_argument("--model", default="default")
    sub.add_parser("rules")
    sub.add_parser("evaluators")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = _arguments(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from pyspark.sql import SparkSession

    from .operators import gate
    from .operators.adjudicate import http_transport
    from .plans.pipeline import lint
    from .sources import documents as S

    spark = spark or SparkSession.builder.appName("glosspan").getOrCreate()
    if args.command != "lint":
        for r in (S.rule_list(spark) if args.command == "rules" else S.evaluator_list(spark)).collect():
            print(r[1] if args.command == "rules" else r[0])
        return 0
    config = S.load_config() | ({"only_rule": args.only} if args.only else {}) | {"autofix": not args.no_fix}
    transport = http_transport(args.endpoint, args.model) if args.endpoint else None
    result = lint(S.read_files(spark, args.files, args.format), config, transport)
    findings = gate.at_least(result.findings, args.min_severity)
    if args.json:
        print(json.dumps({"tool": "glosspan", "files": [json.loads(r.value) for r in S.json_report(findings).toLocalIterator()]}))
    else:
        for r in S.text_report(findings, result.analysed.documents).orderBy("doc_id", "start").toLocalIterator():
            print(r.value)
    totals = gate.totals(findings).first()
    failed = bool(transport) and bool(result.notices.where("code = 'semantic-service-failure'").head(1)) and not result.findings.where("category = 'probable-violation'").head(1)
    return gate.exit_code(totals.errors, failed)


if __name__ == "__main__":
    sys.exit(main())
