"""Commands: check texts, list rules, show a plan, validate rules, convert dictionaries, import datasets. `python -m slovotok.cli --help`."""

from __future__ import annotations

import argparse
import sys
import time

from slovotok.engine import Checker
from slovotok.plans.rules import DOMAINS, PROFILES, RULES, SEVERITIES, STATUSES, RuleFilter
from slovotok.sinks import reports


def named(known: tuple[str, ...]):
    """A parser of one of the known names, in any case and with - for _; several may be joined by commas."""

    def parse(text: str) -> tuple[str, ...]:
        out = tuple(x.strip().lower().replace("-", "_") for x in text.split(",") if x.strip())
        wrong = [x for x in out if x not in known]
        if wrong or not out:
            raise argparse.ArgumentTypeError(f"{', '.join(wrong) or 'nothing'} is none of {', '.join(known)}")
        return out

    return parse


def parser() -> argparse.ArgumentParser:
    """The command line."""
    p = argparse.ArgumentParser(prog="slovotok", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    chosen = argparse.ArgumentParser(add_help=False)
    chosen.add_argument("--profile", type=named(PROFILES), default=("default",))
    chosen.add_argument("--domain", type=named(DOMAINS), default=(), dest="domains")
    chosen.add_argument("--severity", type=named(SEVERITIES), default=(), dest="severities")
    chosen.add_argument("--status", type=named(STATUSES), default=(), dest="statuses")
    chosen.add_argument("--include", action="append", default=[], metavar="RULE")
    chosen.add_argument("--exclude", action="append", default=[], metavar="RULE")
    chosen.add_argument("--capability", action="append", default=[], dest="capabilities")
    c = sub.add_parser("check", parents=[chosen], help="check text files (- for the standard input) or a Parquet table of doc_id and text")
    c.add_argument("paths", nargs="+")
    c.add_argument("--format", choices=("human", "json"), default="human")
    c.add_argument("--suppress", action="append", default=[], metavar="RULE")
    c.add_argument("--no-inline", action="store_true", help="do not look for directives in the text")
    c.add_argument("--lexicon", help="a dictionary written as Parquet")
    c.add_argument("--timings", action="store_true", help="seconds of planning and checking, on the error stream")
    r = sub.add_parser("list-rules", parents=[chosen], help="the rules of a profile, separated by tabs")
    r.add_argument("--all", action="store_true", help="whatever the profile")
    q = sub.add_parser("plan", parents=[chosen], help="which rules run, and which are left out and why")
    q.add_argument("--format", choices=("human", "json"), default="human")
    sub.add_parser("validate", help="break of the rule table's contract, if any")
    d = sub.add_parser("convert", help="a dictionary as the project's eight columns")
    d.add_argument("kind", choices=("project", "opencorpora", "pymorphy", "xml"))
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("--strict", action="store_true")
    g = sub.add_parser("debug", help="what each layer finds in text files, as JSON")
    g.add_argument("paths", nargs="+")
    i = sub.add_parser("import", help="the datasets of a registry file as records")
    i.add_argument("registry")
    i.add_argument("--dry-run", action="store_true")
    return p


def rule_filter(args: argparse.Namespace) -> RuleFilter:
    return RuleFilter(args.profile[0], tuple(args.include), tuple(args.exclude), args.domains, args.severities, args.statuses)


def _documents(spark, paths: list[str]):
    if len(paths) == 1 and paths[0].endswith(".parquet"):
        return spark.read.parquet(paths[0]).select("doc_id", "text")
    texts = [(p, sys.stdin.read()) for p in paths if p == "-"]
    files = [p for p in paths if p != "-"]
    out = spark.createDataFrame(texts, "doc_id string, text string")
    return out.unionByName(spark.read.option("wholetext", "true").text(files).selectExpr("_metadata.file_path as doc_id", "value as text")) if files else out


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    """Runs a command; 1 if there are errors among the issues, or breaks of the contract."""
    args, out = parser().parse_args(argv), out or sys.stdout
    say = lambda *lines: print(*lines, sep="\n", file=out)
    if args.command == "list-rules":
        f = rule_filter(args)
        say(*reports.rule_list([r for r in RULES if args.all or f.matches(r)]))
        return 0
    if args.command == "validate":
        from slovotok.operators.validation import rule_violations

        bad = rule_violations(RULES)
        say(*[f"{r}\t{p}" for r, p in bad], f"{len(RULES)} rules, {len(bad)} problems")
        return int(bool(bad))
    checker = Checker()
    if args.command in ("check", "plan"):
        checker = Checker(chosen=rule_filter(args)).with_capabilities(*args.capabilities)
    if args.command == "plan":
        say(*(reports.plan_lines(checker.plan()) if args.format == "human" else [reports.plan_json(checker.plan())]))
        return 0
    from pyspark.sql import functions as F

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("slovotok").getOrCreate()
    if args.command == "convert":
        from slovotok.sources import lexicon, registry

        readers = {"project": lexicon.read_project, "opencorpora": lexicon.read_opencorpora_csv, "pymorphy": lexicon.read_pymorphy}
        rows = lexicon.read_opencorpora_xml(spark, args.source) if args.kind == "xml" else readers[args.kind](spark.read.text(args.source), strict=args.strict)
        registry.convert_dictionary(rows).write.mode("overwrite").text(args.target)
        return 0
    if args.command == "import":
        from slovotok.sources.registry import import_all, read_registry

        say(*[f"{n}\t{s}\t{k}" for n, s, k in import_all(spark, read_registry(args.registry), args.dry_run)])
        return 0
    if args.command == "debug":
        from slovotok.operators.inspection import debug_reports

        say(*[r["report"] for r in debug_reports(_documents(spark, args.paths)).orderBy("doc_id").toLocalIterator()])
        return 0
    began = time.perf_counter()
    checker = checker.with_suppression(*args.suppress, inline=not args.no_inline)
    if args.lexicon:
        from slovotok.sources.lexicon import read_lexicon

        checker = checker.with_lexicon(read_lexicon(spark, args.lexicon))
    issues = checker.check(_documents(spark, args.paths))
    planned = time.perf_counter()
    if args.format == "human":
        lines = reports.human_lines(issues).orderBy("doc_id", "start_b").select("text")
    else:
        lines = reports.document_json(issues).orderBy("doc_id").select(F.to_json(F.struct("doc_id", F.parse_json("json").alias("issues"))).alias("text"))
    errors = issues.filter("severity = 'error'").limit(1).count()
    for row in lines.toLocalIterator():
        say(row["text"])
    if args.timings:
        print(f"planning {planned - began:.3f} s, checking {time.perf_counter() - planned:.3f} s", file=sys.stderr)
    return int(errors > 0)


if __name__ == "__main__":
    sys.exit(main())
