"""Command line: solve a script, run a folder, generate instances."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tesseral.sources.generate import FAMILIES, script_of, write_instances


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tesseral").getOrCreate()


def _solve(args: argparse.Namespace) -> int:
    from tesseral.functions.terms import PHASES
    from tesseral.plans.solver import solve_text

    try:
        text = Path(args.file).read_text()
    except OSError as e:
        print(f"cannot read {args.file}: {e}", file=sys.stderr)
        return 1
    if args.parallel:  # the whole script as one large instance, in bulk-synchronous rounds
        from pyspark.sql import functions as F

        from tesseral.plans.solver import solve_terms
        from tesseral.plans.storage import clear_written
        from tesseral.sources.scripts import constraint_table, node_table, parse_scripts

        spark = _session()
        parsed = parse_scripts(spark.createDataFrame([(args.file, args.file, text)], "inst string, path string, text string"))
        row = parsed.select("error").first()
        if row.error:
            print(row.error, file=sys.stderr)
            return 1
        print(solve_terms(node_table(parsed), constraint_table(parsed), "rounds", parsed.select(F.col("inst"))).first().verdict)
        clear_written(spark)
        return 0
    out = solve_text(text)
    if out["error"]:
        print(out["error"], file=sys.stderr)
        return 1
    print(out["verdict"])
    if args.timing or args.profile_solve:
        print("timing: " + " ".join(f"{p}={out[f'{p}_s']:.6f}" for p in PHASES), file=sys.stderr)
    return 0


def _run(args: argparse.Namespace) -> int:
    from tesseral.plans.solver import solve_scripts, totals
    from tesseral.sources.results import report, write_csv
    from tesseral.sources.scripts import scan_scripts

    if not sorted(Path(args.folder).glob("*.smt2")):
        print(f"no .smt2 files in {args.folder}", file=sys.stderr)
        return 1
    solved = solve_scripts(scan_scripts(_session(), args.folder)).orderBy("inst").cache()
    report(solved, args.timing).show(1000, truncate=60)
    totals(solved).show()
    if args.csv:
        write_csv(report(solved, args.timing), args.csv)
    return 0


def _generate(args: argparse.Namespace) -> int:
    if args.families == "all":
        sizes = [(f, args.sizes[0]) for f in FAMILIES]
    elif args.families.startswith("sweep"):
        low, high, step = args.sizes
        names = FAMILIES if args.families == "sweep" else [args.families.partition(":")[2]]
        sizes = [(f, n) for n in range(low, high + 1, step) for f in names]
    else:
        sizes = [(args.families, args.sizes[0])]
        if args.out is None:
            print(script_of(*sizes[0]), end="")
            return 0
    for path in write_instances(args.out or "synthetic_benchmarks", sizes):
        print(path)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesseral", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    solve = sub.add_parser("solve", help="print sat or unsat for one script")
    solve.add_argument("file")
    solve.add_argument("-p", "--parallel", action="store_true")
    solve.add_argument("-t", "--timing", action="store_true")
    solve.add_argument("--profile-solve", action="store_true")
    solve.set_defaults(do=_solve)
    run = sub.add_parser("run", help="solve all scripts of a folder")
    run.add_argument("folder")
    run.add_argument("-t", "--timing", action="store_true")
    run.add_argument("--csv")
    run.set_defaults(do=_run)
    make = sub.add_parser("generate", help="<family> n, all n, sweep[:family] n1 n2 step")
    make.add_argument("families")
    make.add_argument("sizes", nargs="+", type=int)
    make.add_argument("--out")
    make.set_defaults(do=_generate)
    args = parser.parse_args(argv)
    return args.do(args)


if __name__ == "__main__":
    sys.exit(main())
