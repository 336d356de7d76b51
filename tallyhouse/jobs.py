"""Command line jobs, run with the package on the Python path (``python -m tallyhouse.jobs`` or spark-submit).

    generate-sales OUT [--customers N] [--transactions N] [--tasks N]
    sales-summary IN OUT
    load-clustered IN OUT
    show-text PATH
"""

from __future__ import annotations

import argparse

from tallyhouse.plans.sales import generate_sales_dataset, load_clustered, run_sales_summary
from tallyhouse.session import build_session
from tallyhouse.sources.files import scan_text


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyhouse")
    commands = parser.add_subparsers(dest="command", required=True)
    generating = commands.add_parser("generate-sales")
    generating.add_argument("output")
    generating.add_argument("--customers", type=int, default=50_000_000)
    generating.add_argument("--transactions", type=int, default=20_000_000_000)
    generating.add_argument("--tasks", type=int, default=4000)
    for name in ("sales-summary", "load-clustered"):
        command = commands.add_parser(name)
        command.add_argument("input")
        command.add_argument("output")
    commands.add_parser("show-text").add_argument("path")
    options = parser.parse_args(arguments)

    spark = build_session(f"tallyhouse {options.command}")
    if options.command == "generate-sales":
        generate_sales_dataset(spark, options.output, options.customers, options.transactions, options.tasks)
    elif options.command == "sales-summary":
        run_sales_summary(spark, options.input, options.output)
    elif options.command == "load-clustered":
        load_clustered(spark, options.input, options.output)
    else:
        scan_text(spark, options.path).show(truncate=False)


if __name__ == "__main__":
    main()
