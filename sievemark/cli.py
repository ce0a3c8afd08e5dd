"""Command line: scan a folder or file and write a report."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from dataclasses import replace

from . import vocab
from .config import ScanConfig

#: Loaders of models that a warm-up calls in the workers.
MODELS: list[Callable] = []


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievemark", description="Поиск персональных данных в файловом хранилище.")
    p.add_argument("root", nargs="?", default=os.path.join(os.getcwd(), "share"), help="папка или файл")
    p.add_argument("-o", "--output", default="result.csv", help="путь отчета; CSV имеет вид size,time,name")
    p.add_argument("--output-format", choices=("csv", "json", "md"), default="csv")
    p.add_argument("--include-ext", nargs="*", default=sorted(vocab.EXTENSIONS), help="расширения без точки")
    p.add_argument("--max-text-chars", type=int, default=200_000)
    p.add_argument("--max-structured-rows", type=int, default=20_000)
    p.add_argument("--max-binary-read-bytes", type=int, default=5_000_000)
    p.add_argument("--enable-ocr", action="store_true")
    p.add_argument("--include-empty-results", action="store_true")
    p.add_argument("--analysis-workers", type=int, default=3, help="число разделов данных на каждое ядро при анализе")
    p.add_argument("--file-workers", type=int, default=1, help="число разделов данных на каждое ядро при чтении")
    p.add_argument("--warmup-model", action="store_true", help="загрузить модели в рабочих процессах до сканирования")
    p.add_argument("--debug-progress", action="store_true", help="печатать строку о каждом файле")
    p.add_argument("--slow-log", default="", help="CSV медленных файлов, иначе slow_files.csv рядом с отчетом")
    p.add_argument("--slow-threshold", type=float, default=20.0)
    return p


def config_of(args: argparse.Namespace) -> ScanConfig:
    output = os.path.abspath(os.path.expanduser(args.output))
    return ScanConfig(
        root=os.path.abspath(os.path.expanduser(args.root)) if "://" not in args.root else args.root, output=output, output_format=args.output_format,
        include_extensions=frozenset(e.lower().lstrip(".") for e in args.include_ext), max_text_chars=args.max_text_chars, max_structured_rows=args.max_structured_rows,
        max_binary_read_bytes=args.max_binary_read_bytes, enable_ocr=args.enable_ocr, include_empty_results=args.include_empty_results, debug_progress=args.debug_progress,
        slow_log_path=os.path.abspath(os.path.expanduser(args.slow_log)) if args.slow_log else os.path.join(os.path.dirname(output), "slow_files.csv"), slow_threshold_seconds=max(0.0, args.slow_threshold),
    )


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    config = config_of(args)
    if "://" not in config.root and not os.path.exists(config.root):
        parser.error(vocab.NOT_FOUND.format(config.root))
    from pyspark.sql import SparkSession

    from .plans.report import write_results
    from .plans.scan import scan_root, slow_files

    spark = SparkSession.builder.appName("sievemark").getOrCreate()
    cores = spark.sparkContext.defaultParallelism
    config = replace(config, file_parts=cores * max(1, args.file_workers), analysis_parts=cores * max(1, args.analysis_workers))
    if args.warmup_model and MODELS:
        from .operators.recognise import warm_up

        for load in MODELS:
            warm_up(spark, load)
    _, extracted = scan_root(spark, config)
    extracted = extracted.repartition(config.analysis_parts).persist()
    from .plans.scan import results as results_of

    results = results_of(extracted, config.include_empty_results).persist()
    write_results(results, config.output, config.output_format)
    import csv

    with open(config.slow_log_path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(("path", "ext", "seconds", "status"))
        out.writerows(tuple(r) for r in slow_files(extracted, config.slow_threshold_seconds).toLocalIterator())
    if config.debug_progress:
        for n, r in enumerate(extracted.select("file_format", "elapsed", "name", "status").toLocalIterator(), 1):
            print(f"[debug] {n} {r['file_format']} {r['elapsed']:.3f}s {r['name']} {r['status']}")
    print(vocab.DONE.format(results.count()))
    print(vocab.SAVED.format(config.output))
    return 0


if __name__ == "__main__":
    sys.exit(main())
