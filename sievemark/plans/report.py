"""Reports: of scan results (document profile) and of classified files (finding profile).

Report tables are DataFrames; a file with a fixed name is written by the
driver from rows that stream to it partition by partition, so a long report
never stands in the driver's memory as a whole.
"""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators.finding import advice

# fixed values: the fields, headings and lines of all reports below have the wording that readers of these reports expect
RESULT_FIELDS = ("path", "name", "size", "time", "file_format", "categories", "findings_count", "uz", "extractor", "recommendations", "warnings")


def _rows(df: DataFrame) -> Iterator[dict]:
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


# --- document profile -------------------------------------------------------


def category_totals(results: DataFrame) -> DataFrame:
    """``(category, total)`` over results with ``categories map<string,int>``."""
    return results.select(F.explode("categories").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("total"))


def level_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy("uz").agg(F.count("*").alias("files"))


def write_results(results: DataFrame, path: str, fmt: str) -> None:
    """One file of results as csv, json or md."""
    writers = {"csv": _results_csv, "json": _results_json, "md": _results_markdown, "markdown": _results_markdown}
    if fmt not in writers:
        raise ValueError(f"Неподдерживаемый формат отчета: {fmt}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    writers[fmt](results, path)


def _results_csv(results: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(("size", "time", "name"))
        for r in _rows(results.select("size", "time", "name")):
            out.writerow((r["size"], r["time"], r["name"]))


def _json_array(f, rows: Iterator[dict], indent: str = "") -> None:
    """A JSON array written row by row, as ``json.dumps`` with an indent of two would."""
    first = True
    for r in rows:
        body = json.dumps(r, ensure_ascii=False, indent=2).replace("\n", f"\n{indent}  ")
        f.write(("[" if first else ",") + f"\n{indent}  {body}")
        first = False
    f.write("[]" if first else f"\n{indent}]")


def _results_json(results: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        _json_array(f, _rows(results.select(*RESULT_FIELDS)))


def _results_markdown(results: DataFrame, path: str) -> None:
    results = results.persist()
    levels = {r["uz"]: r["files"] for r in level_histogram(results).collect()}
    totals = {r["category"]: r["total"] for r in category_totals(results).collect()}
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# Отчет по сканированию ПДн\n\n- Обработано файлов с результатом: {sum(levels.values())}\n- Распределение по УЗ: {levels}\n- Суммарные находки по категориям: {totals}\n\n")
        f.write("| Size | Time | Name | УЗ | Категории ПДн |\n| ---: | --- | --- | --- | --- |\n")
        for r in _rows(results.select("size", "time", "name", "uz", "categories")):
            found = ", ".join(k for k in vocab.DOC_CATEGORIES if (r["categories"] or {}).get(k, 0) > 0) or "нет"
            f.write(f"| {r['size']} | {r['time']} | `{r['name']}` | {r['uz']} | {found} |\n")
    results.unpersist()


# --- finding profile --------------------------------------------------------


def report_rows(status: DataFrame, classified: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``status(path, extension, status, via_ocr, notes, error)``, with its classification if it has one.

    A left join on the path; which side moves is left to the optimizer.
    """
    rows = status.join(classified, "path", "left")
    if lists is not None:
        rows = rows.join(lists, "path", "left")
    none = F.create_map().cast("map<string,int>")
    notes = F.coalesce("notes", F.array().cast("array<string>"))
    unread = F.col("total_findings").isNull() & (F.coalesce("error", F.lit("")) != "")
    return rows.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("extension").alias("format"),
        "status",
        "via_ocr",
        "uz_level",
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
        F.coalesce("findings_by_group", none).alias("groups"),
        F.coalesce("findings_by_category", none).alias("categories"),
        advice(F.col("uz_level")).alias("recommendations"),
        F.when(unread, F.concat(notes, F.array("error"))).otherwise(notes).alias("notes"),
        *([F.col("findings")] if lists is not None else []),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The most dangerous files first: level, findings, name; the path settles what is left."""
    return rows.orderBy(F.coalesce("uz_level", F.lit(99)), F.desc("total_findings"), F.lower("filename"), "path")


def summary(rows: DataFrame) -> DataFrame:
    """One row: files, files with findings, counts of every status and level, zero where there are none."""
    n = lambda c: F.count_if(c)
    return rows.agg(
        F.count("*").alias("total_files"),
        n(F.col("total_findings") > 0).alias("files_with_pii"),
        *[n(F.col("status") == s).alias(f"status_{s}") for s in ("ok", "skipped", "error")],
        *[n(F.col("uz_level") == k).alias(f"uz_{k}") for k in (1, 2, 3, 4)],
        n(F.col("uz_level").isNull()).alias("uz_none"),
    )


def totals(rows: DataFrame, column: str, names: tuple[str, ...] = ()) -> DataFrame:
    """``(name, total)`` of a map column, largest first; ``names`` that never occur are listed with zero."""
    found = rows.select(F.explode(column).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("total"))
    if names:
        dimension = rows.sparkSession.createDataFrame([(x,) for x in names], "name string")
        found = dimension.join(found, "name", "left").select("name", F.coalesce("total", F.lit(0)).alias("total"))
    return found.orderBy(F.desc("total"), "name")


def joined_map(m: Column) -> Column:
    """``key:value`` pairs in the order of keys, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")


def csv_table(rows: DataFrame) -> DataFrame:
    """The flat table of the CSV report."""
    return rows.select(
        "path", "filename", "format", "status", F.lower(F.col("via_ocr").cast("string")).alias("via_ocr"), F.coalesce(F.col("uz_level").cast("string"), F.lit("")).alias("uz_level"), "total_findings",
        joined_map(F.col("groups")).alias("groups"), joined_map(F.col("categories")).alias("categories"), F.array_join("recommendations", " | ").alias("recommendations"), F.array_join("notes", " | ").alias("notes"),
    )


def text_lines(rows: DataFrame) -> DataFrame:
    """The lines of the TXT report, in order."""
    name = F.when(F.length("filename") <= 48, F.col("filename")).otherwise(F.concat(F.substring("filename", 1, 45), F.lit("...")))
    groups = F.array_join(F.array_sort(F.map_keys("groups")), ",")
    shown = F.when(groups == "", "-").otherwise(groups)
    pad = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))
    level = F.coalesce(F.concat(F.lit("UZ-"), F.col("uz_level").cast("string")), F.lit("none"))
    return ordered(rows).select(F.concat_ws(" ", pad(level, 6), pad(shown, 32), pad(name, 50), F.col("path")).alias("value"))


def write_all(rows: DataFrame, folder: str, root: str, stem: str = "pii_report", now: str | None = None) -> dict[str, str]:
    """The JSON, CSV, Markdown and TXT reports side by side; the rows are computed once."""
    os.makedirs(folder, exist_ok=True)
    rows = rows.persist()
    s = summary(rows).first().asDict()
    groups = {r["name"]: r["total"] for r in totals(rows, "groups").collect()}
    categories = {r["name"]: r["total"] for r in totals(rows, "categories").collect()}
    now = now or datetime.now().isoformat(timespec="seconds")
    levels = {k: s[f"uz_{k}"] for k in ("1", "2", "3", "4", "none")}
    states = {k: s[f"status_{k}"] for k in ("ok", "skipped", "error")}
    paths = {k: os.path.join(folder, f"{stem}.{k}") for k in ("json", "csv", "md", "txt")}
    head = {"scanned_at": now, "root": root, "total_files": s["total_files"], "files_with_pii": s["files_with_pii"], "status_counts": states, "uz_distribution": levels, "group_totals": groups, "category_totals": categories}
    with open(paths["json"], "w", encoding="utf-8") as f:
        f.write('{\n  "summary": ' + json.dumps(head, ensure_ascii=False, indent=2).replace("\n", "\n  ") + ',\n  "files": ')
        _json_array(f, ({k: v for k, v in r.items() if k != "findings" or v is not None} for r in _rows(rows)), "  ")
        f.write("\n}")
    with open(paths["csv"], "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=";")
        table = csv_table(rows)
        out.writerow(table.columns)
        for r in _rows(table):
            out.writerow([r[c] for c in table.columns])
    with open(paths["md"], "w", encoding="utf-8") as f:
        f.write(f"# Отчёт по ПДн\n\n- Сканировано: `{root}`\n- Время: `{now}`\n- Всего файлов в отчёте: **{s['total_files']}**\n- Файлов с ПДн: **{s['files_with_pii']}**\n\n## Статусы обработки\n")
        f.writelines(f"- {k}: {v}\n" for k, v in states.items())
        f.write("\n## Распределение по УЗ\n| УЗ | Файлов |\n|---|---|\n")
        f.writelines(f"| {'нет ПДн / не классифицирован' if k == 'none' else k} | {v} |\n" for k, v in levels.items())
        if groups:
            f.write("\n## Находки по группам (всего по датасету)\n| Группа | Количество |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in groups.items()))
        if categories:
            f.write("\n## Находки по категориям (всего по датасету)\n| Категория | Группа | Количество |\n|---|---|---|\n" + "".join(f"| {k} | {vocab.FINDING_GROUPS.get(k, '')} | {v} |\n" for k, v in categories.items()))
        f.write("\n## Файлы\n| Файл | Формат | УЗ | Находок | Категории | Статус |\n|---|---|---|---|---|---|\n")
        for r in _rows(ordered(rows)):
            found = ", ".join(f"{k}({v})" for k, v in sorted(r["categories"].items()))
            f.write(f"| `{r['filename'].replace('|', chr(92) + '|')}` | {r['format']} | {r['uz_level'] if r['uz_level'] is not None else '—'} | {r['total_findings']} | {found} | {r['status']} |\n")
    with open(paths["txt"], "w", encoding="utf-8") as f:
        f.write(f"PII scan: {root}\nTime:     {now}\nTotal:    {s['total_files']}  (with PII: {s['files_with_pii']}, UZ-1/2/3/4/none: {'/'.join(str(v) for v in levels.values())})\n")
        f.write("-" * 100 + f"\n{'UZ':<6} {'GROUPS':<32} {'FILE':<50} PATH\n" + "-" * 100 + "\n")
        for r in _rows(text_lines(rows)):
            f.write(r["value"] + "\n")
    rows.unpersist()
    return paths
