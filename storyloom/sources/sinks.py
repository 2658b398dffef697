"""Tables and reports out. Small reports go to one file by way of the driver, the rest through Spark's writers."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators import analytics

#: The columns of the export, in order.
FINDING_COLUMNS = ["id", "work_id", "scene_idx", "chapter_idx", "trope", "level", "confidence", "created_at", "model", "evidence_start", "evidence_end", "excerpt", "evidence_sentence", "rationale"]
GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="label" attr.type="string"/><key id="d1" for="node" attr.name="count" attr.type="int"/><key id="d2" for="edge" attr.name="weight" attr.type="int"/><graph id="G" edgedefault="undirected">'


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A Parquet snapshot, in folders by work where that column is named."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_findings_csv(findings: DataFrame, path: str) -> None:
    """The fixed columns in order; columns that are not there are empty."""
    rows = findings.select(*(F.col(c) if c in findings.columns else F.lit(None).cast("string").alias(c) for c in FINDING_COLUMNS))
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_lines(lines: list[str], path: str) -> None:
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def write_markdown(findings: DataFrame, columns: list[str], path: str, limit: int = 0) -> None:
    rows = analytics.markdown_rows(findings, columns)
    rows = rows.limit(limit) if limit else rows
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    write_lines(head + [r.line for r in rows.select("line").toLocalIterator()], path)


def write_graphml(edges: DataFrame, nodes: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """The catalog bounds the graph; its lines stream through the driver."""
    rows = analytics.graphml_lines(edges, nodes, names).orderBy("part", "number")
    write_lines([GRAPHML_HEAD, *(r.line for r in rows.toLocalIterator()), "</graph></graphml>"], path)


def write_edges_csv(edges: DataFrame, path: str) -> None:
    edges.orderBy(F.desc("weight"), "src", "dst").coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_heatmap_csv(cells: DataFrame, path: str) -> None:
    """One row a scene, three decimals."""
    shown = cells.select("scene_id", *(F.format_string("%.3f", F.col(f"`{c}`")).alias(c) for c in cells.columns if c != "scene_id"))
    shown.orderBy("scene_id").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_calibration(swept: DataFrame, binned: DataFrame, best: DataFrame, path: str) -> None:
    """A JSON summary: the sweep, the bins and the chosen row (all of bounded size)."""
    out = {name: [r.asDict() for r in df.collect()] for name, df in (("sweep", swept), ("bins", binned), ("best", best))}
    Path(path).write_text(json.dumps(out, indent=1), encoding="utf-8")


def write_calibration_csv(swept: DataFrame, binned: DataFrame, meta: dict, path: str) -> None:
    """Meta lines, the sweep and the bins in one file, with a blank line between them."""
    names = ["threshold", "n", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy", "pred_pos", "pred_neg", "pos_rate"]
    rows = []
    for r in swept.orderBy("i").collect():  # one row a threshold
        n, hit = r.tp + r.fp + r.tn + r.fn, r.tp + r.fp
        more = {"n": n, "pred_pos": hit, "pred_neg": n - hit, "pos_rate": r.positive_rate}
        rows.append([more[c] if c in more else r[c] for c in names])
    bins = [[round(r.low, 4), round(r.high, 4), r.n, round(r.mean_confidence, 6), round(r.accept_rate, 6)] for r in binned.orderBy("bin").collect()]
    with Path(path).open("w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([["# meta"], *meta.items(), [], names, *rows, [], ["# reliability_bins"], ["bin_lo", "bin_hi", "count", "mean_conf", "emp_accept"], *bins])


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    """One row a motif, as CSV or as JSON by the name's ending (the catalog bounds them)."""
    rows = [r.asDict() for r in thresholds.orderBy("motif_id").collect()]
    if path.endswith(".json"):
        Path(path).write_text(json.dumps(rows, indent=1), encoding="utf-8")
    else:
        write_lines([",".join(thresholds.columns), *(",".join(str(r[c]) for c in thresholds.columns) for r in rows)], path)


def write_html(pages: DataFrame, key: str, folder: str) -> None:
    """One page a key (html column), named by what is safe in a file name."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    safe = F.regexp_replace(F.col(key).cast("string"), "[^A-Za-z0-9._-]+", "_")
    for r in pages.select(safe.alias("name"), "html").toLocalIterator():
        Path(folder, f"{r['name']}.html").write_text(f'<!doctype html><meta charset="utf-8"><pre>{r.html}</pre>', encoding="utf-8")
