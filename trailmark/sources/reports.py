"""Reports: quality as JSON and HTML, benchmarks as TOML, the footer of a batch. Their tables have a row an arena."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import nan_to_null
from .config import dumps


def qc_json(summary: DataFrame, run: DataFrame) -> str:
    """{"run": ..., "rois": {name: ...}}, arenas by name, numbers to six places."""
    plain = lambda r: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}
    rois = {r["roi"]: {k: v for k, v in plain(r).items() if k != "roi"} for r in nan_to_null(summary).orderBy("roi").toLocalIterator()}
    return json.dumps({"run": plain(run.first()), "rois": rois}, indent=1)


def qc_html(report: str, title: str = "Quality") -> str:
    """A table of qc_json's arenas."""
    data = json.loads(report)
    names = list(dict.fromkeys(k for r in data["rois"].values() for k in r))
    cell = lambda v, t="td": f"<{t}>{html.escape('' if v is None else str(v))}</{t}>"
    head = "<tr>" + "".join(cell(n, "th") for n in ["roi", *names]) + "</tr>"
    rows = "".join("<tr>" + cell(roi) + "".join(cell(r.get(n)) for n in names) + "</tr>" for roi, r in data["rois"].items())
    about = ", ".join(f"{k}: {v}" for k, v in data["run"].items())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{html.escape(about)}</p><table>{head}{rows}</table>\n"


def bench_toml(info: dict, runs: DataFrame) -> str:
    """Facts, then a table of each mode of compare.bench_stats."""
    tables = (f"\n[{json.dumps(r['mode'])}]\n{dumps({k: v for k, v in r.asDict().items() if k != 'mode'})}" for r in runs.orderBy("mode").toLocalIterator())
    return dumps(info) + "".join(tables)


def batch_summary(results: DataFrame) -> DataFrame:
    """Videos that ended well (rows isn't null), all videos, rows, seconds elapsed and left, from (video, rows, start_s, end_s)."""
    one = results.agg(F.count("rows").alias("n_ok"), F.count("*").alias("n_total"), F.count("end_s").alias("n_done"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), (F.max("end_s") - F.min("start_s")).alias("elapsed_s"))
    return one.withColumn("left_s", F.when(F.col("n_done") > 0, F.col("elapsed_s") * (F.col("n_total") - F.col("n_done")) / F.col("n_done"))).drop("n_done")
