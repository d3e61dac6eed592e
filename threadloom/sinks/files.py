"""File sinks: snapshots, CSV with JSON cells, the graph bundle, reports."""

from __future__ import annotations

import csv
import io
import json
import logging
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

log = logging.getLogger(__name__)


#: Comments of one JSON object of a snapshot; a larger snapshot is several objects, a line each.
SNAPSHOT_ROWS = 10_000


def write_snapshot(comments: DataFrame, video_url: str, folder: str) -> str | None:
    """The comments under a stamped name and as ``latest``; a failure is logged, and null returned.

    Objects of ``video_url``, ``saved_at``, ``count`` and ``comments``, in the order of pos, each of at most
    ``SNAPSHOT_ROWS`` comments; up to that many the snapshot is one object. ``read_snapshot`` reads them back.
    """
    try:
        path = f"{folder}/comments-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
        plain = F.to_json(F.struct("comment_id", "user_id", "username", "text", "timestamp", "likes"))
        quoted = F.expr("substring(to_json(array(raw)), 2, length(to_json(array(raw))) - 2)")
        rows = comments.select(F.expr(f"pos div {SNAPSHOT_ROWS}").alias("part"), "pos", plain.alias("plain"), F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).otherwise(quoted).alias("raw"))
        # the fields' object without its last brace, and the raw part in it
        one = F.when(F.col("raw").isNull(), F.col("plain")).otherwise(
            F.concat(F.expr("substring(plain, 1, length(plain) - 1)"), F.when(F.col("plain") == "{}", "").otherwise(","), F.lit('"raw":'), F.regexp_replace("raw", "[\r\n]+", " "), F.lit("}"))
        )
        parts = rows.select("part", F.struct("pos", one.alias("c")).alias("x")).groupBy("part").agg(F.sort_array(F.collect_list("x")).alias("x"))  # at most SNAPSHOT_ROWS each
        head = F.to_json(F.struct(F.lit(video_url).alias("video_url"), F.current_timestamp().cast("string").alias("saved_at"), F.size("x").alias("count")))
        line = F.concat(F.regexp_replace(head, "[}]$", ""), F.lit(',"comments":['), F.array_join(F.transform("x", lambda x: x["c"]), ","), F.lit("]}"))
        lines = parts.repartitionByRange("part").sortWithinPartitions("part").select(line.alias("value"))
        for at in (path, f"{folder}/latest"):
            lines.write.mode("overwrite").text(at)
        return path
    except Exception as e:
        log.warning("snapshot not written: %s", e)
        return None


def json_cells(df: DataFrame) -> DataFrame:
    """Lists, structs and maps as JSON text, null as an empty string."""
    complex_ = (ArrayType, MapType, StructType)
    return df.select(*[F.coalesce(F.to_json(f.name) if isinstance(f.dataType, complex_) else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    json_cells(df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True, emptyValue="", quoteAll=False, escape='"')


def guarded(text: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe; a minus sign does not."""
    return F.when(text.rlike("^[=+@]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_report_csv(df: DataFrame, path: str) -> None:
    """CSV with CRLF line ends and guarded cells, for spreadsheets; the byte order mark comes with ``spreadsheet_bytes``."""
    cells = json_cells(df)
    cells.select(*[guarded(F.col(c)).alias(c) for c in cells.columns]).write.mode("overwrite").csv(path, header=True, lineSep="\r\n", emptyValue="", escape='"')


def spreadsheet_bytes(rows: list[dict], columns: list[str]) -> bytes:
    """The same for a bounded result on the driver, as one file with a UTF-8 byte order mark."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(columns)
    for r in rows:
        cells = ["" if r.get(c) is None else str(r[c]) for c in columns]
        w.writerow(["'" + x if x[:1] in ("=", "+", "@") else x for x in cells])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def write_graph(bundle: dict[str, DataFrame], folder: str) -> None:
    """nodes, edges, components, component_summary and graph_summary, a CSV folder each."""
    for name, df in bundle.items():
        write_csv(df, f"{folder}/{name}")


def write_rows(rows: list[dict], stem: str) -> str:
    """Bench rows as JSON and CSV next to each other; another name if the file is in use."""
    path = Path(stem)
    path.parent.mkdir(parents=True, exist_ok=True)
    for attempt in range(10):
        at = path if not attempt else path.with_name(f"{path.name}-{attempt}")
        try:
            at.with_suffix(".json").write_text(json.dumps(rows, indent=1))
            names = list(dict.fromkeys(k for r in rows for k in r))
            with at.with_suffix(".csv").open("w", newline="") as f:
                w = csv.DictWriter(f, names)
                w.writeheader()
                w.writerows(rows)
            return str(at)
        except PermissionError:
            continue
    raise PermissionError(f"{stem}: no name could be written")


def write_markdown(sections: dict[str, tuple[list[dict], list[str]]], title: str, path: str) -> str:
    """A report of titled tables, (rows, columns) each; tables without rows say so."""
    out = [f"# {title}"]
    for name, (rows, columns) in sections.items():
        out += [f"## {name}", markdown_table(rows, columns) if rows else "No rows."]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n\n".join(out) + "\n")
    return path


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]])
