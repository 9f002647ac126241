"""Tools outside Python, run once a file where they are installed; elsewhere their rows say available = false.

A tool gets a time limit and its output a cap, and a failure is a row, never a
failed task.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Command lines, with {} for the file, and seconds.
TOOLS = {
    "probe": (("ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams", "{}"), 15),
    "ocr": (("tesseract", "{}", "stdout", "-l", "heb+eng+ara", "--psm", "6"), 25),
    "pdf_text": (("pdftotext", "-layout", "{}", "-"), 15),
    "pdf_info": (("pdfinfo", "{}"), 12),
    "pdf_check": (("qpdf", "--check", "{}"), 12),
    "pdf_signatures": (("pdfsig", "{}"), 15),
}
MOST_OUTPUT = 4 << 20
OUT = "asset_id string, available boolean, ok boolean, output string"


def run(tool: str):
    command, seconds = TOOLS[tool]

    def over(batches):
        path = shutil.which(command[0])
        for frame in batches:
            rows = []
            for asset, name, content in zip(frame["asset_id"], frame["name"], frame["content"]):
                if path is None:
                    rows.append((asset, False, False, None))
                    continue
                # The task's own scratch file, gone when the tool has run.
                with tempfile.NamedTemporaryFile(suffix=Path(name or "x").suffix) as f:
                    f.write(content or b"")
                    f.flush()
                    try:
                        done = subprocess.run([path, *(f.name if a == "{}" else a for a in command[1:])], capture_output=True, timeout=seconds)
                        rows.append((asset, True, done.returncode == 0, done.stdout[:MOST_OUTPUT].decode("utf-8", "replace")))
                    except (subprocess.TimeoutExpired, OSError):
                        rows.append((asset, True, False, None))
            yield pd.DataFrame(rows, columns=["asset_id", "available", "ok", "output"])

    return over


def output(files: DataFrame, tool: str) -> DataFrame:
    """A row a file: whether the tool is there, whether it succeeded, and what it wrote."""
    return files.select("asset_id", "name", "content").mapInPandas(run(tool), OUT)


def needs_ocr(text: Column) -> Column:
    """A PDF's text layer is too thin to read."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < 120


FLAT = "asset_id string, fields map<string,string>"


def flattened(rows: DataFrame, json: str = "meta", most: int = 160) -> DataFrame:
    """asset_id, fields: nested metadata as dotted names, `most` at most; a description stands for its object."""
    import json as J

    def walk(value, name: str, out: dict) -> None:
        if isinstance(value, dict):
            if "description" in value and name:
                out.setdefault(name, str(value["description"]))
                return
            for k, v in value.items():
                if len(out) >= most:
                    return
                walk(v, f"{name}.{k}" if name else str(k), out)
        elif isinstance(value, (str, int, float, bool)):
            out.setdefault(name, str(value))

    def over(batches):
        for frame in batches:
            maps = []
            for text in frame[json]:
                fields: dict = {}
                try:
                    walk(J.loads(text or "{}"), "", fields)
                except (ValueError, RecursionError):
                    pass
                maps.append(fields)
            yield pd.DataFrame({"asset_id": frame["asset_id"], "fields": maps})

    return rows.select("asset_id", json).mapInPandas(over, FLAT)
