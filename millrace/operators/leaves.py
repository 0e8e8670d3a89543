"""Sheets as leaves (path, value), and leaves of a gold sheet aligned with those of predictions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .evaluation import value_status
from .layout import fill_forward


def empty_cell(c: Column) -> Column:
    return c.isNull() | F.lower(X.strip(c.cast("string"))).isin("", "nan", "none", "null")


def key_piece(c: Column) -> Column:
    """A part of a path: lower case, letters and digits, joined by underscores."""
    t = F.replace(F.regexp_replace(X.strip(c), r"\s+", " "), F.lit("&"), F.lit("and"))
    return F.lower(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def _path(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*(F.when(~empty_cell(p), key_piece(p)) for p in parts)), lambda p: p.isNotNull() & (p != "")), ".")


def grouped_sheet(sheet: DataFrame, row_no: str, columns: tuple[str, str, str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row_no, path, value) of a sheet of section, group, key and value columns, of which section and group stand in
    the first of their rows only. A row with key and value is section.group.key; one with its own group and a key only is
    section.group, with the key as its value; others are no leaves."""
    section, group, key, value = columns
    filled = fill_forward(sheet.withColumn("_own", F.col(group)), row_no, [section, group], by)
    own, k, v = F.col("_own"), F.col(key), F.col(value)
    deep, flat = ~empty_cell(k) & ~empty_cell(v), ~empty_cell(own) & ~empty_cell(k)
    path = F.when(deep, _path(F.col(section), F.col(group), k)).when(flat, _path(F.col(section), own))
    return filled.where(deep | flat).select(*by, row_no, path.alias("path"), F.when(deep, v).otherwise(k).alias("value"))


def flat_sheet(sheet: DataFrame, row_no: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row_no, path, value) of a sheet with the columns Path and Value, whose underscores part the path, or with level
    columns L1, L2, ... and Value. Rows without a path are no leaves; an empty value is the empty text."""
    value = F.when(empty_cell(F.col("Value")), "").otherwise(F.col("Value"))
    if "Path" in sheet.columns:
        path = F.replace(key_piece(F.col("Path")), F.lit("_"), F.lit("."))
        return sheet.where(~empty_cell(F.col("Path"))).select(*by, row_no, path.alias("path"), value.alias("value"))
    levels = sorted((c for c in sheet.columns if re.fullmatch(r"[lL]\d+", c)), key=lambda c: int(c[1:]))
    return sheet.select(*by, row_no, _path(*(F.col(c) for c in levels)).alias("path"), value.alias("value")).where("path <> ''")


def signature(path: str) -> str:
    """The words of a path, each once, in order of the alphabet."""
    parts = (re.sub(r"_+", "_", re.sub("[^A-Za-z0-9]+", "_", t.replace("&", "and"))).strip("_").lower() for t in re.split(r"[.\[\]_/:\-()\s]+", path or ""))
    return "|".join(sorted({p for p in parts if p}))


def _loose(v: str | None) -> str:
    return re.sub("[^a-z0-9]", "", (v or "").lower())


def best_matches(gold: list[tuple[str, str | None]], got: list[tuple[str, str | None]]) -> list[int | None]:
    """For each gold leaf in order the number of the predicted leaf that it is aligned with.

    Candidates have the same path, or else the signature of the gold path's last part (of the whole if that is empty) as
    that of their whole path, last part or last two parts. An equal path counts 4, an equal value 2, a use before -0.25,
    and every 2000 characters of difference in length -1; of equal scores the first."""
    exact: dict[str, list[int]] = {}
    signed: dict[str, list[int]] = {}
    for i, (path, _) in enumerate(got):
        p = (path or "").strip()
        if p:
            exact.setdefault(p, []).append(i)
        parts = [x for x in (path or "").split(".") if x]
        for s in {signature(path or ""), *(signature(".".join(parts[-n:])) for n in (1, 2) if len(parts) >= n)}:
            if s:
                signed.setdefault(s, []).append(i)
    used: set[int] = set()
    out: list[int | None] = []
    for path, value in gold:
        key = (path or "").strip()
        near = exact.get(key) or signed.get(signature(key.rpartition(".")[2]) or signature(key), [])
        best, top = None, None
        for i in near:
            p, v = got[i][0] or "", got[i][1]
            score = 4.0 * (p.strip() == key) + 2.0 * (bool((v or "").strip()) and _loose(v) == _loose(value)) - 0.25 * (i in used) - abs(len(p) - len(key)) / 2000
            if top is None or score > top:
                best, top = i, score
        if best is not None:
            used.add(best)
        out.append(best)
    return out


def align(gold: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, path, value, predicted_path, predicted_value, status) of every gold leaf (key, place, path, value) with
    the predicted leaf that `best_matches` gives; status MISSING_KEY without one, else as `value_status`. The leaves of one
    document meet in one task: they are as many as the document has; documents are spread."""
    kind = gold.schema[key].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("place", kind="stable"), b.sort_values("place", kind="stable")
        clean = lambda v: None if v is None or v != v else v
        mine = [(clean(p), clean(v)) for p, v in zip(a["path"], a["value"])]
        theirs = [(clean(p), clean(v)) for p, v in zip(b["path"], b["value"])]
        hits = best_matches(mine, theirs)
        return pd.DataFrame({key: a[key].tolist(), "place": a["place"].tolist(), "path": [p for p, _ in mine], "value": [v for _, v in mine], "predicted_path": [None if h is None else theirs[h][0] for h in hits], "predicted_value": [None if h is None else theirs[h][1] for h in hits], "_hit": [h is not None for h in hits]})

    cols = [key, "place", "path", "value"]
    t = gold.select(*cols).groupBy(key).cogroup(predicted.select(*cols).groupBy(key)).applyInPandas(run, f"{key} {kind}, place {gold.schema['place'].dataType.simpleString()}, path string, value string, predicted_path string, predicted_value string, _hit boolean")
    status = F.when(~F.col("_hit"), "MISSING_KEY").otherwise(value_status(F.col("path"), F.col("value"), F.col("predicted_value")))
    return t.withColumn("status", status).drop("_hit")


def align_three(gold: DataFrame, first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """Gold leaves with those of two predictions, each aligned by itself."""
    a, b = align(gold, first, key), align(gold, second, key)
    one = a.withColumnsRenamed({"predicted_path": "first_path", "predicted_value": "first_value", "status": "first_status"})
    two = b.select(key, "place", F.col("predicted_path").alias("second_path"), F.col("predicted_value").alias("second_value"), F.col("status").alias("second_status"))
    return one.join(two, [key, "place"])
