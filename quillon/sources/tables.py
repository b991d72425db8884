"""Sources and sinks: CSV with long quoted texts, the SQL store, Parquet, JSON
manifests, LaTeX tables, and rows fit for a spreadsheet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import HEAVY


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields may hold line ends and doubled quotes; the schema is given,
    so no pass over the data infers it."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_store(spark: SparkSession, url: str, name: str, columns: list[str] | None = None, where: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a SQL store over JDBC. Projections and filters reach the
    database; ``partition`` (column, low, high, parts) reads it in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition:
        column, low, high, parts = partition
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    df = r.load()
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content and its digest: parsers take it from here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).withColumn("sha256", F.sha2("content", 256))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """``one_file`` is for exports people open; large tables stay in parts."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def dump(df: DataFrame, with_heavy: bool = False) -> DataFrame:
    return df if with_heavy else df.drop(*HEAVY)


# What a sheet can hold.
SHEET_ROWS, CELL_CHARS, SHEET_NAME = 1_048_575, 32_767, 31


def for_sheet(df: DataFrame, mark: str = " [cut]") -> DataFrame:
    """Rows and texts that fit a sheet; cut cells say so. The first rows by all
    columns stay, so that reruns agree."""
    texts = [c for c, t in df.dtypes if t == "string"]
    cut = {c: F.when(F.length(c) > CELL_CHARS, F.concat(F.substring(c, 1, CELL_CHARS - len(mark)), F.lit(mark))).otherwise(F.col(c)) for c in texts}
    return df.orderBy(*df.columns).limit(SHEET_ROWS).withColumns(cut)


def sheet_name(name: str) -> str:
    return "".join("_" if c in "[]:*?/\\" else c for c in name)[:SHEET_NAME]


def manifest(df: DataFrame, **facts) -> str:
    """JSON of the schema, the row count and other facts."""
    return json.dumps({"columns": dict(df.dtypes), "rows": df.count(), **facts}, indent=2, ensure_ascii=False, sort_keys=True)


# Characters that LaTeX reserves, and how they are written.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(s: object) -> str:
    return "".join(LATEX.get(c, c) for c in str(s))


def latex_table(df: DataFrame, caption: str, label: str, notes: str = "", digits: int = 3, panel: str | None = None, most: int = 500) -> str:
    """A booktabs table of a small result; ``panel`` names a column that heads
    groups of rows. More than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows don't make a table")
    columns = [c for c in df.columns if c != panel]
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else latex_escape(v)
    out = [r"\begin{table}", f"\\caption{{{latex_escape(caption)}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", " & ".join(map(latex_escape, columns)) + r" \\", r"\midrule"]
    last = object()
    for r in rows:
        if panel and r[panel] != last:
            last = r[panel]
            out.append(f"\\multicolumn{{{len(columns)}}}{{l}}{{\\textit{{{latex_escape(last)}}}}} \\\\")
        out.append(" & ".join(show(r[c]) for c in columns) + r" \\")
    return "\n".join([*out, r"\bottomrule", r"\end{tabular}", *([latex_escape(notes)] if notes else []), r"\end{table}"])


def best_source(counts: dict[str, dict[str, int]], expected: dict[str, int], tolerance: float = 0.01) -> str:
    """Of candidate stores the one whose counts all match; otherwise an error."""
    score = {s: sum(abs(c.get(k, 0) - e) <= tolerance * e for k, e in expected.items()) for s, c in counts.items()}
    best = max(sorted(score), key=score.get, default=None)
    if best is None or score[best] < len(expected):
        raise ValueError(f"no source matches: {score}")
    return best
