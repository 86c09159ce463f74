"""What a run writes, and how it is read again."""

from __future__ import annotations

import html
import json
import os
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder of CSV files with headers, sorted across them; list columns as text."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines."""
    df.write.mode("overwrite").json(path)


def save_graph(iso: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables."""
    iso.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(isolates, edges) as saved, from the folder of save_graph or from GraphML."""
    if path.rstrip("/").endswith(".graphml"):
        return load_graphml(spark, path)
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


_GRAPHML = {"int": "int", "bigint": "long", "double": "double", "boolean": "boolean"}
_TYPES = {"int": "int", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean"}


def _escaped(c: Column) -> Column:
    text = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _elements(df: DataFrame, kind: str, ends: dict[str, str]) -> DataFrame:
    """One line an element: its ends as attributes, its other columns that aren't null as data."""
    head = F.concat(F.lit(f"<{kind}"), *[x for name, c in ends.items() for x in (F.lit(f' {name}="'), _escaped(F.col(c)), F.lit('"'))], F.lit(">"))
    data = [F.coalesce(F.concat(F.lit(f'<data key="{kind[0]}_{c}">'), _escaped(F.col(c)), F.lit("</data>")), F.lit("")) for c in df.columns if c not in ends.values()]
    return df.select(F.concat(head, *data, F.lit(f"</{kind}>")).alias("value"))


def write_graphml(iso: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> None:
    """A folder of text files which, one after the other in the order of their names, are one GraphML document.

    Every task writes its own lines; only the head and the end come from the driver.
    """
    spark = iso.sparkSession
    keys = [f'<key id="{kind[0]}_{c}" for="{kind}" attr.name="{c}" attr.type="{_GRAPHML.get(t, "string")}"/>' for kind, df, ends in (("node", iso, ["isolate_id"]), ("edge", edges, ["src", "dst"])) for c, t in df.dtypes if c not in ends]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, f'<graph edgedefault="{"directed" if directed else "undirected"}">']
    lines = lambda *text: spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1)
    lines(*head).write.mode("overwrite").text(f"{path}/1-head")
    _elements(iso, "node", {"id": "isolate_id"}).write.mode("overwrite").text(f"{path}/2-nodes")
    _elements(edges, "edge", {"source": "src", "target": "dst"}).write.mode("overwrite").text(f"{path}/3-edges")
    lines("</graph>", "</graphml>").write.mode("overwrite").text(f"{path}/4-end")


def _plain(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _found(text: Column, pattern: str) -> Column:
    """What the pattern's group holds, or null where it does not match."""
    return F.when(text.rlike(pattern), _plain(F.regexp_extract(text, pattern, 1)))


def load_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(isolates, edges) of a GraphML file or of a folder as write_graphml leaves it; columns have the types of its keys.

    Elements are cut at their opening tags, so they may span lines or close themselves. A file of another tool is taken as
    it is; what follows its last node must fit a task.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/1-head")
    own = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def elements(tag: str, part: str) -> DataFrame:
        text = spark.read.option("lineSep", f"<{tag}").text(f"{path}/{part}" if own else path)
        return text.filter(F.col("value").rlike(r"^\s")).select(F.regexp_extract("value", r"^([^>]*)>", 1).alias("tag"), F.regexp_extract("value", rf"(?s)^[^>]*[^/]>(.*?)</{tag}>", 1).alias("body"))

    attribute = lambda name: _found(F.col("tag"), rf'(?:^|\s){name}\s*=\s*"([^"]*)"')
    keys = elements("key", "1-head").select(attribute("id").alias("id"), attribute(r"attr\.name").alias("name"), attribute(r"attr\.type").alias("type"), attribute("for").alias("kind")).collect()  # one a column

    def columns(kind: str) -> list[Column]:
        data = lambda key: _found(F.col("body"), rf'(?s)<data key="\Q{key}\E">(.*?)</data>')
        return [data(k["id"]).cast(_TYPES.get(k["type"], "string")).alias(k["name"]) for k in keys if k["kind"] in (kind, "all")]

    nodes = elements("node", "2-nodes").select(attribute("id").alias("isolate_id"), *columns("node"))
    return nodes, elements("edge", "3-edges").select(attribute("source").alias("src"), attribute("target").alias("dst"), *columns("edge"))


def cache_key(seqs: DataFrame) -> str:
    """Sixteen hexadecimal digits that name the sequences' content, whatever their order."""
    one = seqs.select(F.sha2(F.concat_ws("\u0001", "isolate_id", "seq"), 256).alias("h"))
    sums = one.select(*[F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)]).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(4)], F.count("*").alias("n"))
    return sums.select(F.substring(F.sha2(F.concat_ws(",", "p0", "p1", "p2", "p3", "n"), 256), 1, 16).alias("k")).first()["k"]


def cached_distances(spark: SparkSession, seqs: DataFrame, folder: str, compute) -> DataFrame:
    """compute(seqs), written under the content's key and read from there the next time."""
    path = f"{folder}/{cache_key(seqs)}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    compute(seqs).write.parquet(path)
    return spark.read.parquet(path)


def table_html(rows: Iterable, columns: list[str], limit: int = 200) -> str:
    """An HTML table of at most limit rows, with a note where there are more."""
    rows = list(rows)
    cell = lambda v: html.escape(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows[:limit])
    return f"<table><tr>{head}</tr>{body}</table>" + (f"<p>The first {limit} rows.</p>" if len(rows) > limit else "")


def timeline_svg(bands: list, limit: int = 60) -> str:
    """Bars of the first clusters over time, at most limit of them, with a note where there are more."""
    more = f"<p>The first {limit} clusters.</p>" if len(bands) > limit else ""
    bands = bands[:limit]
    if not bands:
        return ""
    low, high = min(b["first_day"] for b in bands), max(b["last_day"] for b in bands)
    scale = 700 / max(1, (high - low).days)
    bars = "".join(f'<rect x="{100 + (b["first_day"] - low).days * scale:.1f}" y="{i * 16 + 3}" width="{max(2, (b["last_day"] - b["first_day"]).days * scale):.1f}" height="10" fill="#4477aa"/><text x="4" y="{i * 16 + 12}" font-size="10">{html.escape(str(b["cluster_id"]))} ({b["n_isolates"]})</text>' for i, b in enumerate(bands))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="820" height="{16 * len(bands) + 8}">{bars}</svg>{more}'


def write_report(path: str, title: str, kpi: dict, sections: list[tuple[str, str]]) -> None:
    """One self-contained HTML page."""
    tiles = "".join(f"<li><b>{html.escape(str(v))}</b> {html.escape(k.replace('_', ' '))}</li>" for k, v in kpi.items())
    parts = "".join(f"<h2>{html.escape(h)}</h2>{body}" for h, body in sections)
    page = f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style></head><body><h1>{html.escape(title)}</h1><ul>{tiles}</ul>{parts}</body></html>'
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)


def zip_results(folder: str, path: str) -> None:
    """All files of a run in one archive."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(folder):
            for name in sorted(files):
                full = os.path.join(at, name)
                if os.path.abspath(full) != os.path.abspath(path):
                    z.write(full, os.path.relpath(full, folder))


def dump_json(value, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=str)
