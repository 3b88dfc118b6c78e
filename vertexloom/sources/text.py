"""Text readers: edge lists, DIMACS-9, METIS, LDBC vertex and edge files.

All read lines through Spark, so any file system and compressed files work and large files are
split; METIS needs the number of a line, which is counted over the splits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.files import only_last, stored
from vertexloom.operators.algebra import integer_weight, real_weight

# Formats by extension.
FORMATS = {
    "properties": "ldbc", "log": "log", "glog": "log", "graphlog": "log", "el": "plain", "wel": "weighted",
    "metis": "metis", "graph": "metis", "gr": "dimacs9", "dimacs": "dimacs9", "dimacs9": "dimacs9",
}
MAX_ID = "9223372036854775807"


def format_of(path: str) -> str:
    """A file's format by its extension, in either case."""
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension not in FORMATS:
        raise ValueError(f"unknown format: {path}")
    return FORMATS[extension]


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    """Lines that are neither blank nor comments, cut into words; blanks before are allowed."""
    line = F.trim(F.regexp_replace("value", r"[\s]+", " "))
    rows = spark.read.text(path).select(line.alias("line"))
    return rows.where((F.col("line") != "") & ~F.startswith("line", F.lit(comment))).select(F.split("line", " ").alias("w"))


def _long(word: Column) -> Column:
    """A word as a long; one that is no number or too large stops the job."""
    return word.cast("long")


def read_plain(spark: SparkSession, path: str, max_weight: int = 1, seed: int = 97) -> DataFrame:
    """``src dst`` per line; what follows is ignored. Weights are made: 1, or integers from 1 to ``max_weight``."""
    edges = _lines(spark, path, "#").select(_long(F.get("w", F.lit(0))).alias("src"), _long(F.get("w", F.lit(1))).alias("dst"))
    return edges.withColumn("weight", integer_weight(seed, max_weight))


def read_weighted(spark: SparkSession, path: str, lossy_weights: bool = False) -> DataFrame:
    """``src dst weight`` per line; ``lossy_weights`` drops the weights' fractions."""
    weight = F.get("w", F.lit(2)).cast("double")
    return _lines(spark, path, "#").select(
        _long(F.get("w", F.lit(0))).alias("src"),
        _long(F.get("w", F.lit(1))).alias("dst"),
        (F.floor(weight).cast("double") if lossy_weights else weight).alias("weight"),
    )


def read_dimacs9(spark: SparkSession, path: str) -> DataFrame:
    """``a src dst weight`` per line; lines that start otherwise, with blanks too, are skipped."""
    words = spark.read.text(path).where(F.col("value").rlike(r"^a\s")).select(F.split(F.trim("value"), r"\s+").alias("w"))
    return words.select(
        _long(F.get("w", F.lit(1))).alias("src"), _long(F.get("w", F.lit(2))).alias("dst"), F.get("w", F.lit(3)).cast("double").alias("weight")
    )


def numbered_lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    """``(number, line)``: lines of a file, or of a folder's files by name, without comments, from 0 on.

    Files are read in splits; a line's number is its place in its split, raised by the lines of the splits before.
    So lines are written once and not sorted.
    """
    rows = spark.read.text(path).select(
        F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    rows = stored(rows.where(~F.startswith("line", F.lit(comment))).withColumn("row", F.monotonically_increasing_id()))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))  # a row per split
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("raised"))
    return rows.join(F.broadcast(splits), ["file", "block"]).select((F.col("row") + F.col("raised")).alias("number"), "line")


def read_metis(spark: SparkSession, path: str, max_weight: int = 1, seed: int = 97) -> DataFrame:
    """Arcs of an adjacency file; line k lists the neighbours of vertex k.

    The header is ``V E [fmt [ncon]]`` with the digits vertex size, vertex weights, edge weights. An
    empty line is a vertex without neighbours. Vertex sizes and weights are skipped. Edge weights are
    1 without a format field, as written where it has them, else integers that are made.
    """
    with only_last():
        lines = numbered_lines(spark, path, "%")
        first = lines.where("line <> ''").orderBy("number").first()
        if first is None:
            return spark.createDataFrame([], "src long, dst long, weight double")
        head = first["line"].split()
        vertices, fmt = int(head[0]), (head[2] if len(head) > 2 else "").zfill(3)
        skip, weighted = int(fmt[0]) + (int(head[3]) if len(head) > 3 else 1) * int(fmt[1]), fmt[2] == "1"
        body = lines.select((F.col("number") - first["number"]).alias("src"), "line").where("src > 0 and line <> ''")
        if body.where(F.col("src") > vertices).limit(1).count():
            raise ValueError("more adjacency lines than vertices")
        words, last = F.col("words"), F.size("words") - 1
        # The places of the neighbours among the words; a row is made for each, without the line. Outer, as else Spark
        # filters by the array's size and cuts the line anew for each of its words.
        places = F.when(last >= skip, F.sequence(F.lit(skip), last, F.lit(2 if weighted else 1)))
        weight = (lambda i: F.get(words, i + 1)) if weighted else (lambda i: F.lit(None).cast("string"))
        found = body.select("src", F.split("line", " ").alias("words")).select("src", F.transform(places, lambda i: F.struct(F.get(words, i).alias("dst"), weight(i).alias("w"))).alias("found"))
        arcs = stored(found.select("src", F.inline_outer("found")).where("dst is not null").select("src", _long(F.col("dst")).alias("dst"), F.col("w").cast("long").alias("w")))
        if weighted and arcs.where("w is null or w > 2147483647").limit(1).count():
            raise ValueError("a weight is missing or too large")
    if weighted:
        return arcs.select("src", "dst", F.col("w").cast("double").alias("weight"))
    return arcs.select("src", "dst").withColumn("weight", F.lit(1.0) if len(head) <= 2 else integer_weight(seed, max_weight))


def read_ldbc_vertices(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, "#").select(_long(F.get("w", F.lit(0))).alias("id"))


def read_ldbc_edges(spark: SparkSession, path: str, weighted: bool = True, max_weight: float = 1.0, seed: int = 97) -> DataFrame:
    """``src dst [weight]`` per line; without weights they are made, over 0 and up to ``max_weight``."""
    w = _lines(spark, path, "#")
    edges = w.select(_long(F.get("w", F.lit(0))).alias("src"), _long(F.get("w", F.lit(1))).alias("dst"), F.get("w", F.lit(2)).cast("double").alias("weight"))
    return edges if weighted else edges.withColumn("weight", real_weight(seed, max_weight))


_PROPERTY = re.compile(r"\s*graph\.([^.\s]+)\.([^\s=#]+)\s*=\s*([^#]*?)\s*")


def parse_properties(text: str) -> dict[str, str]:
    """``key: value`` of the lines ``graph.<name>.<key> = <value>``; a line with anything else, or a ``#``, is skipped."""
    found = (_PROPERTY.fullmatch(line) for line in text.split("\n"))
    return {m[2]: m[3] for m in found if m}


def read_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """A dataset's properties, with file names resolved against the folder; a small file read whole.

    Lines of another graph than the one that the file is named for are skipped, unless all are: then
    the name does not matter.
    """
    row = spark.read.text(path, wholetext=True).first()
    text = row["value"] if row else ""
    name = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    own = "\n".join(line for line in text.split("\n") if line.strip().startswith(f"graph.{name}."))
    found = parse_properties(own) or parse_properties(text)
    for key in ("vertex-file", "edge-file"):
        if key in found and "/" not in found[key]:
            found[key] = path.rpartition("/")[0] + "/" + found[key]
    if found.get("compression", "zlib") != "zlib":
        raise ValueError(f"unknown compression: {found['compression']}")
    return found


# Kernels as a property file names them.
ALGORITHMS = {"bfs": "bfs", "cdlp": "cdlp", "lcc": "lcc", "pr": "pagerank", "sssp": "sssp", "wcc": "wcc"}


def kernel_parameters(properties: dict[str, str]) -> dict[str, dict]:
    """Each kernel that a dataset asks for, with its own parameters; without a list all that its properties allow.

    A list with BFS but not SSSP has SSSP too, from the same source: every graph has weights here, made
    ones if need be.
    """
    listed = [w.strip().lower() for w in properties.get("algorithms", "").split(",") if w.strip()]
    if unknown := set(listed) - set(ALGORITHMS):
        raise ValueError(f"unknown algorithms: {sorted(unknown)}")
    # Keys of a property file, by kernel.
    found: dict[str, dict] = {}
    for name, kernel in ALGORITHMS.items():
        own = {}
        if kernel in ("bfs", "sssp"):
            if f"{name}.source-vertex" in properties:
                own["source"] = int(properties[f"{name}.source-vertex"])
        elif kernel == "cdlp":
            own["iterations"] = int(properties.get("cdlp.max-iterations", 10))
        elif kernel == "pagerank":
            own["iterations"] = int(properties.get("pr.num-iterations", 10))
            own["damping"] = float(properties.get("pr.damping-factor", 0.85))
        if name in listed or not listed:
            if kernel in ("bfs", "sssp") and not own:
                if name in listed:
                    raise ValueError(f"{name}.source-vertex is missing")
                continue
            found[kernel] = own
    if "bfs" in found and "sssp" not in found:
        found["sssp"] = dict(found["bfs"])
    return found


def is_directed(properties: dict[str, str]) -> bool:
    value = properties.get("directed", "").lower()
    if value not in ("yes", "true", "1", "no", "false", "0"):
        raise ValueError(f"directed: {value!r}")
    return value in ("yes", "true", "1")
