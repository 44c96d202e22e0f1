"""Trajectories from JSON lists, JSON lines and CSV rows with points, and their segments.

Files are split into their top-level elements as a stream, one task a file and one
element in memory, so that a file may be of any size. What can't be read becomes a row
with its problem, never nothing: `problems` lists them, and readers can refuse them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = "array<array<double>>"
ELEMENTS = "file string, file_key string, ordinal long, element string, problem string"
#: The names that trajectories given as objects may use.
LISTS, PATHS, GPS = ("trajectories", "data"), ("node_path", "road_node_path", "nodes"), ("points", "gps_points", "points_data")


def natural_key(column):
    """Text that sorts names with their digit runs as numbers of any length: a run is preceded by its length without zeros.

    Letters compare in lower case; a run's length is written as a letter for up to 25 digits, then as further ones.
    """
    parts = F.regexp_extract_all(F.lower(F.col(column)), F.lit("([0-9]+|[^0-9]+)"), 1)
    plain = lambda p: F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0"))
    size = lambda p: F.concat(F.repeat(F.lit("9"), F.floor(F.length(plain(p)) / 9).cast("int")), (F.length(plain(p)) % 9).cast("string"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), size(p), F.lit(":"), plain(p))).otherwise(p)), "\u0000")


def elements(pieces: Iterator[str]) -> Iterator[tuple[str | None, str | None]]:
    """(element, problem) of a JSON text: the members of a top-level list, or one object; brackets left over at the end are ignored."""
    decoder, held, inside, first = json.JSONDecoder(), "", False, True
    start = re.compile(r"[\s,]*")
    done = False
    for piece in pieces:
        held += piece
        while True:
            held = held[start.match(held).end() :] if inside else held.lstrip("﻿ \t\r\n")
            if not held:
                break
            if done:
                if held.strip("] \t\r\n"):
                    yield None, "text after the list"
                    return
                held = ""
                break
            if first and not inside:
                if held[0] == "[":
                    inside, first, held = True, False, held[1:]
                    continue
                break  # an object, read as a whole below
            if held[0] == "]":
                done, inside, held = True, False, held[1:]
                continue
            try:
                _, end = decoder.raw_decode(held)
            except json.JSONDecodeError:
                end = literal_end(held)
                if end is None:
                    break
            if end == len(held) and held[-1] not in "]}\"":
                break  # a number may go on in the next piece
            yield held[:end], None
            held = held[end:]
    if first and held.strip():
        yield from whole(held)
    elif not done and (inside or held.strip()):
        yield None, "the list is cut short" if inside else "not JSON"


def literal_end(text: str) -> int | None:
    """Where a bracketed literal ends that isn't JSON (single quotes, tuples); None if not within the text."""
    if text[0] not in "[({":
        return None
    depth, quote, at = 0, "", 0
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in "[({":
            depth += 1
        elif c in "])}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return None


def whole(text: str) -> Iterator[tuple[str | None, str | None]]:
    """The trajectories of a top-level object: those of its list, or itself."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        yield None, f"not JSON: {e.msg}"
        return
    listed = next((found[k] for k in LISTS if isinstance(found, dict) and isinstance(found.get(k), list)), [found])
    for x in listed:
        yield json.dumps(x), None


def _splitter(batches):
    schema = pa.schema([("file", pa.string()), ("file_key", pa.string()), ("ordinal", pa.int64()), ("element", pa.string()), ("problem", pa.string())])
    for batch in batches:
        for path, name, key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            files, own = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
            with files.open_input_stream(own) as stream:

                def pieces(stream=stream) -> Iterator[str]:
                    import codecs

                    decode = codecs.getincrementaldecoder("utf-8")()
                    while data := stream.read(1 << 20):
                        yield decode.decode(data)
                    yield decode.decode(b"", True)

                if name.lower().endswith(".jsonl"):
                    rows = lines(pieces())
                else:
                    rows = elements(pieces())
                held, size = [], 0
                try:
                    for ordinal, (element, problem) in enumerate(rows):
                        held.append((name, key, ordinal, element, problem))
                        size += len(element or "")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)
                            held, size = [], 0
                except UnicodeDecodeError:
                    held.append((name, key, -1, None, "not UTF-8"))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)


def lines(pieces: Iterator[str]) -> Iterator[tuple[str | None, str | None]]:
    held = ""
    for piece in pieces:
        *full, held = (held + piece).split("\n")
        yield from ((x, None) for x in full if x.strip())
    if held.strip():
        yield held, None


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, file_key (natural order), ordinal in the file, element (JSON text) and problem of .json and .jsonl files."""
    names = spark.read.format("binaryFile").load(path).select("path").where(F.lower("path").rlike(r"\.jsonl?$"))
    named = names.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
    return named.select("path", "file", natural_key("file").alias("file_key")).mapInArrow(_splitter, ELEMENTS)


def count_elements(spark: SparkSession, path: str) -> DataFrame:
    """file and n: top-level elements, none of which is parsed further."""
    return read_elements(spark, path).where("problem is null").groupBy("file").agg(F.count("*").alias("n"))


def as_json(column):
    """A literal with single quotes, tuples and Python's constants as JSON."""
    out = F.translate(F.col(column), "()'", '[]"')
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.regexp_replace(out, r",\s*\]", "]")


def read_city_json(spark: SparkSession, path: str, *, refuse: bool = False) -> DataFrame:
    """file, file_key, ordinal, node_path, pairs (u, v of each edge), groups of points [ts, lat, lon] for each edge, problem.

    A trajectory is a list [node path, edge pairs, point groups, ...], or an object with a node
    path and points, whose points are one group, [ts, lat, lon] or [node, lon, lat, ts] each; an
    object may also hold it under "trajectory" or "data". Literals that aren't JSON are tried as
    such. refuse raises if any element has a problem.
    """
    rows = read_elements(spark, path)
    listed = lambda x: F.from_json(x, "array<string>")
    text = F.when(listed("element").isNull() & F.from_json("element", "map<string,string>").isNull(), as_json("element")).otherwise(F.col("element"))
    rows = rows.withColumn("element", text).withColumn("o", F.from_json("element", "map<string,string>"))
    held = F.coalesce(F.col("o")["trajectory"], F.col("o")["data"])
    rows = rows.withColumn("t", F.coalesce(listed("element"), listed(held)))
    first = lambda names: F.coalesce(*[F.col("o")[n] for n in names])
    own = F.from_json(first(GPS), POINTS)
    turned = F.transform(own, lambda p: F.when(F.size(p) >= 4, F.array(p[3], p[2], p[1])).otherwise(F.slice(p, 1, 3)))
    is_list = F.col("t").isNotNull()
    rows = rows.withColumn("node_path", F.from_json(F.when(is_list, F.get("t", F.lit(0))).otherwise(first(PATHS)), "array<bigint>"))
    rows = rows.withColumn("pairs", F.when(is_list, F.from_json(F.get("t", F.lit(1)), "array<array<bigint>>")))
    rows = rows.withColumn("groups", F.when(is_list, F.from_json(F.get("t", F.lit(2)), "array<array<array<double>>>")).otherwise(F.array(turned)))
    points = F.flatten("groups")
    wrong = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.coalesce(F.size("node_path"), F.lit(0)) <= 0, "no node path").when(F.coalesce(F.size(points), F.lit(0)) <= 0, "no points")
    wrong = wrong.when(F.exists(points, lambda p: (F.size(p) < 3) | p[0].isNull() | p[1].isNull() | p[2].isNull()), "a point lacks a value")
    out = rows.select("file", "file_key", "ordinal", "node_path", "pairs", "groups", wrong.alias("problem"))
    if refuse and (bad := problems(out).first()):
        raise ValueError(f"{bad['file']}, element {bad['ordinal']}: {bad['problem']}")
    return out


def problems(rows: DataFrame) -> DataFrame:
    """The rejected rows of a reader."""
    return rows.where("problem is not null")


def unordered(points: DataFrame) -> DataFrame:
    """Rows of points (tid, pos, ts) that lie before the one ahead of them in time."""
    before = F.lag("ts").over(Window.partitionBy("tid").orderBy("pos"))
    return points.withColumn("before", before).where("before > ts")


def read_points_csv(spark: SparkSession, path: str, *, refuse: bool = False) -> DataFrame:
    """source_traj_id, points [node, lon, lat, ts], problem of a CSV with these columns, source_traj_id and points_data.

    A row with an empty or repeated id, with points that can't be read or decrease in time, or with
    none has a problem. Rows of one point are whole; segments drop them.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    key = next((c for c in rows.columns if c.lstrip("﻿") in ("source_traj_id", "traj_id")), None)
    if key is None or "points_data" not in rows.columns:
        raise ValueError(f"a CSV of points needs source_traj_id and points_data, not {', '.join(rows.columns)}")
    rows = rows.select(F.trim(F.col(f"`{key}`")).alias("source_traj_id"), "points_data")
    parsed = F.coalesce(F.from_json("points_data", POINTS), F.from_json(as_json("points_data"), POINTS))
    rows = rows.withColumn("points", parsed)
    twice = F.count("*").over(Window.partitionBy("source_traj_id")) > 1
    falls = F.exists(F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: b[3] < a[3]), lambda x: x)
    wrong = F.when(F.coalesce("source_traj_id", F.lit("")) == "", "no id").when(twice, "an id given twice").when(F.col("points").isNull(), "points that can't be read").when(F.size("points") == 0, "no points")
    wrong = wrong.when(F.exists("points", lambda p: F.size(p) < 4), "a point lacks a value").when(falls, "times decrease")
    out = rows.select("source_traj_id", "points", wrong.alias("problem"))
    if refuse and (bad := problems(out).first()):
        raise ValueError(f"{bad['source_traj_id']}: {bad['problem']}")
    return out


def csv_segments(rows: DataFrame) -> DataFrame:
    """source_traj_id, seq, u, v, start_ts, end_ts of moves between different nodes, of rows without a problem."""
    rows = rows.where("problem is null") if "problem" in rows.columns else rows
    p = rows.select("source_traj_id", F.posexplode("points").alias("seq", "p")).selectExpr("source_traj_id", "seq", "cast(p[0] as bigint) u", "cast(p[3] as bigint) start_ts")
    own = Window.partitionBy("source_traj_id").orderBy("seq")
    p = p.withColumn("v", F.lead("u").over(own)).withColumn("end_ts", F.lead("start_ts").over(own))
    return p.where("v is not null and u <> v").select("source_traj_id", "seq", "u", "v", "start_ts", "end_ts")


def csv_counters(rows: DataFrame) -> DataFrame:
    """One row: trajectories, those of fewer than two points, those that never move, stationary pairs, kept pairs, first and last time."""
    good = rows.where("problem is null")
    pairs = F.expr("zip_with(slice(points, 1, greatest(size(points) - 1, 0)), slice(points, 2, greatest(size(points) - 1, 0)), (a, b) -> a[0] <> b[0])")
    good = good.select(F.size("points").alias("n"), F.size(F.filter(pairs, lambda x: x)).alias("moves"), F.size(pairs).alias("pairs"), F.element_at("points", 1)[3].alias("lo"), F.element_at("points", -1)[3].alias("hi"))
    return good.agg(F.count("*").alias("n_trajectories"), F.count_if(F.col("n") < 2).alias("n_short"), F.count_if((F.col("n") >= 2) & (F.col("moves") == 0)).alias("n_without_movement"), F.sum(F.col("pairs") - F.col("moves")).alias("n_stationary"), F.sum("moves").alias("n_segments"), F.min("lo").cast("long").alias("first_ts"), F.max("hi").cast("long").alias("last_ts"))


def city_segments(rows: DataFrame) -> DataFrame:
    """file, ordinal, seq, u, v, start_ts, end_ts: a segment starts where the one before ends. Rows with a problem are left out."""
    rows = rows.where("problem is null and pairs is not null") if "problem" in rows.columns else rows
    g = rows.select("file", "ordinal", F.posexplode(F.arrays_zip("pairs", "groups")).alias("seq", "s"))
    g = g.selectExpr("file", "ordinal", "seq", "s.pairs[0] u", "s.pairs[1] v", "cast(s.groups[0][0] as bigint) first_ts", "cast(element_at(s.groups, -1)[0] as bigint) end_ts")
    own = Window.partitionBy("file", "ordinal").orderBy("seq")
    return g.select("file", "ordinal", "seq", "u", "v", F.coalesce(F.lag("end_ts").over(own), F.col("first_ts")).alias("start_ts"), "end_ts")


def city_points(rows: DataFrame) -> DataFrame:
    """file, ordinal, pos, ts, lat, lon of the points of all groups in order."""
    p = rows.where("problem is null").select("file", "ordinal", F.posexplode(F.flatten("groups")).alias("pos", "p"))
    return p.selectExpr("file", "ordinal", "pos", "p[0] ts", "p[1] lat", "p[2] lon")


def densify(points: DataFrame, steps: int = 10) -> DataFrame:
    """tid, ordinal, lon, lat, ts: `steps` points for each pair of neighbours, and the last one."""
    own = Window.partitionBy("tid").orderBy("ts", "point_id")
    nxt = points.withColumn("n", F.struct(*[F.lead(c).over(own).alias(c) for c in ("lon", "lat", "ts")])).withColumn("k", F.row_number().over(own) - 1)
    out = nxt.withColumn("step", F.explode(F.when(F.col("n.ts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))))
    at = lambda c: F.when(F.col("step") == 0, F.col(c).cast("double")).otherwise(F.col(c) + (F.col(f"n.{c}") - F.col(c)) * F.col("step") / steps).alias(c)
    return out.select("tid", (F.col("k") * steps + F.col("step")).alias("ordinal"), at("lon"), at("lat"), at("ts"))


#: Readers by the city whose files have that shape.
READERS = {"chengdu": read_city_json, "xian": read_city_json, "beijing": read_points_csv}


def read_city(spark: SparkSession, city: str, path: str, *, refuse: bool = False) -> DataFrame:
    """The trajectories of a city's files, by its reader."""
    if city.lower() not in READERS:
        raise ValueError(f"no reader for {city!r}; there are {', '.join(READERS)}")
    return READERS[city.lower()](spark, path, refuse=refuse)


def ordinal_slice(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start to end - 1 by (file_key, ordinal) over all files."""
    from tessera.operators.tables import ranked

    return ranked(rows, ["file_key", "ordinal"], "at", label="ordinals").where((F.col("at") >= start) & (F.col("at") < end)).drop("at")
