"""Manifests, annotation lines and text files."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import strings


def read_manifest(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """A CSV manifest of strings: header, BOM, doubled quotes, line breaks in values; nulls are empty.

    Without ``columns`` the header names them. Nothing is inferred: NA and 13113 stay text.
    """
    r = spark.read.options(header=True, escape='"', multiLine=True, encoding="UTF-8", nullValue="\u0000", emptyValue="")
    if columns:
        r = r.schema(strings(columns)).option("enforceSchema", False)
    d = r.csv(path)
    first = d.columns[0]
    return d.withColumnRenamed(first, first.lstrip("﻿")).na.fill("")


def numbered_manifest(spark: SparkSession, path, columns: list[str] | None = None, row: str = "row", file: str = "file") -> DataFrame:
    """The rows of CSV manifests with ``row``, a row's ordinal in its file (the header is row 1), and ``file``.

    Large files are read in ranges by many tasks, line breaks in values
    notwithstanding. A first pass counts, in each range, quotes and the records that
    begin there, for either state in which the range may open; a prefix scan over the
    ranges of a file tells which it is, and what the first record's ordinal is. A
    second pass puts lines together to records; the pieces of a record that crosses
    ranges, two for each range at most, meet in a small exchange. Other lines never do.

    Records end with \\n or \\r\\n, quotes in values are doubled, empty lines between
    records aren't rows, and values are strings, "" where they are missing, as with
    ``read_manifest``. What stands for ranges is broadcast: 40 bytes for each range
    of ``spark.sql.files.maxPartitionBytes``.
    """
    names = columns or read_manifest(spark, path).columns
    source = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_block_length").alias("size"))
    lines = spark.read.option("lineSep", "\n").text(path).select(source.alias("range"), F.col("_metadata.file_path").alias("path"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    counted = lines.select("range.*", quotes.alias("quotes"), F.col("value").isin("", "\r").alias("blank")).mapInArrow(_range_counts, "file bigint, at bigint, size bigint, quotes bigint, closed bigint, open bigint")
    counted = counted.groupBy("file", "at", "size").agg(*(F.sum(c).alias(c) for c in ("quotes", "closed", "open")))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opens = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("inside"), F.col("open")).otherwise(F.col("closed"))
    states = opens.withColumn("first", F.coalesce(F.sum(begun).over(before), F.lit(0)) + 1)
    states = states.select(F.struct("file", "at", "size").alias("range"), "inside", "first")
    placed = lines.join(F.broadcast(states), "range", "left")
    # the ranges of both passes are the same as long as the session's settings are
    known = F.coalesce("first", F.raise_error(F.lit("the ranges of a file changed between two passes; read it again")).cast("bigint"))
    parts = placed.select(F.col("range.file").alias("file"), F.col("range.at").alias("at"), "path", "inside", known.alias("first"), quotes.alias("quotes"), "value")
    kind = "file bigint, at bigint, path string, ordinal bigint, text string"
    torn = parts.mapInArrow(partial(_records, False), kind).groupBy("file", "ordinal").agg(F.min("path").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "\n").alias("text"))
    records = parts.mapInArrow(partial(_records, True), kind).select("path", "ordinal", "text").union(torn.select("path", "ordinal", "text"))
    fields = F.from_csv(F.rtrim("text", F.lit("\r")), _ddl(names), {"escape": '"', "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE"})
    rows = records.where("ordinal > 1").select(fields.alias("_f"), F.col("ordinal").cast("int").alias(row), F.col("path").alias(file))
    return rows.select(*(F.coalesce(F.col("_f")[c], F.lit("")).alias(c) for c in names), row, file)


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in names)


def _range_counts(batches):
    """Of each range in turn: quotes, and the lines that begin a record if the range opens outside of a value, or inside of one."""
    at, inside = None, False
    for b in batches:
        file, start, size, quotes = (b.column(i).to_numpy() for i in range(4))
        blank = b.column(4).to_numpy(zero_copy_only=False)
        for lo, hi in _runs(file, start):
            if (file[lo], start[lo]) != at:
                at, inside = (file[lo], start[lo]), False
            odd = np.cumsum(quotes[lo:hi]) % 2 == 1
            opens = np.concatenate([[False], odd[:-1]]) ^ inside  # whether each line begins within a value, if the range began outside
            closed, opened = int((~opens & ~blank[lo:hi]).sum()), int((opens & ~blank[lo:hi]).sum())
            inside ^= bool(odd[-1])
            yield pa.RecordBatch.from_pydict({"file": [file[lo]], "at": [start[lo]], "size": [size[lo]], "quotes": [int(quotes[lo:hi].sum())], "closed": [closed], "open": [opened]})


def _runs(file: np.ndarray, start: np.ndarray):
    """Bounds of the runs of lines of one range."""
    edge = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    bounds = [0, *edge.tolist(), len(file)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]


def _records(whole, batches):
    """Records of the ranges: whole ones, or the pieces of those that a range's edge cuts."""
    names = ["file", "at", "path", "ordinal", "text"]
    key, held = None, []  # the record that is still open: its lines
    begun = inside = False  # whether it began in this range; whether the next line begins within a value
    ordinal = 0

    def piece(key, path, ordinal, closed, text):
        if closed == whole:
            yield pa.RecordBatch.from_pydict({"file": [int(key[0])], "at": [int(key[1])], "path": [path], "ordinal": [ordinal], "text": [text]})

    for b in batches:
        file, start, quotes = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(5).to_numpy()
        for lo, hi in _runs(file, start):
            if (file[lo], start[lo]) != key:
                if held:
                    yield from piece(key, path, ordinal, False, "\n".join(held))
                key, path, held = (file[lo], start[lo]), b.column(2)[lo].as_py(), []
                inside, begun = b.column(3)[lo].as_py(), False
                ordinal = b.column(4)[lo].as_py() - 1  # of the record that is open, or the last
            odd = np.cumsum(quotes[lo:hi]) % 2 == 1
            opens = np.concatenate([[False], odd[:-1]]) ^ inside
            values = b.column(6).slice(lo, hi - lo)
            blank = pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(~opens)  # lines that begin a record, blank ones to be left out
            head = int(first[0]) if len(first) else hi - lo
            if head:  # lines of the record that was open before
                held.extend(values.slice(0, head).to_pylist())
            ends = bool(odd[-1]) ^ inside  # whether the last line leaves a value open
            if len(first):
                if held:
                    yield from piece(key, path, ordinal, begun, "\n".join(held))
                    held = []
                bounds = np.append(first, hi - lo)
                if ends:
                    last, bounds = int(first[-1]), bounds[:-1]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array((bounds - head).astype(np.int32)), values.slice(head)), "\n")
                keep = ~blank[bounds[:-1]]
                joined, n = joined.filter(pa.array(keep)), int(keep.sum())
                if n and whole:
                    numbers = ordinal + 1 + np.arange(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array([path]).take(pa.array(np.zeros(n, np.int64))), pa.array(numbers), joined], names=names)
                ordinal += n
                if ends:
                    held, begun, ordinal = values.slice(last).to_pylist(), True, ordinal + 1
            elif not ends and held:
                yield from piece(key, path, ordinal, begun, "\n".join(held))
                held = []
            inside = ends
    if held:
        yield from piece(key, path, ordinal, False, "\n".join(held))


def placed_parts(spark: SparkSession, path, columns: list[str] | None = None, name: str = "place") -> DataFrame:
    """The rows of a folder's CSV parts with their place (from 1) over all parts in the order of their names, as an ordered writer leaves them."""
    d = numbered_manifest(spark, path, columns, "_row", "_file")
    per = d.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    per = per.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(per), "_file").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_file", "_row", "_before")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast where their text allows, else null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def read_parquet_splits(spark: SparkSession, files: dict[str, list[str]], columns: list[str] | None = None) -> DataFrame:
    """Parquet shards by split, with the split as a column; only the asked columns are read."""
    out = None
    for split, paths in files.items():
        d = spark.read.parquet(*paths)
        d = (d.select(*columns) if columns else d).withColumn("split", F.lit(split))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_json_document(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def describe(df: DataFrame) -> DataFrame:
    """``name, type, nullable, filled, example`` of the columns: the schema, and from the rows how many have a value, and the least one as text."""
    facts = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.count(F.col(f"`{f.name}`")).alias("filled"), F.min(F.col(f"`{f.name}`").cast("string")).alias("example")) for f in df.schema.fields))
    return df.agg(facts.alias("facts")).select(F.inline("facts"))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """``value, source``: lines of text files with the file they come from."""
    return spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("source"))


def decode_text(content: Column, fallbacks: tuple[str, ...] = ("windows-1256",)) -> Column:
    """Bytes as text: UTF-8 if they are, else the first fallback; no byte order mark."""
    tries = [F.try_validate_utf8(content.cast("string")), *(F.decode(content, f) for f in fallbacks)]
    return F.regexp_replace(F.coalesce(*tries), "^\ufeff", "")


def read_texts(spark: SparkSession, path, fallbacks: tuple[str, ...] = ("windows-1256",)) -> DataFrame:
    """``path, text``: whole files by the fallback chain of encodings."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # for encodings besides the UTF ones and Latin-1
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select("path", decode_text(F.col("content"), fallbacks).alias("text"))


def _filled(d: DataFrame) -> DataFrame:
    return d.where(F.trim("value") != "")


def path_status_label(lines: DataFrame) -> DataFrame:
    """Lines "path status label"; ``error`` where a part is missing."""
    p = F.split(F.trim("value"), "\\s+", 3)
    ok = F.size(p) == 3
    return _filled(lines).select("*", F.when(ok, p[0]).alias("image"), F.when(ok, p[1]).alias("status"), F.when(ok, p[2]).alias("label"), F.when(~ok, "malformed_line").alias("error"))


def image_comma_label(lines: DataFrame) -> DataFrame:
    """Lines "image,label", cut at the first comma."""
    p = F.split("value", ",", 2)
    ok = F.size(p) == 2
    return _filled(lines).select("*", F.when(ok, F.trim(p[0])).alias("image"), F.when(ok, F.trim(p[1])).alias("label"), F.when(~ok, "malformed_line").alias("error"))


def path_label(lines: DataFrame) -> DataFrame:
    """Lines "path label", cut at the first white space."""
    p = F.split(F.trim("value"), "\\s+", 2)
    ok = F.size(p) == 2
    return _filled(lines).select("*", F.when(ok, p[0]).alias("image"), F.when(ok, p[1]).alias("label"), F.when(~ok, "malformed_line").alias("error"))


def tab_or_space_label(lines: DataFrame) -> DataFrame:
    """Lines cut at the first tab, else at the first white space; quotes go, backslashes turn."""
    v = F.trim("value")
    p = F.when(F.contains(v, F.lit("\t")), F.split(v, "\t", 2)).otherwise(F.split(v, "\\s+", 2))
    ok = F.size(p) == 2
    tidy = lambda c: F.translate(F.trim(c), "\\\"'", "/")
    return _filled(lines).select("*", F.when(ok, tidy(p[0])).alias("image"), F.when(ok, F.trim(p[1])).alias("label"), F.when(~ok, "malformed_line").alias("error"))


def resolve_paths(rows: DataFrame, files: DataFrame, image: str = "image", path: str = "path") -> DataFrame:
    """Add ``resolved``: the file of the exact path, else of a path that ends in it, else of a basename that only one file has.

    Of several matches the least path wins. A file stands under hashes (96 bits) of all
    the ends of its path, from its name to the whole, which meet the wanted paths in
    one equi-join: its rows are as many as the paths' components, however many
    folders have a file of one name.
    """
    from ..functions.text import filename, portable_path

    r = rows.withColumn("_want", F.lower(portable_path(F.col(image)))).withColumn("_base", F.lower(filename(portable_path(F.col(image)))))
    f = files.select(F.col(path).alias("_path"), F.lower(portable_path(F.col(path))).alias("_have"))
    per_base = f.groupBy(F.lower(filename(F.col("_have"))).alias("_base")).agg(F.count("*").alias("_n"), F.min("_path").alias("_only"))
    hashed = lambda c: [F.xxhash64(c).alias("_a"), F.hash(c).alias("_b")]
    parts = F.split("_have", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = f.where("_have IS NOT NULL").select("_path", "_have", F.explode(ends).alias("_end"))
    best = ends.groupBy(*hashed(F.col("_end"))).agg(F.min(F.struct((F.col("_end") != F.col("_have")).alias("part"), F.col("_path").alias("path"))).alias("_best"))
    wanted = r.where("_want IS NOT NULL").select("_want").distinct().select("_want", *hashed(F.col("_want")))
    hit = wanted.join(best, ["_a", "_b"]).select("_want", F.col("_best.path").alias("_hit"))
    out = r.join(hit, "_want", "left").join(per_base, "_base", "left")
    return out.withColumn("resolved", F.coalesce("_hit", F.when(F.col("_n") == 1, F.col("_only")))).drop("_want", "_base", "_hit", "_n", "_only")


def first_existing(rows: DataFrame, candidates: list[str], files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``found``: the first of the ``candidates`` columns whose path is among ``files``; null if none is.

    One join for each candidate with the distinct paths; an equi-join, so neither side is gathered.
    """
    known = files.select(F.col(path).alias("_path")).distinct()
    out, hits = rows, []
    for i, c in enumerate(candidates):
        out = out.join(known.withColumnRenamed("_path", f"_path{i}"), F.col(c) == F.col(f"_path{i}"), "left")
        hits.append(f"_path{i}")
    return out.withColumn("found", F.coalesce(*hits)).drop(*hits)
