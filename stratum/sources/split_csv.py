"""Quoted CSV whose fields hold line breaks, read in several tasks per file.

Spark's multi-line CSV reader gives a whole file to one task, because only the text before a
line tells whether the line stands inside quotes. Here files are read as lines, which Spark
splits anywhere, and that state is found by a prefix scan:

1. every split (a range of a file) maps the state at its start to the state at its end; with
   the two states "outside" and "inside quotes" the map is the parity of its quotes. One
   aggregate, one row per split;
2. the maps are composed in the order of the splits, which gives each split its first state;
3. every split is read again and cuts its own lines into records. A record that a split doesn't
   finish is put together from its own end and the beginnings of the next splits, at most one
   fragment on each side of a split;
4. records are parsed by ``from_csv``.

Files are RFC 4180: quotes stand only around fields, doubled inside them. Defined cases: a line
break inside a field is kept as it is; ``\\r\\n`` ends a record as ``\\n`` does; empty lines
between records are skipped; a file that ends inside quotes ends its last record there; the
header is the first record of each file; partition folders become columns, as in Spark's own
readers; compressed files are one split each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD, HEAD, TAIL = 0, 1, 2
_OUT = "__path string, __block long, __kind int, __first boolean, __text string"


def read_lines(spark: SparkSession, path: str, folders: T.StructType | None = None) -> DataFrame:
    """The lines of every file, cut at line feeds only, with the split that each belongs to;
    ``folders`` declares the columns of partition folders, which are inferred otherwise."""
    reader = spark.read.option("lineSep", "\n")
    if folders is not None:
        reader = reader.schema(T.StructType([T.StructField("value", T.StringType()), *folders.fields]))
    lines = reader.text(path)
    return lines.withColumns({"__path": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")})


def split_states(lines: DataFrame) -> DataFrame:
    """(path, block): the splits that begin inside quotes."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    maps = lines.groupBy("__path", "__block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    return maps.select("__path", "__block", state.alias("__inside")).filter("__inside = 1")


class _Cutter:
    """Cuts the lines of one split after another into records and fragments."""

    def __init__(self, extra: list[str]):
        self.extra = extra
        self.key = None
        self.open: list[str] = []  # lines of the record, or of the head, that isn't finished
        self.inside = self.is_head = self.any = self.first = False
        self.keep: tuple = ()

    def end(self):
        """What the split that ends here leaves behind."""
        if self.open:
            yield self.batch([(HEAD if self.is_head else TAIL, self.first, "\n".join(self.open))], self.key, self.keep)
        self.open = []

    def batch(self, rows, key, keep) -> pa.RecordBatch:
        kind, first, text = zip(*rows, strict=True)
        n = len(rows)
        cols = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(kind, pa.int32()), pa.array(first, pa.bool_()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(cols + [pa.concat_arrays([k] * n) for k in keep], ["__path", "__block", "__kind", "__first", "__text", *self.extra])

    def split(self, key, inside: bool, keep):
        yield from self.end()
        self.key, self.inside, self.is_head, self.any, self.first, self.keep = key, inside, inside, False, False, keep

    def lines(self, part: pa.RecordBatch):
        value = part.column("value")
        odd = np.asarray(pc.bit_wise_and(pc.count_substring(value, '"'), 1)).astype(bool)
        after = np.logical_xor.accumulate(np.concatenate(([self.inside], odd)))
        before, self.inside = after[:-1], bool(after[-1])
        whole = ~before & ~odd
        begins = np.flatnonzero(~before)
        header = int(begins[0]) if len(begins) and not self.any and self.key[1] == 0 else -1
        self.any |= len(begins) > 0
        at = np.flatnonzero(~whole)
        rows = []
        if len(at):  # lines of records of several lines
            for i, state, turns, text in zip(at.tolist(), before[at].tolist(), odd[at].tolist(), value.take(pa.array(at)).to_pylist(), strict=True):
                if not state:
                    self.first = i == header
                self.open.append(text)
                if state and turns:
                    rows.append((HEAD if self.is_head else RECORD, self.first, "\n".join(self.open)))
                    self.open, self.is_head, self.first = [], False, False
        first = np.flatnonzero(whole) == header
        if rows:
            yield self.batch(rows, self.key, self.keep)
        if whole.any():
            n = len(first)
            own = part.filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([pa.array([self.key[0]] * n, pa.string()), pa.array([self.key[1]] * n, pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(first), own.column("value"), *(own.column(c) for c in self.extra)], ["__path", "__block", "__kind", "__first", "__text", *self.extra])


def _cut(extra: list[str]):
    def run(it):
        cutter = _Cutter(extra)
        for b in it:
            path, block, inside = (b.column(c).to_pylist() for c in ("__path", "__block", "__inside"))
            i = 0
            while i < b.num_rows:
                key, j = (path[i], block[i]), i + 1
                while j < b.num_rows and path[j] == key[0] and block[j] == key[1]:
                    j += 1
                if key != cutter.key:
                    yield from cutter.split(key, inside[i] == 1, [b.column(c).slice(i, 1) for c in extra])
                yield from cutter.lines(b.slice(i, j - i))
                i = j
        yield from cutter.end()

    return run


def records(spark: SparkSession, path: str, folders: T.StructType | None = None) -> DataFrame:
    """(text, file, partition columns) of every record of the files under ``path`` but the headers."""
    from stratum.session import ship_code

    ship_code(spark)
    lines = read_lines(spark, path, folders)
    extra = [c for c in lines.columns if c not in ("value", "__path", "__block")]
    # lines of a split stand in file order; kept so, whatever join Spark picks
    numbered = lines.withColumn("__line", F.monotonically_increasing_id())
    known = numbered.join(split_states(lines), ["__path", "__block"], "left").sortWithinPartitions("__path", "__block", "__line")
    types = "".join(f", `{c}` {lines.schema[c].dataType.simpleString()}" for c in extra)
    cut = known.select("__path", "__block", "__inside", "value", *extra).mapInArrow(_cut(extra), _OUT + types)
    whole = cut.filter(F.col("__kind") == RECORD)
    # a head goes on with the last record before it that its split didn't finish
    order = Window.partitionBy("__path").orderBy("__block", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("__kind") == TAIL, F.col("__block")), ignorenulls=True).over(order)
    parts = cut.filter(F.col("__kind") != RECORD).withColumn("__owner", owner)
    joined = parts.groupBy("__path", "__owner", *extra).agg(
        F.array_sort(F.collect_list(F.struct("__block", "__kind", "__text"))).alias("__parts"), F.max("__first").alias("__first"))
    joined = joined.withColumn("__text", F.array_join(F.col("__parts.__text"), "\n"))
    cols = ["__text", "__first", "__path", *extra]
    every = whole.select(cols).unionByName(joined.select(cols))
    text = F.regexp_replace("__text", "\r$", "")
    return every.filter(~F.col("__first")).select(text.alias("__text"), "__path", *extra).filter("__text != ''")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict, folders: T.StructType | None = None, file_col: str | None = None) -> DataFrame:
    """The files under ``path`` as ``schema`` and their partition columns; ``file_col`` names a
    column for the file that each row stands in."""
    rows = records(spark, path, folders)
    extra = [c for c in rows.columns if c not in ("__text", "__path")]
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in extra)
    own = {k: v for k, v in options.items() if k not in ("quoteAll", "header")}
    parsed = rows.withColumn("__row", F.from_csv("__text", ddl, own | {"multiLine": "true", "mode": "PERMISSIVE"}))
    cols = [F.col("__row").getField(f.name).alias(f.name) for f in schema.fields if f.name not in extra]
    file = [F.col("__path").alias(file_col)] if file_col else []
    return parsed.select(*cols, *extra, *file)
