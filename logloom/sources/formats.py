"""Log formats: format string -> Java regex + header projection."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Per-system log formats (literal parts are regex).  The
# "full" Hadoop files carry a leading <SessionId>, hence the variant key.
# ---------------------------------------------------------------------------
LOG_FORMATS = [
    ("HDFS", "2k", "HDFS/HDFS_2k.log", "<Date> <Time> <Pid> <Level> <Component>: <Content>"),
    ("Hadoop", "2k", "Hadoop/Hadoop_2k.log", r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>"),
    ("Hadoop", "full", "Hadoop/Hadoop_full.log",
     r"<SessionId> <Date> <Time> <Level> \[<Process>\] <Component>: <Content>"),
    ("Spark", "2k", "Spark/Spark_2k.log", "<Date> <Time> <Level> <Component>: <Content>"),
    ("Zookeeper", "2k", "Zookeeper/Zookeeper_2k.log",
     r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>"),
    ("BGL", "2k", "BGL/BGL_2k.log",
     "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>"),
    ("HPC", "2k", "HPC/HPC_2k.log", "<LogId> <Node> <Component> <State> <Time> <Flag> <Content>"),
    ("Thunderbird", "2k", "Thunderbird/Thunderbird_2k.log",
     r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>"),
    ("Windows", "2k", "Windows/Windows_2k.log",
     "<Date> <Time>, <Level>                  <Component>    <Content>"),
    ("Linux", "2k", "Linux/Linux_2k.log", r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>"),
    ("Android", "2k", "Android/Android_2k.log", "<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>"),
    ("HealthApp", "2k", "HealthApp/HealthApp_2k.log", r"<Time>\|<Component>\|<Pid>\|<Content>"),
    ("Apache", "2k", "Apache/Apache_2k.log", r"\[<Time>\] \[<Level>\] <Content>"),
    ("Proxifier", "2k", "Proxifier/Proxifier_2k.log", r"\[<Time>\] <Program> - <Content>"),
    ("OpenSSH", "2k", "OpenSSH/OpenSSH_2k.log", r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>"),
    ("OpenStack", "2k", "OpenStack/OpenStack_2k.log",
     r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>"),
    ("Mac", "2k", "Mac/Mac_2k.log",
     r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>"),
]


def format_registry(spark: SparkSession) -> DataFrame:
    """The registry as a DataFrame (dataset, variant, log_file, log_format)."""
    return spark.createDataFrame(LOG_FORMATS, "dataset string, variant string, log_file string, log_format string")


def lookup_format(dataset: str, variant: str = "2k") -> str:
    for d, v, _, fmt in LOG_FORMATS:
        if d == dataset and v == variant:
            return fmt
    for d, _, _, fmt in LOG_FORMATS:
        if d == dataset:
            return fmt
    raise KeyError(dataset)


FIELD = re.compile(r"<([^<>]+)>")
# an opening parenthesis that captures: not escaped, not followed by a question mark
CAPTURE = re.compile(r"(?<!\\)(?:\\\\)*\((?!\?)")
# parts the captured headers in a replacement, and marks a line that fits
_PART = "\x00\x1f"
_SPACES = " \t\n\x0b\f\r"
# the format "<Content>": the line itself
_WHOLE_LINE = "(?s)^(.*?)$"


def compile_format(log_format: str) -> tuple[list[str], str, list[int]]:
    """A1: headers, one anchored Java regex, and the capture-group number of
    every header.  A header takes as little as possible; the text between
    headers is a regex of its own (it may hold groups, as in
    ``(\\[<PID>\\])?``) in which a run of spaces stands for any white space."""
    fields = list(FIELD.finditer(log_format))
    starts = [0, *(f.end() for f in fields)]
    ends = [*(f.start() for f in fields), len(log_format)]
    between = [re.sub(" +", lambda _: r"\s+", log_format[i:j]) for i, j in zip(starts, ends)]
    opened = [len(CAPTURE.findall(gap)) for gap in between]
    groups = [sum(opened[:k + 1]) + k + 1 for k in range(len(fields))]
    # (?s): a carriage return or another Unicode line end inside a line is part of it
    return [f[1] for f in fields], "(?s)^" + "(.*?)".join(between) + "$", groups


def split_headers(lines: DataFrame, log_format: str, line_col: str = "value",
                  keep_unmatched: bool = False) -> DataFrame:
    """A2: apply the format to every line (after strip); keep matching lines.

    The regex runs once for each line: a line that fits is replaced by a mark
    and its captured headers, which are then split apart.  Returns the input
    columns plus one string column per header.  With ``keep_unmatched`` the
    boolean column ``matched`` is added instead of the filter (used by the
    load report, A4).
    """
    headers, regex, groups = compile_format(log_format)
    parts = _PART + _PART.join(f"${g}" for g in groups)

    def taken(x):
        # "$" stands before a last line end that is no white space, so such a line may have more to strip
        tight = F.trim(x, F.lit(_SPACES))
        tight = F.when(x.rlike("[\u0085\u2028\u2029]$"), F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(tight)
        return F.split(F.concat(F.lit(_PART), tight) if regex == _WHOLE_LINE else F.regexp_replace(tight, regex, parts), _PART)

    def fits(p):
        return F.coalesce(F.get(p, F.lit(0)) == "", F.lit(False)) & (F.size(p) == len(headers) + 1)

    # exploded (one row a line, none if it does not fit): the regex is not repeated in the filter and every header
    found = F.transform(F.array(F.col(line_col)), taken)
    if not keep_unmatched:
        found = F.filter(found, fits)
    df = lines.select(*lines.columns, F.explode(found).alias("_parts"))
    cols = [F.get("_parts", F.lit(k + 1)) for k in range(len(headers))]
    if keep_unmatched:
        cols = [F.when(fits(F.col("_parts")), c).otherwise(F.lit("")) for c in cols]
    out = [c.alias(h) for c, h in zip(cols, headers)]
    return df.select(*lines.columns, *([fits(F.col("_parts")).alias("matched")] if keep_unmatched else []), *out)


#: Split offsets up to this many bytes are broadcast to the lines.
BROADCAST_BYTES = 64 * 1024 * 1024


def split_offsets(splits: DataFrame, keys: list[str], count_col: str = "_n") -> DataFrame:
    """``splits`` with ``_off``: the sum of ``count_col`` over all splits before it in the order of ``keys``.

    Two levels: sums inside each range of splits, and sums over the ranges (one
    row for each shuffle partition).  Nothing is collected."""
    from logloom.session import cut_lineage
    ranges = splits.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges, "splits")
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = ranges.groupBy("_range").agg(F.sum(count_col).alias("_sum"))
    bases = bases.select("_range", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    return (ranges.withColumn("_in", F.coalesce(F.sum(count_col).over(inside), F.lit(0))).join(F.broadcast(bases), "_range")
            .withColumn("_off", F.col("_base") + F.col("_in")).drop("_range", "_base", "_in"))


def consecutive_ids(df: DataFrame, name: str = "LineId", order_cols=None) -> DataFrame:
    """B1: 1..n in input order without a global window or sort of the lines.

    Input order is ``order_cols`` (e.g. file path and split start from the
    file metadata) and, inside one of those groups, the position in the
    scan.  One row per group (per file split, or per partition when no
    ``order_cols`` are given), its row count and first position, is written, gets its
    offset by two-level prefix sums (``split_offsets``) and is joined back;
    every row gets offset + position."""
    from logloom.session import cut_lineage
    # written once: the input is read once, and positions can't differ between the counts and the lines
    tagged = cut_lineage(df.withColumn("_mid", F.monotonically_increasing_id()), "placed-lines")
    keys = list(order_cols) if order_cols else ["_pid"]
    if not order_cols:
        tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33))
    groups = tagged.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_mid").alias("_m0"))
    off = cut_lineage(split_offsets(groups, keys).drop("_n"), "split-offsets")
    size = off.agg(F.sum(F.lit(24) + sum((F.length(F.col(k).cast("string")) for k in keys), F.lit(0))).alias("b")).first()["b"] or 0
    out = tagged.join(F.broadcast(off) if size <= BROADCAST_BYTES else off, keys).withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0") + 1)
    return out.drop("_mid", "_m0", "_off", *(["_pid"] if not order_cols else []))


#: Files up to which one row of the list of small files names them; the files of a row are read by one task.
RUN_FILES = 500
#: Bytes of a file that are read at a time, and lines of a batch.
READ_BYTES, READ_LINES = 4 << 20, 10_000
#: Names that Spark decompresses and Arrow does not.
_OTHER_CODECS = (".deflate", ".snappy", ".lz4")


def _files_and_folders():
    """A function for ``mapInArrow`` over (path): the path's folders (path) and, as lists of names, its files (base, names), both in
    the order of their paths; a list ends where a folder comes between its files.  Files that Spark hides are left out."""
    import pyarrow as pa
    from pyarrow import fs as pafs
    limit = RUN_FILES
    schema = pa.schema([("path", pa.string()), ("base", pa.string()), ("names", pa.list_(pa.string()))])

    def hidden(name):
        return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name

    def listed(uri):
        fs, base = pafs.FileSystem.from_uri(uri)
        top = fs.get_file_info(base)
        if top.type == pafs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if top.type == pafs.FileType.File:
            yield None, uri[:-len(top.base_name)].rstrip("/"), [top.base_name]
            return
        found = [(x.base_name, x.type == pafs.FileType.Directory) for x in fs.get_file_info(pafs.FileSelector(base))]
        names, uri = [], uri.rstrip("/")
        for name, folder in sorted((x for x in found if not hidden(x[0])), key=lambda x: (x[0] + "/" * x[1]).encode()):
            if names and (folder or len(names) == limit):
                yield None, uri, names
                names = []
            if folder:
                yield f"{uri}/{name}", None, None
            else:
                names.append(name)
        if names:
            yield None, uri, names

    def fn(it):
        for batch in it:
            for uri in batch.column("path").to_pylist():
                rows = []
                for row in listed(uri):
                    rows.append(row)
                    if len(rows) == 100:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return fn, "path string, base string, names array<string>"


def _lines_of_files():
    """A function for ``mapInArrow`` over (base, names): the lines (value) of the files, in order, and the path of the first of the files
    (_run).  Lines end as in ``spark.read.text``, bytes stay as they are, a byte order mark goes."""
    import pyarrow as pa
    from pyarrow import fs as pafs
    size, most, others = READ_BYTES, READ_LINES, _OTHER_CODECS
    schema = pa.schema([("value", pa.string()), ("_run", pa.string())])

    def blocks(fs, path):
        """The file's lines, a list for each block."""
        if path.endswith(others):
            raise ValueError(f"small files are read as they are, or from gz, bz2 and zst: {path}")
        with fs.open_input_stream(path) as f:
            data = f.read(size)
            data, rest = data.removeprefix(b"\xef\xbb\xbf"), []
            while len(data) and (more := f.read(size)):  # up to the last line feed; what follows begins the next block
                cut = data.rfind(b"\n") + 1
                rest.append(data[:cut] if cut else data)
                if cut:
                    yield b"".join(rest).splitlines()
                    rest = [data[cut:]]
                data = more
            yield b"".join([*rest, data]).splitlines()

    def made(lines, run):
        value = pa.array(lines, pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([value, pa.array([run] * len(lines), pa.string())], schema=schema)

    def fn(it):
        for batch in it:
            for uri, names in zip(batch.column("base").to_pylist(), batch.column("names").to_pylist()):
                fs, base = pafs.FileSystem.from_uri(uri)
                run, lines, held = f"{uri}/{names[0]}", [], 0
                for name in names:
                    for block in blocks(fs, f"{base}/{name}"):
                        lines += block
                        held += sum(map(len, block))
                        if len(lines) >= most or held >= size:
                            yield made(lines, run)
                            lines, held = [], 0
                if lines:
                    yield made(lines, run)
    return fn, "value string, _run string"


def small_file_lines(spark: SparkSession, paths) -> DataFrame:
    """The lines (value) of all files below the folders (or files) ``paths``, and ``_run``: files that follow each other in a folder make
    runs of up to ``RUN_FILES``, named by the path of the first.  Runs in the order of ``_run``, and lines in a run as they are read,
    have the order of the files' paths.

    For millions of small files: Spark's file sources hold every file in the driver and open few in a task, each with a
    reader of its own.  Here folders are listed level by level and runs are read by tasks dealt evenly; the driver gets counts only."""
    from logloom.session import cut_lineage, spread
    paths = [paths] if isinstance(paths, str) else list(paths)
    uris = [p if "://" in p or p.startswith("file:") else os.path.abspath(p) for p in paths]
    level, found = spark.createDataFrame([(u,) for u in uris], "path string"), []
    while True:
        fn, schema = _files_and_folders()
        rows = cut_lineage(spread(level).mapInArrow(fn, schema), f"files-level-{len(found)}")
        found.append(rows.filter("names is not null").select("base", "names"))
        level = rows.filter("path is not null").select("path")
        if level.isEmpty():
            break
    fn, schema = _lines_of_files()
    return spread(reduce(DataFrame.unionByName, found)).mapInArrow(fn, schema)


def read_raw_logs(spark: SparkSession, paths, log_format: str, with_line_ids: bool = True, small_files: bool = False) -> DataFrame:
    """A2 + B1: ``spark.read.text`` -> header columns -> consecutive LineId in
    (file path, split start, position) order.

    With ``small_files`` the files are listed and read by tasks that get many of them (``small_file_lines``; ``paths`` are folders or
    files on a file system that Arrow reads)."""
    if small_files:
        lines, order = small_file_lines(spark, paths), ["_run"]
    else:
        lines, order = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"),
                                                     F.col("_metadata.file_block_start").alias("_block")), ["_file", "_block"]
    parsed = split_headers(lines, log_format).drop("value")
    if not with_line_ids:
        return parsed.drop(*order)
    return consecutive_ids(parsed, order_cols=order).drop(*order)


def formalize_messages(lines: DataFrame, log_format: str, line_col: str = "value") -> DataFrame:
    """A3: skip blank lines, replace runs of non-ASCII characters by
    ``<N/ASCII>``, split the headers; other columns (the source line number)
    are kept, so line numbers keep their gaps."""
    kept = lines.filter(F.col(line_col).rlike(r"\S"))
    cleaned = kept.withColumn(line_col, F.regexp_replace(F.col(line_col), r"[^\x00-\x7F]+", "<N/ASCII>"))
    return split_headers(cleaned, log_format, line_col)


def load_report(lines: DataFrame, log_format: str, line_col: str = "value", group_cols=(), strict: bool = False) -> DataFrame:
    """A4: lines, matched lines and loading rate (matched / all).  ``strict`` raises when no line fits."""
    flagged = split_headers(lines, log_format, line_col, keep_unmatched=True)
    if strict and flagged.filter("matched").isEmpty():
        raise ValueError("no line fits the log format")
    return flagged.groupBy(*group_cols).agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("matched").cast("long")).alias("n_matched"),
        F.round(F.sum(F.col("matched").cast("double")) / F.count("*"), 6).alias("loading_rate"))
