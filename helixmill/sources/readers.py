"""Readers of sequence corpora, vocabularies, sample files and logs. Schemas are given, never inferred."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.sequences import frame, raw_sequence
from helixmill.operators.conditions import parse_list
from helixmill.sources import summary_log
from helixmill.sources.matrices import MatrixSource


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """Labelled peptides; the unnamed index column goes, list text becomes arrays."""
    schema = "_index string, species string, modified_sequence string, targetGroups string, targetObjects string, MIC double"
    d = spark.read.schema(schema).csv(path, header=True, escape='"')
    return d.drop("_index").withColumns({c: parse_list(F.col(c)) for c in ("targetGroups", "targetObjects")})


def read_negatives(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("_index string, Sequence string").csv(path, header=True)
    return d.select("Sequence", frame(F.col("Sequence")).alias("framed"))


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("sequence string").csv(path, header=True)
    return d.withColumn("raw_sequence", raw_sequence(F.col("sequence")))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_id) of lines with one comma and an integer; a token's last line counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    parts = lines.select("line", F.split("text", ",").alias("p")).where("size(p) = 2")
    ids = parts.select("line", F.get("p", F.lit(0)).alias("token"), F.get("p", F.lit(1)).try_cast("int").alias("token_id")).where("token_id is not null")
    return ids.groupBy("token").agg(F.max_by("token_id", "line").alias("token_id"))


def read_samples(spark: SparkSession, paths) -> DataFrame:
    """Sample files with a # comment head, with the file each row came from."""
    schema = "`Generated Sequence` string, `Extracted Sequence` string, `Is Valid` string, `In Training Data` string, `Is Repeat` string"
    return spark.read.schema(schema).csv(paths, header=True, comment="#").withColumn("output_file", F.input_file_name())


SAMPLE_COLUMNS = ["Generated Sequence", "Extracted Sequence", "Is Valid", "In Training Data", "Is Repeat"]


def read_runs(spark: SparkSession, summary: DataFrame, rows_per_batch: int = 10_000) -> DataFrame:
    """The sample files that ``summary.output_file`` names, each row with the name given there; missing files have no rows.

    A name may be a folder, whose files are the run's. The names stay a column: tasks list the folders and open the
    files of the names they have, so neither the driver nor a query plan holds a list of files, and a run's files are
    several tasks'. Names are paths of the cluster's default file system, or full addresses.
    """
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(name):
        from pyarrow import fs

        if name.startswith("file:"):
            return fs.LocalFileSystem(), "/" + name[5:].lstrip("/")
        if "://" in name:
            return fs.FileSystem.from_uri(name)
        return (fs.LocalFileSystem() if default.startswith("file:") else fs.FileSystem.from_uri(default)[0]), name

    def files(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            pairs = []
            for name in b["output_file"].to_pylist():
                system, path = place(name)
                if system.get_file_info(path).type == fs.FileType.Directory:
                    found = [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
                    pairs += [(name, f"{name.rstrip('/')}/{f.base_name}") for f in found]
                else:
                    pairs.append((name, name))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1)], names=["output_file", "_file"])

    def read(batches):
        import csv
        import io
        import itertools

        import pyarrow as pa

        def text_of(name):
            system, path = place(name)
            return io.TextIOWrapper(system.open_input_stream(path), encoding="utf-8", errors="replace", newline="")

        for b in batches:
            for name, file in zip(b["output_file"].to_pylist(), b["_file"].to_pylist()):
                try:
                    text = text_of(file)
                except FileNotFoundError:
                    continue
                with text:
                    lines = csv.reader(line for line in text if not line.startswith("#") and line.strip())
                    next(lines, None)  # the header
                    while some := list(itertools.islice(lines, rows_per_batch)):
                        columns = [[(r[k] or None) if k < len(r) else None for r in some] for k in range(len(SAMPLE_COLUMNS))]
                        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array([name] * len(some))], names=[*SAMPLE_COLUMNS, "output_file"])

    names = summary.select("output_file").where("output_file is not null").distinct().repartition(width, "output_file")
    found = names.mapInArrow(files, "output_file string, _file string").repartition(width, "_file")
    return found.mapInArrow(read, ", ".join(f"`{c}` string" for c in SAMPLE_COLUMNS) + ", output_file string")


def read_summary(spark: SparkSession, path: str, run: str = "config_id") -> DataFrame:
    """The newest row of each run that ``writers.append_summary`` has written."""
    return summary_log.read(spark, path, run)


def resolve_column(df: DataFrame, names: list[str], on_missing: str = "raise") -> DataFrame:
    """The first of ``names`` that ``df`` has, as ``sequence``; else an error or the first column."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        if on_missing == "raise":
            raise ValueError(f"none of {names} in {df.columns}")
        found = df.columns[0]
    return df.select(F.col(f"`{found}`").alias("sequence"))


def read_sample_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("sequence"))


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, ordinal, length, sequence) of an append-only log; a line may start with its length."""
    blocks = spark.read.option("lineSep", "=== Epoch ").text(path).where(F.col("value").rlike(r"^\d+ ==="))
    rows = blocks.select(F.regexp_extract("value", r"^(\d+)", 1).cast("int").alias("epoch"), F.split("value", "\n").alias("l"))
    lines = rows.select("epoch", F.posexplode(F.filter(F.slice("l", F.lit(2), F.size("l")), lambda x: F.trim(x) != "")).alias("ordinal", "line"))
    return lines.select(
        "epoch", "ordinal", F.nullif(F.regexp_extract("line", r"^(\d+)\s{3}", 1), F.lit("")).cast("int").alias("length"), F.trim(F.regexp_replace("line", r"^\d+\s{3}", "")).alias("sequence")
    )


def read_distance_maps(spark: SparkSession, path: str, triangle: bool = False) -> DataFrame:
    """(map_id, i, j, d) of square .npy matrices; with ``triangle`` the strict upper triangle alone.

    Files that executors can mount are mapped and read by ranges of rows (``matrices``); a file in another store is
    one task's, whole.
    """
    if "://" not in path or path.startswith("file:"):
        spark.dataSource.register(MatrixSource)
        return spark.read.format("npy_matrix").option("triangle", str(triangle).lower()).load(path)

    def decode(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for p, c in zip(b["path"].to_pylist(), b["content"]):
                m = np.load(io.BytesIO(c.as_buffer()))
                for i in range(len(m)):
                    j = np.arange(i + 1 if triangle else 0, m.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(j), pa.string()), pa.array(np.full(len(j), i, np.int32)), pa.array(j), pa.array(m[i, j].astype(float))], names=["map_id", "i", "j", "d"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "map_id string, i int, j int, d double")
