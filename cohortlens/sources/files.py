"""Readers and writers of the workflow's files.  All paths are Spark paths, so any store that Spark reads will do."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.scalar import fixed6, number

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Required columns of each step's sample sheet.
SHEETS = {
    "split_bam": ("sample", "clean_bam", "deconv_res"),
    "episcore": ("sample", "target_bam", "background_bam"),
    "est_ff": ("sample", "pileup"),
    "perturbed_res": ("sample", "full_name", "clean_bam", "perturbed_res", "original_res"),
    "ref_40": ("sample", "clean_bam", "deconv_res"),
    "grid_search": ("sample", "clean_bam", "deconv_res"),
}
#: What stands for a missing value in text tables.
NULL_TOKENS = ("NA", "na", "N/A", "")
READS = "name string, chr string, start long, end long, text string, prob_class_1 double, mTcount double, insert_size long"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); a local session gets a temporary one.

    What is written there goes when the driver ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="cohortlens-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{found.rstrip('/')}/cohortlens-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_sheet(spark: SparkSession, path: str, step: str) -> DataFrame:
    """A step's sample sheet: a CSV with a header and the step's columns, none of them empty in any row."""
    if step not in SHEETS:
        raise ValueError(f"unknown step {step!r}")
    sheet = require_columns(spark.read.csv(path, header=True, schema=None), SHEETS[step])
    empty = sheet.where(" or ".join(f"`{c}` is null or trim(`{c}`) = ''" for c in SHEETS[step])).limit(1).collect()
    if empty:
        raise ValueError(f"a row lacks a value of {', '.join(SHEETS[step])}: {empty[0].asDict()}")
    return sheet


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def sniff(spark: SparkSession, path: str) -> str:
    """parquet, gzip or text, by extension, the extension inside ``.gz``, then the first bytes."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return "parquet"
    if re.search(r"\.(tsv|txt|csv|bed|bedgraph)\.gz$", name):
        return "gzip"
    if re.search(r"\.(tsv|txt|csv|bed|bedgraph)$", name):
        return "text"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        inside = [f.getPath() for f in fs.listStatus(at) if not f.getPath().getName().startswith(("_", "."))]
        return sniff(spark, inside[0].toString()) if inside else "text"
    stream = fs.open(at)
    try:
        head = [stream.read() for _ in range(4)]
    finally:
        stream.close()
    if head == list(b"PAR1"):
        return "parquet"
    return "gzip" if head[:2] == [0x1F, 0x8B] else "text"


def known_values(df: DataFrame) -> DataFrame:
    """Text columns with missing tokens as NULL."""
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A table of any sniffed format with a header, missing tokens as NULL, and only ``columns``."""
    if sniff(spark, path) == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, sep=sep, header=True)
        df = known_values(df)
    return require_columns(df, columns).select(*columns) if columns else df


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, without hidden ones; none if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    if not store.getFileStatus(at).isDirectory():
        return [at.toString()]
    return sorted(x for f in store.listStatus(at) if not f.getPath().getName().startswith(("_", ".")) for x in (list_files(spark, f.getPath().toString()) if f.isDirectory() else [f.getPath().toString()]))


def opened(path: str):
    """(file system, path in it) of a file, in a task; Hadoop's short form of local paths is known."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def inspect_files(spark: SparkSession, files: list[str], columns: list[str]) -> DataFrame:
    """(``path``, ``kind``, ``header``, ``error``) of tables, each read to its end by one task in pieces.

    ``header`` is the first line of text; ``error`` says why a file can't be used.
    """
    import pyarrow as pa

    def look(path: str) -> tuple[str, str]:
        import pyarrow.parquet as pq

        store, at = opened(path)
        with store.open_input_file(at) as file:
            head = file.read(4)
            file.seek(0)
            if head == b"PAR1":
                table = pq.ParquetFile(file)
                missing = [c for c in columns if c not in table.schema_arrow.names]
                if missing:
                    raise ValueError(f"missing columns: {', '.join(missing)}")
                for i in range(table.num_row_groups):
                    table.read_row_group(i, columns)
                return "parquet", ""
            packed = head[:2] == b"\x1f\x8b"
            unpack, line = zlib.decompressobj(31), b""
            while chunk := file.read(1 << 20):
                while packed and chunk:
                    data = unpack.decompress(chunk)
                    line += data if b"\n" not in line else b""
                    chunk = unpack.unused_data
                    if unpack.eof:
                        unpack = zlib.decompressobj(31) if chunk else unpack
                if not packed:
                    line += chunk
                    if b"\n" in line:
                        break
            if packed and not unpack.eof:
                raise ValueError("the file is cut")
            header = line.split(b"\n")[0].rstrip(b"\r").decode()
            missing = [c for c in columns if c not in header.split("\t")]
            if missing:
                raise ValueError(f"missing columns: {', '.join(missing)}")
            return "text", header

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    rows.append((path, *look(path), None))
                except Exception as e:  # an unreadable file is reported, as the workflow does
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, names=["path", "kind", "header", "error"])

    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    return paths.mapInArrow(run, "path string, kind string, header string, error string")


def read_deconv(spark: SparkSession, paths: list[str], min_sites: int | None = None) -> tuple[DataFrame, list[str]]:
    """The reads of all readable paths with ``mTcount >= min_sites``, and the paths that could not be read.

    A file may be broken behind its header, which shows only when it is read: all are looked at in one
    job beforehand, a file a task, and a path with a broken one is left out whole.  The others are
    one scan for each format and header.
    """
    schema = T.StructType.fromDDL(READS)
    of_path = {p: list_files(spark, p) for p in paths}
    seen = {r["path"]: r for r in inspect_files(spark, sorted({f for fs in of_path.values() for f in fs}), schema.names).collect()}  # a row a file
    skipped = [f"{p}: " + next((seen[f]["error"] for f in fs if seen[f]["error"]), "no file") for p, fs in of_path.items() if not fs or any(seen[f]["error"] for f in fs)]
    good = {p: fs for p, fs in of_path.items() if fs and not any(seen[f]["error"] for f in fs)}
    alike: dict[tuple[str, str], list[str]] = {}
    for f in (f for fs in good.values() for f in fs):
        alike.setdefault((seen[f]["kind"], seen[f]["header"]), []).append(f)
    out = spark.createDataFrame([], schema)
    for (kind, _), some in alike.items():
        df = spark.read.parquet(*some) if kind == "parquet" else known_values(spark.read.csv(some, sep="\t", header=True))
        df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
        out = out.unionByName(df.where(F.col("mTcount") >= min_sites) if min_sites is not None else df)
    return out, skipped


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, beta, meth, unmeth) of a bedGraph without its track line; the end is brought to the last base."""
    lines = spark.read.text(path).where(~F.col("value").startswith("track") & (F.trim("value") != ""))
    p = F.split("value", r"\t")
    at = lambda i, kind: F.try_element_at(p, F.lit(i + 1)).try_cast(kind)
    rows = lines.select(at(0, "string").alias("chr"), at(1, "long").alias("start"), (at(2, "long") - 1).alias("end"), at(3, "double").alias("beta"), at(4, "long").alias("meth"), at(5, "long").alias("unmeth"))
    return rows.where("start is not null and end is not null")


def read_cpg_list(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, final_recall, meandiff); an empty list is an error."""
    df = read_table(spark, path, ["chr", "start", "end", "final_recall", "meandiff"])
    df = df.select("chr", *[F.col(c).try_cast("long").alias(c) for c in ("start", "end")], *[number(F.col(c)).alias(c) for c in ("final_recall", "meandiff")])
    if df.isEmpty():
        raise ValueError(f"no sites in {path}")
    return df


def recall_list(panel: DataFrame, recall: float) -> DataFrame:
    """The list of one recall: lists are nested, so it is a predicate on one table."""
    return panel.where(F.col("recall") >= recall)


def read_known_sites(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, ref, alt, af) of single-nucleotide sites of a VCF-like panel; sites with a bad frequency go."""
    raw = spark.read.csv(path, sep="\t", comment="#", header=False)
    raw = raw.select(F.col("_c0").alias("chr"), F.col("_c1").try_cast("long").alias("pos"), F.upper("_c3").alias("ref"), F.upper("_c4").alias("alt"), F.nullif(F.regexp_extract("_c7", r"AF=([^;]+)", 1), F.lit("")).alias("af"))
    single = raw.where((F.length("ref") == 1) & (F.length("alt") == 1) & F.col("pos").isNotNull())
    return single.withColumn("af", number(F.col("af"))).where("af is not null")


def site_keys(sites: DataFrame) -> DataFrame:
    """Positions alone, each once."""
    return sites.select("chr", "pos").distinct()


PILEUP = ("chr", "pos", "ref", "alt", "af", "cfDNA_ref_reads", "cfDNA_alt_reads", "current_depth")


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """A pileup with whole counts (0 where they aren't numbers); a row without a key is an error."""
    df = read_table(spark, path, list(PILEUP))
    df = df.select("chr", F.col("pos").try_cast("long").alias("pos"), "ref", "alt", number(F.col("af")).alias("af"), *[F.coalesce(F.col(c).try_cast("double").cast("long"), F.lit(0)).alias(c) for c in PILEUP[5:]])
    if not df.where("chr is null or pos is null or ref is null or alt is null").isEmpty():
        raise ValueError(f"rows without a key in {path}")
    return df


def ff_input(pileup: DataFrame, min_raw: int = 0, min_model: int = 0) -> DataFrame:
    """Sites fit for the fraction: frequency from 0 to 1, counts, depths; the model's counts fall back to all reads'."""
    names = {"model_ref": "fetal_ref_reads_from_model", "model_alt": "fetal_alt_reads_from_model"}
    rows = pileup.select("chr", "pos", "af", F.col("cfDNA_ref_reads").alias("n_ref"), F.col("cfDNA_alt_reads").alias("n_alt"), *[(F.col(c) if c in pileup.columns else F.col(f"cfDNA_{n[6:]}_reads")).alias(n) for n, c in names.items()])
    good = F.col("af").between(0, 1)
    for c in ("n_ref", "n_alt", "model_ref", "model_alt"):
        good &= F.col(c) >= 0
    return rows.where(good & (F.col("n_ref") + F.col("n_alt") >= min_raw) & (F.col("model_ref") + F.col("model_alt") >= min_model))


def read_directories(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV files under ``recall.<r>_cutoff.<t>`` with recall and threshold from the directory's name."""
    df = spark.read.option("recursiveFileLookup", "true").csv(pattern, header=True)
    name = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(name, rf"{key}\.([0-9.]+[0-9])", 1).cast("double").alias(c) for key, c in (("recall", "recall"), ("cutoff", "threshold"))])


def samples_in(spark: SparkSession, path: str, suffix: str = "_beta_value.tsv.gz") -> DataFrame:
    """Samples that have a file ``<sample><suffix>`` under the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # the content is pruned
    return files.select(F.regexp_extract("path", rf"([^/]+){re.escape(suffix)}$", 1).alias("sample")).where("sample <> ''").distinct()


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line; blanks and comments go, and names with ``HCPT`` are cut to 8 characters."""
    name = F.trim("value")
    rows = spark.read.text(path).select(name.alias("sample")).where("sample <> '' and not startswith(sample, '#')")
    return rows.select(F.when(F.col("sample").contains("HCPT"), F.substring("sample", 1, 8)).otherwise(F.col("sample")).alias("sample"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """A set of sites from a BED with tabs or commas."""
    p = F.split("value", r"[\t,]")
    rows = spark.read.text(path).select(p[0].alias("chr"), F.try_element_at(p, F.lit(2)).try_cast("long").alias("start"), F.try_element_at(p, F.lit(3)).try_cast("long").alias("end"))
    return rows.where("start is not null").distinct()


def sheet_rows(content: bytes) -> list[dict[int, str]]:
    """The cells of a workbook's first sheet by column, row by row."""
    import io

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{main}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        sheet = ElementTree.fromstring(book.read(sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]))
    rows = []
    for row in sheet.iter(f"{main}row"):
        cells = {}
        for cell in row.iter(f"{main}c"):
            column = 0
            for letter in re.match(r"[A-Z]+", cell.get("r"))[0]:
                column = column * 26 + ord(letter) - 64
            value = cell.find(f"{main}v")
            if cell.get("t") == "inlineStr":
                cells[column - 1] = "".join(t.text or "" for t in cell.iter(f"{main}t"))
            elif value is not None:
                cells[column - 1] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        rows.append(cells)
    return rows


def sheet_bytes(header: list[str], rows: list[tuple]) -> bytes:
    """A one-sheet workbook of text cells."""
    import io
    from xml.sax.saxutils import escape

    letter = lambda i: (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)
    body = "".join(f'<row r="{n}">' + "".join(f'<c r="{letter(i)}{n}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for i, v in enumerate(r) if v is not None) + "</row>" for n, r in enumerate([header, *rows], 1))
    data = io.BytesIO()  # in memory: a workbook is a report
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return data.getvalue()


def read_workbooks(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(``path``, ``row``, ``columns``) of the first sheets of all workbooks of a path, each parsed by a task; a missing column is an error."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = sheet_rows(content.as_buffer().to_pybytes())
                places = {v: i for i, v in (rows[0] if rows else {}).items()}
                missing = [c for c in columns if c not in places]
                if missing:
                    raise ValueError(f"{at}: missing columns: {', '.join(missing)}")
                cells = [pa.array([r.get(places[c]) for r in rows[1:]], pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows[1:]), pa.string()), pa.array(range(1, len(rows)), pa.int64()), *cells], names=["path", "row", *columns])

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.StringType()) for c in columns]])
    return books.mapInArrow(run, schema)


def write_workbooks(rows: DataFrame, path: str, per_book: int = 10_000) -> int:
    """Rows as text cells of as many workbooks as they need, each made and written by a task; the number of workbooks."""
    import pyarrow as pa

    columns = rows.columns
    books = max(1, -(-rows.count() // per_book))
    dealt = rows.select(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(books)).alias("_book"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])

    def pack(t: pa.Table) -> pa.Table:
        cells = list(zip(*(t.column(c).to_pylist() for c in columns), strict=True))
        return pa.table({"name": [f"book-{t.column('_book')[0].as_py()}.xlsx"], "content": [sheet_bytes(columns, cells)]})

    return write_files(dealt.groupBy("_book").applyInArrow(pack, "name string, content binary"), path)


def write_files(files: DataFrame, path: str) -> int:
    """(``name``, ``content``) as files of a folder, written by the tasks that have them; how many."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                store, at = opened(f"{path}/{name}")
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of one small workbook as text columns, read by the driver through Spark's own reader; see :func:`read_workbooks`."""
    rows = sheet_rows(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    header = [rows[0][i] for i in sorted(rows[0])] if rows else []
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    return spark.createDataFrame([tuple(r.get(i) for i in range(len(header))) for r in rows[1:]], schema)


def write_xlsx(spark: SparkSession, header: list[str], rows: list[tuple], path: str) -> None:
    """One small workbook of text cells, written through Spark's file system; see :func:`write_workbooks`."""
    write_bytes(spark, sheet_bytes(header, rows), path)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """A small file, written through Spark's file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


# --- sinks ---------------------------------------------------------------------------------------------------------


def write_tsv(rows: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """Tabs and a header; doubles with six decimals, NULL as an empty cell."""
    columns: list[Column] = [fixed6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in rows.dtypes]
    rows.select(*columns).write.csv(path, sep="\t", header=True, compression=compression or "none", nullValue="")


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """Sorted distinct lines: range-partitioned files whose names are in order."""
    rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.text(path)


def write_shards(rows: DataFrame, path: str, keys: tuple[str, ...] = ("threshold", "recall")) -> None:
    """Parquet by keys; writing a shard again replaces that shard alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_database(rows: DataFrame, url: str, name: str, **options: str) -> None:
    """Replace a database table's rows through JDBC, keeping the table."""
    rows.write.mode("overwrite").option("truncate", "true").options(**options).jdbc(url, name)


def write_table(rows: DataFrame, name: str, **options: str) -> None:
    """Replace the rows of a table of the session's catalog, keeping the table and its types.

    Columns are matched by name; one that ``rows`` lacks is NULL, one that the table lacks is an error.  A table that
    isn't there is made with the types of ``rows`` and ``options``.
    """
    if rows.sparkSession.catalog.tableExists(name):
        rows.sparkSession.sql("INSERT OVERWRITE TABLE IDENTIFIER(:name) BY NAME SELECT * FROM {rows}", args={"name": name}, rows=rows)
    else:
        rows.write.options(**options).saveAsTable(name)


def write_json_summary(rows: DataFrame, path: str) -> None:
    """A small summary as JSON lines."""
    rows.coalesce(1).write.json(path)
