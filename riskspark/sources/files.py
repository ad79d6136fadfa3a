"""Readers. All of them are lazy scans; only schemas and header lines reach the driver."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import params as P
from riskspark.functions.text import normalize_key
from riskspark.session import list_dirs, path_exists, work_path

SURVEY_DATE_PREFIX = "Data da Pesquisa: "
NO_DATA_MARKER = "_sem_dados"


def read_raw(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """Raw table scan; the state filter reaches the Parquet reader or prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("state").isin([s.upper() for s in states])) if states else df


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a declared schema: keys stay text, so leading zeros survive."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types; costs an extra pass over the file, for ad-hoc use."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


# what is learned of a file takes some hundred bytes: at most this many files' facts are broadcast
BROADCAST_FILES = 20_000


def _learned_lines(
    spark: SparkSession, path: str, is_header: Column, date_text: Column | None, separator: str
) -> tuple[DataFrame, list[str]]:
    """Lines of text files with their file's date, if they have one, and the names in the common header.

    One pass learns per file its encoding (a file that is not valid UTF-8 as a whole is Latin-1), its header
    line and its last date; these facts, one row per file, are written and joined to the lines, which are read
    once more. Neither the plan nor the driver grows with the number of files.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    header = F.when(is_header, F.col("value").cast("binary"))
    facts = raw.groupBy("_file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        F.min(header).alias("_header"),
        (F.min(header) < F.max(header)).alias("_mixed"),
        F.max(date_text if date_text is not None else F.lit(None).cast("string")).alias("_date"),
    )
    place = work_path(spark, "file-facts")
    facts.write.parquet(place)
    facts = spark.read.schema(facts.schema).parquet(place)
    text = F.when(F.col("_utf8"), F.col("_header").cast("string")).otherwise(F.decode("_header", "ISO-8859-1"))
    text = F.rtrim(F.regexp_replace(text, "^\ufeff", ""), F.lit("\r"))
    heads = facts.filter("_header IS NOT NULL").select(text.alias("header"), "_mixed").distinct().take(2)
    if len(heads) != 1 or heads[0]["_mixed"]:
        raise ValueError(f"expected one common header line, found {[h['header'] for h in heads] or 'none'}")
    names = [name.strip().strip('"') for name in heads[0]["header"].split(separator)]
    few = facts.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    lines = raw.join(F.broadcast(facts) if few else facts, "_file")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    value = F.regexp_replace(F.when(F.col("_utf8"), F.col("value")).otherwise(latin), "^\ufeff", "")
    return lines.select(value.alias("value"), "_date"), names


def _parse_rows(lines: DataFrame, names: list[str], separator: str, keep: list[Column]) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    parsed = lines.withColumn("_row", F.from_csv("value", F.lit(schema), {"sep": separator, "mode": "PERMISSIVE"}))
    return parsed.select(*keep, *[F.col(f"_row._c{i}").alias(name) for i, name in enumerate(names)])


def read_separated(spark: SparkSession, path: str, required: list[str], separator: str = ";") -> DataFrame:
    """Separated all-string file whose header starts with ``required[0]``; checks the contract."""
    is_header = F.regexp_replace(F.split_part("value", F.lit(separator), F.lit(1)), '["\ufeff]', "") == required[0]
    lines, names = _learned_lines(spark, path, is_header, None, separator)
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"file lacks columns: {', '.join(missing)}")
    return _parse_rows(lines.filter(~is_header), names, separator, []).select(*required)


def read_preamble_csv(spark: SparkSession, path: str, key_word: str = "IBGE", separator: str = ";") -> DataFrame:
    """Bulk file with preamble lines: the survey date of each file becomes a column.

    Lines are told apart by content (header names the key, preamble lines lack separators), so
    splits of a large file can be read by different tasks. Of several dates in a file the last counts.
    """
    is_date = F.col("value").contains(SURVEY_DATE_PREFIX)
    is_header = F.upper("value").contains(key_word) & F.col("value").contains(separator)
    cleaned = F.regexp_replace("value", '["\ufeff]', "")
    date_text = F.when(is_date, F.trim(F.replace(cleaned, F.lit(SURVEY_DATE_PREFIX), F.lit(""))))
    lines, names = _learned_lines(spark, path, is_header & ~is_date, date_text, separator)
    n_separators = F.length("value") - F.length(F.replace("value", F.lit(separator), F.lit("")))
    rows = lines.filter(~is_date & ~is_header & (n_separators >= len(names) - 1))
    return _parse_rows(rows, names, separator, [F.col("_date").alias("survey_date")])


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of text files with their numbers: value, file, file_number, line_of_file, line (all from 0).

    Files follow each other by name. The lines of a block of a file are read in order by one task, which
    numbers them; the blocks' counts, one row per block, give the numbers where blocks and files start.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    place = work_path(spark, "line-blocks")
    blocks.write.parquet(place)
    blocks = spark.read.schema(blocks.schema).parquet(place)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = blocks.groupBy("file").agg(F.sum("n").alias("lines"))
    in_order = Window.orderBy("file")  # a row per file
    files = files.select(
        "file",
        (F.row_number().over(in_order) - 1).alias("file_number"),
        F.coalesce(F.sum("lines").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lines_before"),
    )
    starts = blocks.withColumn("in_file", before).join(files, "file").drop("n")
    line_of_file = F.col("at") - F.col("first") + F.col("in_file")
    return lines.join(starts, ["file", "block"]).select(
        "value", "file", "file_number", line_of_file.alias("line_of_file"), (F.col("lines_before") + line_of_file).alias("line")
    )


def read_jsonl_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed lines and empty-block marker rows are left out."""
    full = T.StructType([*schema.fields, T.StructField(NO_DATA_MARKER, T.BooleanType())])
    full = full.add("_corrupt_record", T.StringType())
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    clean = rows.filter(F.col("_corrupt_record").isNull() & ~F.coalesce(F.col(NO_DATA_MARKER), F.lit(False)))
    return clean.drop("_corrupt_record", NO_DATA_MARKER)


SCHEMA_THREADS = 16


def file_columns(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """The columns of every file, each from its own footer, which a task reads; several at a time."""
    with ThreadPoolExecutor(SCHEMA_THREADS) as pool:
        return dict(zip(files, pool.map(lambda file: spark.read.parquet(file).columns, files), strict=True))


@dataclass(frozen=True)
class SkippedFile:
    state: str
    file: str
    missing: tuple[str, ...]


def union_state_files(spark: SparkSession, base: str, required: list[str]) -> tuple[DataFrame, list[SkippedFile]]:
    """Union of the files in the ``state=XX`` folders that meet the column contract, and the files that do not.

    Every file is judged by its own columns, so a folder may hold both kinds. Files of the same columns are
    read by one scan.
    """
    skipped, alike = [], {}
    for folder in list_dirs(spark, base):
        state = folder.partition("=")[2]
        for file, columns in file_columns(spark, spark.read.parquet(f"{base}/{folder}").inputFiles()).items():
            missing = tuple(sorted(set(required) - set(columns)))
            if missing:
                skipped.append(SkippedFile(state, file, missing))
            else:
                alike.setdefault(tuple(c for c in columns if c != "state"), []).append(file)
    if not alike:
        raise ValueError("no state file meets the column contract")
    frames = [spark.read.option("basePath", base).parquet(*files) for files in alike.values()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union.withColumn("state", F.col("state").cast("string")), skipped


def first_source(
    spark: SparkSession, candidates: list[str], schema: T.StructType | str, strict: bool = False
) -> DataFrame:
    """First existing source: table name, Parquet folder or CSV; else empty, or an error if strict."""
    for source in candidates:
        if "/" not in source:
            if spark.catalog.tableExists(source):
                return spark.read.table(source)
        elif path_exists(spark, source):
            return read_csv_typed(spark, source, schema) if source.endswith("csv") else spark.read.parquet(source)
    if strict:
        raise RuntimeError(f"no readable source among {candidates}")
    return spark.createDataFrame([], schema)


# --- header discovery in extracted sheet rows --------------------------------------------

# fixed values: header names of the rival-grade sheets, in order of preference
CODE_HEADERS = ["codigomunicipiocompleto", "codibge", "codigoibge", "codmunicipio"]
CODE_EXACT = ["Código Município Completo", "Cod.IBGE", "Cod IBGE", "cod_ibge"]
CODE_CONTAINS = ["codibge", "codigoibge", "codigomunicipio"]
NAME_EXACT = ["Nome_Município", "Município", "Instituição"]
NAME_CONTAINS = ["nomemunicipio", "instituicao"]
NOTE_EXACT = [["Nota 1", "Nota_1"], ["Nota 2", "Nota_2"], ["Nota 3", "Nota_3"]]
GRADE_EXACT = ["capag", "capag{next_year}", "capagoficial", "classificacaocapag"]
GRADE_EXCLUDED = ["rebaixada", "origem"]


def _first_position(keys: Column, test) -> Column:
    """0-based index of the first key that passes, NULL if none."""
    hits = F.transform(keys, lambda key, i: F.when(test(key), i))
    return F.array_min(hits)


def find_column(keys: Column, exact: list[str], contains: list[str] = ()) -> Column:
    """Index of the first exact name in order of preference, then of the first containing one."""
    wanted = [normalize_key(F.lit(name)) for name in exact]
    options = [_first_position(keys, lambda key, w=w: key == w) for w in wanted]
    options += [_first_position(keys, lambda key, part=part: key.contains(part)) for part in contains]
    return F.coalesce(*options)


def find_grade_column(keys: Column, year: Column) -> Column:
    """Index of the official grade column of a sheet for ``year``."""
    next_year = (year + 1).cast("string")
    exact = [F.replace(F.lit(name), F.lit("{next_year}"), next_year) for name in GRADE_EXACT]
    options = [_first_position(keys, lambda key, w=w: key == w) for w in exact]
    options.append(_first_position(keys, lambda key: key.rlike(r"^capag\d{4}$")))

    def fits(key: Column) -> Column:
        test = key.contains("capag")
        for word in GRADE_EXCLUDED:
            test = test & ~key.contains(word)
        return test

    options.append(F.array_max(F.transform(keys, lambda key, i: F.when(fits(key), i))))
    return F.coalesce(*options)


def sheet_rank(name: Column) -> Column:
    key = normalize_key(name)
    return F.when(key.contains("previa") & key.contains("capag"), 0).when(key.contains("capag"), 1).otherwise(2)


def discover_columns(rows: DataFrame, search_rows: int | None = None) -> DataFrame:
    """Extracted sheet rows -> graded entities.

    ``rows``: file, sheet, row_index, year, cells (array of text). Per file the header is the
    first row, by sheet preference, that names a code, a state and a grade column, among all rows or
    the first ``search_rows`` of a sheet. A file without such a row fails the job, also if none of its rows is
    searched; rows without a file name are a file.
    """
    keys = F.transform("cells", normalize_key)
    # rows beyond the search stay in their file's group, without keys
    head = rows.withColumn("_keys", F.when(F.col("row_index") < search_rows, keys) if search_rows else keys)
    head = head.withColumns(
        {
            "_code": find_column(F.col("_keys"), CODE_EXACT, CODE_CONTAINS),
            "_name": find_column(F.col("_keys"), NAME_EXACT, NAME_CONTAINS),
            "_state": find_column(F.col("_keys"), ["UF"]),
            "_grade": find_grade_column(F.col("_keys"), F.col("year")),
            **{f"_note{i}": find_column(F.col("_keys"), names) for i, names in enumerate(NOTE_EXACT, 1)},
        }
    )
    named = F.arrays_overlap("_keys", F.array(*[F.lit(k) for k in CODE_HEADERS]))
    usable = named & F.col("_state").isNotNull() & F.col("_grade").isNotNull() & F.col("_code").isNotNull()
    positions = ["_code", "_name", "_state", "_grade", "_note1", "_note2", "_note3"]
    found = F.struct(F.col("sheet").alias("_sheet"), F.col("row_index").alias("_at"), *positions)
    order = F.when(usable, F.struct(sheet_rank(F.col("sheet")), F.col("sheet"), F.col("row_index")))
    header = head.groupBy("file").agg(F.min_by(found, order).alias("_h"))
    no_header = F.raise_error(F.concat(F.lit("no header row in "), F.coalesce("file", F.lit("NULL"))))
    header = header.withColumn("_h", F.when(F.col("_h").isNull(), no_header).otherwise(F.col("_h")))
    header = header.select(F.col("file").alias("_of"), "_h.*")
    body = rows.join(header, F.col("file").eqNullSafe(F.col("_of")))
    body = body.filter((F.col("sheet") == F.col("_sheet")) & (F.col("row_index") > F.col("_at")))

    def cell(position: str) -> Column:
        return F.get(F.col("cells"), F.col(position))

    code = F.regexp_replace(cell("_code"), r"\D", "")
    grade = F.replace(F.upper(F.trim(cell("_grade"))), F.lit(" "), F.lit(""))
    shaped = body.select(
        "file",
        "sheet",
        F.when(F.length(code) < 7, F.lpad(code, 7, "0")).otherwise(code).alias("entity_code"),
        F.coalesce(cell("_name"), F.lit("")).alias("name"),
        F.upper(F.trim(cell("_state"))).alias("state"),
        "year",
        grade.alias("grade"),
        *[F.coalesce(cell(f"_note{i}"), F.lit("")).alias(f"note{i}") for i in (1, 2, 3)],
        (F.length(code) > 0).alias("_has_code"),
    )
    known = F.col("state").isin(list(P.STATE_REGION))
    return shaped.filter(known & F.col("_has_code") & (F.length("grade") > 0)).drop("_has_code")
