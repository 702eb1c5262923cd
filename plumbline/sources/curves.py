"""Raw curve files, reference spectra, reported metrics and folder manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cells import NUMBER
from plumbline.functions.pv import contains_any, guess_device_id, guess_scan_direction
from plumbline.operators.pv import pv_metric_rows
from plumbline.schemas import POINTS
from plumbline.sources.lines import file_name, numbered_lines
from plumbline.sources.tables import read_delimited_cells

# Separators in the order they are tried, and header words.
SEPARATORS = [",", "\t", ";"]
HEADER_WORDS = ["volt", "bias", "current", "jsc", "density", "pce"]
VOLTAGE_WORDS = ["volt", "bias", "potential"]
DENSITY_WORDS = ["density", "jsc", "ma/cm", "ma cm"]
CURRENT_WORDS = ["current", "ma", "amper"]
WAVELENGTH_WORDS = ["wavelength", "lambda", "nm"]
EFFICIENCY_WORDS = ["eqe", "ipce", "efficiency"]

# Coarse built-in reference irradiance (nm, W/m2/nm).
REFERENCE_SPECTRUM = [
    (300.0, 0.1),
    (350.0, 0.5),
    (400.0, 1.0),
    (450.0, 1.2),
    (500.0, 1.4),
    (550.0, 1.3),
    (600.0, 1.2),
    (650.0, 1.1),
    (700.0, 1.0),
    (750.0, 0.9),
    (800.0, 0.8),
    (850.0, 0.7),
    (900.0, 0.6),
    (950.0, 0.4),
    (1000.0, 0.3),
    (1100.0, 0.2),
    (1200.0, 0.1),
]


def _cells(line: Column, separator: Column) -> Column:
    parts = F.transform(F.split(line, separator), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _separator(line: Column) -> Column:
    """Regex of the separator that gives most cells; blanks when none gives two."""
    sizes = [F.size(_cells(line, F.lit(s))) for s in SEPARATORS]
    chain = F.lit(r"\s+")
    for i in reversed(range(len(SEPARATORS))):
        wins = sizes[i] > 1
        for j, other in enumerate(sizes):
            if j != i:
                wins = wins & ((sizes[i] > other) if j < i else (sizes[i] >= other))
        chain = F.when(wins, F.lit(SEPARATORS[i])).otherwise(chain)
    return chain


def _first(names: Column, test) -> Column:
    """0-based place of the first header that passes, NULL if none does."""
    places = F.filter(F.transform(names, lambda n, i: F.when(test(n), i)), lambda p: p.isNotNull())
    return F.get(places, F.lit(0))


def _file_layout(lines: DataFrame, header_words: list[str] | None) -> DataFrame:
    """Per file: header line, separator, header names and whether there is a header."""
    text = F.trim("line")
    first = F.col("line_number") == 1
    worded = contains_any(F.lower("line"), header_words) if header_words else F.lit(False)
    info = lines.groupBy("path").agg(
        F.max(F.when(first, text)).alias("_one"),
        F.min(F.when(worded, F.struct("line_number", text.alias("t")))).alias("_worded"),
    )
    single = (F.size(F.split("_one", r"\s+")) <= 1) & (_separator(F.col("_one")) == r"\s+")
    moved = single & F.col("_worded").isNotNull()
    info = info.select(
        "path",
        F.when(moved, F.col("_worded.t")).otherwise(F.col("_one")).alias("_head"),
        F.when(moved, F.col("_worded.line_number")).otherwise(1).alias("_at"),
    )
    info = info.withColumn("_sep", _separator(F.col("_head"))).withColumn("_names", F.transform(_cells(F.col("_head"), F.col("_sep")), F.lower))
    return info.withColumn("_has_header", F.exists("_names", lambda n: ~n.rlike(NUMBER)))


def _data_rows(lines: DataFrame, layout: DataFrame) -> DataFrame:
    text = F.trim("line")
    rows = lines.join(layout, "path").where(
        (F.col("line_number") >= F.col("_at") + F.col("_has_header").cast("int")) & ~text.startswith("#") & ~text.startswith("//")
    )
    return rows.withColumn("_cells", _cells(text, F.col("_sep")))


def _number(cells: Column, place: Column) -> Column:
    text = F.get(cells, place)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def read_jv_points(spark: SparkSession, paths: str | list[str], areas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, warnings) of J-V sweep files.

    ``areas`` may hold ``source_file, area_cm2`` to turn currents into densities. A
    header in A/m2 is scaled as a density.
    """
    lines = numbered_lines(spark, paths, keep_blank=False)
    layout = _file_layout(lines, HEADER_WORDS)

    def voltage(n):
        return contains_any(n, VOLTAGE_WORDS) | (n == "v")

    def density(n):
        return ~voltage(n) & (contains_any(n, DENSITY_WORDS) | (n == "j"))

    def current(n):
        return ~voltage(n) & ~density(n) & (contains_any(n, CURRENT_WORDS) | n.isin("i", "a"))

    names = F.when(F.col("_has_header"), F.col("_names")).otherwise(F.array(F.lit("voltage"), F.lit("current_density")))
    layout = layout.withColumn("_names", names).withColumns(
        {"_v": _first(F.col("_names"), voltage), "_j": _first(F.col("_names"), density), "_i": _first(F.col("_names"), current)}
    )
    target = F.coalesce("_j", "_i", F.lit(1))
    head = F.coalesce(F.get("_names", target), F.lit(""))
    layout = layout.withColumns(
        {
            "_vp": F.coalesce("_v", F.lit(0)),
            "_tp": target,
            "_current_only": F.col("_j").isNull() & F.col("_i").isNotNull(),
            "_flux": head.contains("a/m2") & ~head.contains("ma/m2"),
            "_ampere": head.contains("a") & ~head.contains("ma") & ~head.contains("cm"),
        }
    )
    rows = _data_rows(lines, layout).withColumn("source_file", file_name())
    if areas is not None:
        rows = rows.join(areas.select("source_file", "area_cm2"), "source_file", "left")
    else:
        rows = rows.withColumn("area_cm2", F.lit(None).cast("double"))
    raw = _number(F.col("_cells"), F.col("_tp"))
    scaled = F.when(F.col("_flux"), raw * 0.1).when(F.col("_ampere"), raw * 1000.0).otherwise(raw)
    y = F.when(F.col("_current_only") & (F.col("area_cm2") > 0), scaled / F.col("area_cm2")).otherwise(scaled)
    stem = F.regexp_replace(file_name(), r"\.[^.]*$", "")
    columns = {
        "curve_id": F.concat(F.lit("jv-"), stem),
        "source_file": F.col("source_file"),
        "device_id": guess_device_id(file_name()),
        "seq": F.col("line_number"),
        "x": _number(F.col("_cells"), F.col("_vp")),
        "y": y,
        "scan_direction": guess_scan_direction(file_name()),
    }
    points = rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in POINTS.fields]).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("_v").isNull(), F.lit("voltage column assumed")),
            F.when(F.col("_j").isNull() & F.col("_i").isNull(), F.lit("current column assumed")),
            F.when(F.col("_current_only"), F.lit("current without density")),
            F.when(F.col("_ampere"), F.lit("converted from A")),
        )
    )
    warnings = layout.select(file_name().alias("source_file"), F.explode(notes).alias("message"))
    return points, warnings


def read_eqe_points(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(points, warnings) of quantum-efficiency spectra: x in nm, y as a fraction."""
    lines = numbered_lines(spark, paths, keep_blank=False)
    layout = _file_layout(lines, None)
    names = F.when(F.col("_has_header"), F.col("_names")).otherwise(F.array(F.lit("wavelength"), F.lit("eqe")))

    def wave(n):
        return contains_any(n, WAVELENGTH_WORDS)

    def share(n):
        return ~wave(n) & contains_any(n, EFFICIENCY_WORDS)

    layout = layout.withColumn("_names", names).withColumns(
        {"_w": _first(F.col("_names"), wave), "_e": _first(F.col("_names"), share)}
    )
    rows = _data_rows(lines, layout).select(
        "path",
        "line_number",
        _number(F.col("_cells"), F.coalesce("_w", F.lit(0))).alias("x"),
        _number(F.col("_cells"), F.coalesce("_e", F.lit(1))).alias("y"),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    tops = rows.groupBy("path").agg(
        F.max("x").alias("_mx"), F.min("x").alias("_nx"), F.max("y").alias("_my"), F.min("y").alias("_ny"), F.count(F.lit(1)).alias("_n")
    )
    micro, percent = F.col("_mx") < 10.0, F.col("_my") > 1.0
    stem = F.regexp_replace(file_name(), r"\.[^.]*$", "")
    columns = {
        "curve_id": F.concat(F.lit("eqe-"), stem),
        "source_file": file_name(),
        "device_id": guess_device_id(file_name()),
        "seq": F.col("line_number"),
        "x": F.when(micro, F.col("x") * 1000.0).otherwise(F.col("x")),
        "y": F.when(percent, F.col("y") / 100.0).otherwise(F.col("y")),
        "scan_direction": F.lit("unknown"),
    }
    points = rows.join(tops, "path").select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in POINTS.fields])
    span = (F.col("_mx") - F.col("_nx")) * F.when(micro, 1000.0).otherwise(1.0)
    factor = F.when(percent, 0.01).otherwise(1.0)
    notes = F.array_compact(
        F.array(
            F.when(micro, F.lit("wavelength converted from um to nm")),
            F.when((percent & (F.col("_my") * 0.01 > 1.05)) | (F.col("_ny") * factor < -0.05), F.lit("values outside 0-1")),
            F.when(F.col("_n") < 10, F.lit("too few points")),
            F.when(span < 100.0, F.lit("wavelength range too narrow")),
        )
    )
    return points, tops.select(file_name().alias("source_file"), F.explode(notes).alias("message"))


def builtin_reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCE_SPECTRUM, "wavelength_nm double, irradiance double")


# Header words of the columns of a reference spectrum.
WAVELENGTH_WORDS = ["wavelength", "nm"]
IRRADIANCE_WORDS = ["irradiance", "w_m2", "intensity"]


def read_reference_spectrum(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``wavelength_nm, irradiance`` from a delimited file; columns by header words."""
    lines = numbered_lines(spark, paths, keep_blank=False)
    layout = _file_layout(lines, None).withColumns(
        {
            "_w": F.coalesce(_first(F.col("_names"), lambda n: contains_any(n, WAVELENGTH_WORDS)), F.lit(0)),
            "_e": F.coalesce(
                _first(
                    F.col("_names"),
                    lambda n: ~contains_any(n, ["wavelength"]) & contains_any(n, IRRADIANCE_WORDS),
                ),
                F.lit(1),
            ),
        }
    )
    rows = _data_rows(lines, layout)
    return rows.select(
        _number(F.col("_cells"), F.col("_w")).alias("wavelength_nm"), _number(F.col("_cells"), F.col("_e")).alias("irradiance")
    ).where(F.col("wavelength_nm").isNotNull() & F.col("irradiance").isNotNull())


def read_reported_metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reported device metrics of table files, in canonical units."""
    cells, _ = read_delimited_cells(spark, paths)
    rows = pv_metric_rows(cells)
    named = F.filter("raw_cells", lambda c: F.lower(c["column_name"]).contains("device") | F.lower(c["column_name"]).contains("id"))
    first = F.coalesce(F.nullif(F.get(named, F.lit(0))["value"], F.lit("")), F.get("raw_cells", F.lit(0))["value"])
    return rows.withColumn("device_id", first)


# Folder -> kind of raw measurement, and image suffixes.
RAW_FOLDERS = {
    "jv": "jv_curve",
    "eqe": "eqe_spectrum",
    "excel": "excel_workbook",
    "reported": "reported_metrics",
    "reference": "reference_spectrum",
}
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "tif", "tiff", "webp"]


def _files(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """Files below a folder with their relative path; contents are read only if asked for."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", *columns)
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    return listed.withColumn("relative_path", F.substring_index("path", marker, -1))


def raw_measurement_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every file of a measurement folder with its kind, by folder, and a device guess."""
    folder = F.substring_index("relative_path", "/", 1)
    kind = F.lit("unknown")
    for name, value in RAW_FOLDERS.items():
        kind = F.when((folder == name) & F.col("relative_path").contains("/"), value).otherwise(kind)
    return _files(spark, root, ["length"]).select(
        file_name().alias("source_file"),
        "relative_path",
        kind.alias("input_type"),
        guess_device_id(file_name()).alias("device_id_guess"),
        F.col("length").alias("size_bytes"),
        F.when((kind == "excel_workbook") & F.lower("path").endswith(".xlsm"), "macro-enabled workbook is not audited")
        .when(kind == "unknown", "unknown input directory or format")
        .alias("warning"),
    )


def image_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Image files with name, suffix, size and content hash; the id is a hash of the path."""
    suffix = F.lower(F.substring_index("path", ".", -1))
    files = _files(spark, root, ["length", "content"]).where(suffix.isin(IMAGE_SUFFIXES))
    return files.select(
        F.concat(F.lit("img-"), F.substring(F.sha2("relative_path", 256), 1, 16)).alias("image_id"),
        file_name().alias("file_name"),
        F.regexp_replace(file_name(), r"\.[^.]*$", "").alias("stem"),
        F.concat(F.lit("."), suffix).alias("file_ext"),
        "relative_path",
        F.col("length").alias("file_size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
