"""Source trees as tables: binary scan with pruning by extension, size guard, decoding, includes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Languages of file extensions; the second list is scanned by the project scanner as well.
EXTENSIONS = {".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".cxx": "c", ".hpp": "c", ".java": "java", ".py": "python", ".go": "go"}
MORE_EXTENSIONS = {".rs": "rust", ".js": "javascript", ".ts": "typescript"}
MAX_BYTES, MAX_INCLUDE_BYTES = 5 * 1024 * 1024, 512 * 1024


def dimension(key: F.Column, table: dict[str, str]) -> F.Column:
    """The table's value of a key, null if there is none: a dimension of a few entries as an expression, without a join."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def language(path: F.Column, more: bool = False) -> F.Column:
    return dimension(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), EXTENSIONS | (MORE_EXTENSIONS if more else {}))


def guard(rows: DataFrame, size: str, most: int) -> DataFrame:
    """rows with `status`: larger ones stay, as skipped."""
    return rows.withColumn("status", F.when(F.col(size) > most, "skipped").otherwise("ok"))


def scan(spark: SparkSession, folder: str, recursive: bool = True, langs: list[str] | None = None, more: bool = False) -> DataFrame:
    """files(file_path, lang, size_bytes, status, code): extension and language are tested on the path before any content is read, and
    content is kept only for files within the size guard. Bytes that are not UTF-8 are replaced."""
    table = EXTENSIONS | (MORE_EXTENSIONS if more else {})
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    wanted = [either(e[1:]) for e, lang in table.items() if langs is None or lang in langs]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").load(folder)
    rows = raw.withColumn("lang", language(F.col("path"), more)).where(F.col("lang").isNotNull())
    # the test of the length is pushed to the reader: the content of larger files is never read, whatever their size
    code = F.make_valid_utf8(F.col("content").cast("string"))
    small, large = (guard(rows.where(F.col("length") <= MAX_BYTES), "length", MAX_BYTES), guard(rows.where(F.col("length") > MAX_BYTES), "length", MAX_BYTES))
    cols = [F.col("path").alias("file_path"), "lang", F.col("length").alias("size_bytes"), "status"]
    return small.select(*cols, code.alias("code")).unionByName(large.select(*cols, F.lit(None).cast("string").alias("code")))


def includes(files: DataFrame) -> DataFrame:
    """(file_path, include, target): each local include with the file it means, the one whose folder is nearest up the tree."""
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    asked = files.where("lang = 'c'").select("file_path", F.explode(F.regexp_extract_all("code", F.lit(r'#\s*include\s*"([^"]+)"'), 1)).alias("include"))
    # candidates: the include below each parent folder of the file
    parts = F.split(folder(F.col("file_path")), "/")
    tried = asked.select("file_path", "include", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"), F.col("include")).alias("target")))).alias("t"))
    there = files.where(F.col("size_bytes") <= MAX_INCLUDE_BYTES).select(F.col("file_path").alias("target"))
    met = tried.select("file_path", "include", "t.depth", "t.target").join(there, "target")
    w = Window.partitionBy("file_path", "include").orderBy(F.col("depth").desc())
    return met.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("file_path", "include", "target")
