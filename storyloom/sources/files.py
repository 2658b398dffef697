"""Files in: text of any usual encoding, catalogs and stop lists."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In order of trial; the longer mark of UTF-32-LE begins with that of UTF-16-LE.
BYTE_ORDER_MARKS = (
    (codecs.BOM_UTF8, "utf-8-sig"),
    (codecs.BOM_UTF32_LE, "utf-32-le"),
    (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
)
WIDE = ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")
NARROW = ("utf-8", "cp1252", "mac_roman", "latin-1")


def _first(raw: bytes, names) -> str | None:
    for n in names:
        try:
            return raw.decode(n)
        except (UnicodeDecodeError, LookupError):
            continue
    return None


def decoded(raw: bytes | None, encoding: str = "auto") -> str | None:
    """A named codec, else by byte order mark, else (many zero bytes at the start) a wide one, else a narrow one."""
    if raw is None:
        return None
    if encoding != "auto":
        return raw.decode(encoding)
    for mark, name in BYTE_ORDER_MARKS:
        if raw.startswith(mark):
            return _first(raw, [name]) or raw.decode("utf-8", "replace")
    head = raw[:4096]
    text = _first(raw, WIDE) if head and head.count(0) / len(head) > 0.30 else None
    return text if text is not None else _first(raw, NARROW) or raw.decode("utf-8", "replace")


def decode_column(c: Column, encoding: str = "auto") -> Column:
    """Whole files in Arrow batches: Spark's own decode knows few of these codecs."""

    @F.pandas_udf("string")
    def run(x):
        return x.map(lambda b: decoded(None if b is None else bytes(b), encoding))

    return run(c)


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt", encoding: str = "auto", title: str = "stem") -> DataFrame:
    """work_id, path, title, raw_text, error of every file below a folder; a file that cannot be decoded by the named
    codec has an error and no text, and does not stop the rest."""

    @F.pandas_udf("text string, error string")
    def run(x):
        import pandas as pd

        out = []
        for b in x:
            try:
                out.append((decoded(bytes(b), encoding), None))
            except (UnicodeDecodeError, LookupError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    shown = F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1) if title == "stem" else name
    rows = files.select("path", shown.alias("title"), run("content").alias("r"))
    return rows.select(F.sha2(F.col("path").cast("binary"), 256).alias("work_id"), "path", "title", F.col("r.text").alias("raw_text"), F.col("r.error").alias("error"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV catalog with a header; fields in quotes may hold line ends and doubled quotes."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


#: Words too common to stand for a motif, next to those of a file.
STOP_WORDS = (
    "hero", "villain", "power", "fight", "battle", "magic", "love", "war",
    "secret", "plan", "agent", "mystery", "weapon", "girl", "boy",
    "night", "day", "city", "king", "queen", "man", "woman", "monster", "beast",
    "darkness", "light", "death", "life", "friend", "enemy", "revenge", "curse",
    "buddy", "backup", "job", "serious", "calm", "opposite", "haunted",
    "first glance",
)


def read_stop_words(spark: SparkSession, path: str | None = None) -> DataFrame:
    """word: the built-in list and the file's lines, lower case, without blank lines and comments; a file that isn't
    there counts as empty."""
    words = spark.sql("SELECT explode(array(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")) AS word")
    if path is not None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> '' and word not like '#%'")
            words = words.unionByName(lines)
    return words.distinct()
