"""Statement files: what kind they are, told from their first bytes, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 65_536


def statement_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, kind, reason and content of files; one row a file, read where the tasks run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    told = kind_of(F.col("content"))
    return files.select("path", F.sha2("content", 256).alias("sha256"), told["kind"].alias("kind"), told["reason"].alias("reason"), "content")


def decoded(content: Column) -> Column:
    """UTF-8 (with or without mark), UTF-16 with mark, else Latin bytes; line ends become \\n.

    Windows-1252 differs from ISO-8859-1 in 0x80 to 0x9F alone; the ones that statements print (the
    euro sign, dashes and quotes) are put right after decoding.
    """
    head = F.hex(F.substring(content, 1, 2))
    latin = F.translate(F.decode(content, "ISO-8859-1"), "\x80\x91\x92\x93\x94\x96\x97\x85", "€‘’“”–—…")
    text = F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def kind_of(content: Column) -> Column:
    """struct(kind, reason): kind is null where the file is refused."""
    head = F.substring(content, 1, HEAD)
    text = decoded(head)
    starts = lambda hex_digits: F.startswith(F.hex(F.substring(content, 1, 12)), F.lit(hex_digits))
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 20)
    often = lambda d: F.size(F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))) >= 2)) >= 2
    delimited = often(",") | often(";") | often("\t") | often("|")
    refused = lambda why: F.struct(F.lit(None).cast("string").alias("kind"), F.lit(why).alias("reason"))
    known = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("reason"))
    return (
        F.when(starts("255044462D"), known("pdf"))
        .when(starts("89504E47") | starts("FFD8FF"), known("image"))
        .when(starts("504B0304"), known("xlsx"))
        .when(starts("D0CF11E0"), refused("an old workbook; save it as .xlsx"))
        .when(F.substring(F.hex(content), 9, 16).isin("6674797068656963", "6674797068656978"), refused("HEIC pictures can't be read"))
        .when(text.rlike(r"(?s)^\s*(OFXHEADER|<\?OFX|<OFX>)|<OFX>"), known("ofx"))
        .when(text.rlike(r"^\s*!Type:"), known("qif"))
        .when(text.rlike(r"camt\.053"), known("camt"))
        .when(text.rlike(r"^\s*<\?xml|^\s*<"), refused("another kind of XML"))
        .when(F.contains(F.hex(head), F.lit("0000")) & ~starts("FFFE") & ~starts("FEFF"), refused("not text"))
        .when(delimited, known("csv"))
        .otherwise(refused("no table in it"))
    )
