"""Delimited lines to typed rows, with the lines that do not parse and the reason.

Every field is first a nullable text; rules over the fields make an array of the reasons that hold, in order; lines
with an empty array load as typed rows, the rest come out with their first reason. Headers are looked up by file in a
join whose many side AQE splits where one file is hot.

Defined results. A null or blank line has one blank field. A file without a header expects no columns, so that its
lines have the reason `column_count`. Of several first lines of a file the one with the smallest raw_id is its header;
all are headers and none is a row. A column that the header lacks is null: no label is known, a path is blank, numbers
are blank. Equal lines load as often as they are delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space at the ends of a field.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBERS = ("frames", "width", "height")
TEXTS = ("path", "label", "method", "compression", "codec")
REASONS = ("quoting", "column_count", "label", "path", "number")


def _field(delimiter: str) -> str:
    """A quoted field, or one free of quotes; possessive, so that matching a line neither backtracks nor recurses."""
    return rf'(?:"(?:[^"]++|"")*+"|[^"{delimiter}]*+)'


def _fields(line: Column, delimiter: str) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f"{delimiter}({_field(delimiter)})"), F.lit(1))


def _well_quoted(line: Column, delimiter: str) -> Column:
    field = _field(delimiter)
    return line.rlike(rf"\A{field}(?:{delimiter}{field})*+\z")


def _bare(field: Column) -> Column:
    """The content of a field: without its quotes, inner ones single."""
    inner = F.substring(field, 2, 1_000_000_000)
    quoted = F.replace(F.left(inner, F.length(inner) - 1), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(field, F.lit('"')), quoted).otherwise(field)


def headers(lines: DataFrame) -> DataFrame:
    """file_name, delimiter and column names of each file's header."""
    first = lines.filter("line_no = 1").groupBy("file_name").agg(F.min_by("raw_line", "raw_id").alias("h"))
    h = F.regexp_replace(F.coalesce("h", F.lit("")), "\\A\ufeff|\r\\z", "")
    split = F.when(F.contains(h, F.lit(";")), _fields(h, ";")).otherwise(_fields(h, ","))
    names = F.transform(split, lambda x: F.lower(F.btrim(_bare(x), F.lit(SPACE))))
    return first.select("file_name", F.contains(h, F.lit(";")).alias("semicolon"), names.alias("names"))


def fields_by_header(lines: DataFrame) -> DataFrame:
    """raw_id, file_name, line_no and `cells`, the (name, value) pairs of each line that is no header; values it lacks are null."""
    line = F.regexp_replace(F.coalesce("raw_line", F.lit("")), "\r\\z", "")
    rows = lines.filter("line_no is null or line_no <> 1").select("raw_id", "file_name", "line_no", line.alias("line")).join(headers(lines), "file_name", "left")
    semi = F.coalesce("semicolon", F.lit(False))
    fields = F.when(semi, _fields(F.col("line"), ";")).otherwise(_fields(F.col("line"), ","))
    cells = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n, i: F.struct(n.alias("name"), _bare(F.get("fields", i)).alias("value")))
    return rows.withColumn("fields", fields).select("raw_id", "file_name", "line_no", cells.alias("cells"))


def checked(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """raw_id, file_name, line_no, fields by name and the reasons that hold, for every line that is no header."""
    known = labels.select(F.col("alias"), F.col("expected_label").alias("known_label")).dropDuplicates(["alias"])
    line = F.regexp_replace(F.coalesce("raw_line", F.lit("")), "\r\\z", "")
    rows = lines.filter("line_no is null or line_no <> 1").select("raw_id", "file_name", "line_no", line.alias("line"))
    rows = rows.join(headers(lines), "file_name", "left")
    semi = F.coalesce("semicolon", F.lit(False))
    rows = rows.withColumns({
        "quoted": F.when(semi, _well_quoted(F.col("line"), ";")).otherwise(_well_quoted(F.col("line"), ",")),
    }).withColumn("fields", F.when(~F.col("quoted"), F.lit(None)).when(semi, _fields(F.col("line"), ";")).otherwise(_fields(F.col("line"), ",")))
    at = lambda name: F.array_position("names", F.lit(name))
    get = lambda name: F.when(at(name) > 0, _bare(F.get("fields", (at(name) - 1).cast("int"))))
    rows = rows.select("raw_id", "file_name", "line_no", "line", "quoted", "fields", F.coalesce(F.size("names"), F.lit(0)).alias("expected"), *(get(c).alias(c) for c in (*TEXTS, *NUMBERS, "file_size_mb")))
    rows = rows.withColumn("alias", F.lower(F.btrim("label", F.lit(SPACE)))).join(known, "alias", "left").drop("alias")
    path = F.btrim(F.coalesce("path", F.lit("")), F.lit(SPACE))
    digits = [~F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE)).rlike(r"\A[0-9]*\z") for c in NUMBERS]
    rules = {
        "quoting": ~F.col("quoted"),
        "column_count": F.size("fields") != F.col("expected"),
        "label": F.col("known_label").isNull(),
        "path": (path == "") | path.rlike(r"\A[/\\]|\A[A-Za-z]:|(?:\A|[/\\])\.\.(?:[/\\]|\z)"),
        "number": digits[0] | digits[1] | digits[2],
    }
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(rules[r], F.lit(r)) for r in REASONS))))


def rejected(lines: DataFrame, labels: DataFrame) -> DataFrame:
    return checked(lines, labels).filter(F.size("reasons") > 0).select("raw_id", F.get("reasons", F.lit(0)).alias("reason"))


def loaded(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """The valid lines as typed rows. `not_cast` names the fields of a valid line that fit no type: digits beyond 64 bits and a file_size_mb that is no number; their value is null."""
    clean = lambda c: F.nullif(F.btrim(c, F.lit(SPACE)), F.lit(""))
    typed = {**{c: "bigint" for c in NUMBERS}, "file_size_mb": "double"}
    value = {c: clean(c).try_cast(t) for c, t in typed.items()}
    missed = F.array_compact(F.array(*(F.when(clean(c).isNotNull() & value[c].isNull(), c) for c in typed)))
    return (
        checked(lines, labels).filter(F.size("reasons") == 0)
        .select("raw_id", "file_name", "line_no", clean("path").alias("path"), F.col("known_label").alias("expected_label"), *(clean(c).alias(c) for c in TEXTS[2:]), *(v.alias(c) for c, v in value.items()), missed.alias("not_cast"))
    )
