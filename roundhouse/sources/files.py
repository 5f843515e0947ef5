"""CSV ingest (S1, S2) and JSON payload columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

CORRUPT = "_corrupt_line"


class TooManyBadLines(ValueError):
    pass


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType,
                   encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header line, columns mapped by position to ``schema``.

    Quotes are doubled inside quoted fields; malformed rows fail the job
    instead of turning into nulls. Latin-1 sources pass ``ISO-8859-1``.
    """
    return (spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("encoding", encoding)
            .option("mode", "FAILFAST")
            .csv(path))


def read_csv_quarantined(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8",
                         max_bad_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of a CSV with a header line, columns by position.

    The quarantine has a row (file, line, reason) for every line that does not fit the
    schema: fields missing or left over, an unclosed quote, a value of another type. Good
    and quarantined rows add up to the non-empty lines. More than ``max_bad_share``
    of bad lines raise ``TooManyBadLines``. Quoted line breaks are not supported. The parsed lines are written once, so the files
    are parsed once whatever reads the two frames.
    """
    # whole lines first: one column with no separator or quote that occurs
    raw = (spark.read.schema("_line string").option("header", True).option("enforceSchema", True)
           .option("encoding", encoding).options(sep="\x01", quote="\x02", escape="\x03").csv(path))
    parsed = F.from_csv("_line", F.lit(f"{_ddl(schema)}, {CORRUPT} string"), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"'})
    wrong = F.when(F.col("_r")[CORRUPT].isNotNull() | (_quotes("_line") % 2 == 1), _reason(F.col("_line"), schema))
    lines = materialize(raw.select(F.col("_metadata.file_path").alias("_file"), "_line", parsed.alias("_r"))
                        .withColumn("_reason", wrong), "csv")
    bad = lines.filter("_reason IS NOT NULL").select(
        F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    total, failed = lines.agg(F.count(F.lit(1)), F.count("_reason")).first()
    if failed > max_bad_share * total:
        few = [f"{r['reason']}: {r['line'][:80]}" for r in bad.limit(3).collect()]
        raise TooManyBadLines(f"{failed} of {total} lines of {path} do not fit ({'; '.join(few)})")
    good = lines.filter("_reason IS NULL")
    return good.select(*[F.col("_r")[c].alias(c) for c in schema.fieldNames()]), bad


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _quotes(line: Column | str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _reason(line: Column, schema: T.StructType) -> Column:
    """Why a line does not fit: its quotes, its number of fields, or the first value of another type."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "q")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = F.from_csv(line, F.lit(_ddl(text)), {"escape": '"'})
    types = [F.when(parsed[f.name].isNotNull() & parsed[f.name].try_cast(f.dataType).isNull(),
                    F.lit(f"{f.name} is no {f.dataType.simpleString()}")) for f in schema.fields]
    return (F.when(_quotes(line) % 2 == 1, F.lit("unclosed quote"))
            .when(fields != len(schema.fields), F.concat(fields.cast("string"), F.lit(f" fields instead of {len(schema.fields)}")))
            .otherwise(F.coalesce(*types, F.lit("malformed"))))


def payload_variant(df: DataFrame, column: str, fields: dict[str, str], defaults: dict | None = None,
                    required: tuple = (), keep: str = "payload") -> DataFrame:
    """JSON text of unknown shape as a variant column ``keep`` beside typed fields.

    ``fields`` maps a name to its type; the value is taken from the path ``$.<name>`` (or, given
    as (path, type), from that path) and is null where it is missing or of another type,
    before ``defaults`` fill in. Malformed JSON gives a null variant. ``ok``: the text is
    JSON and all ``required`` fields are there.
    """
    v, defaults = F.col(keep), defaults or {}
    out = df.withColumn(keep, F.try_parse_json(F.col(column)))
    spec = {name: kind if isinstance(kind, tuple) else (f"$.{name}", kind) for name, kind in fields.items()}
    value = {name: F.try_variant_get(v, path, kind) for name, (path, kind) in spec.items()}
    ok = reduce(lambda a, name: a & value[name].isNotNull(), required, v.isNotNull())
    typed = [(F.coalesce(x, F.lit(defaults[n]).cast(spec[n][1])) if n in defaults else x).alias(n)
             for n, x in value.items()]
    return out.select(*[c for c in df.columns if c != column], keep, *typed, ok.alias("ok"))


def payload_fields(df: DataFrame, column: str, schema: str | T.StructType,
                   defaults: dict | None = None, required: tuple = ()) -> DataFrame:
    """Parse a JSON text column into typed columns.

    ``defaults`` fill fields that are missing (a missing repository counter is
    0); ``required`` fields void the whole record when any is missing: the
    result gets ``ok`` = all of them present.
    """
    parsed = F.from_json(F.col(column), schema)
    fields = schema.fieldNames() if isinstance(schema, T.StructType) else [
        f.strip().split()[0] for f in schema.split(",")]
    out = [F.col(c) for c in df.columns if c != column]
    defaults = defaults or {}
    for name in fields:
        v: Column = parsed.getField(name)
        if name in defaults:
            v = F.coalesce(v, F.lit(defaults[name]))
        out.append(v.alias(name))
    if required:
        ok = F.lit(True)
        for name in required:
            ok = ok & parsed.getField(name).isNotNull()
        out.append(ok.alias("ok"))
    return df.select(*out)
