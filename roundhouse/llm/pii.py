"""Personal data: base patterns plus bootstrapped contextual extraction, DataFrame functions only.

The base spans come from four fixed patterns. Their occurrences seed a graph
of lexical patterns (the words around a slot) and instances (what fills it):
a pattern trusts as much as its distinct instances are known, an instance as
much as the patterns that hold it; a few rounds later confident patterns name
identifiers that no base pattern describes.

Java's matcher recurses on repeated groups and rescans long runs, so the
patterns are written over single characters: separators that join two digits
or two labels are first replaced by a joining character, and a match may only
begin where a run begins (or where the match before ended).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

KINDS = ("email", "ip", "card", "phone")
JOIN = "\x01"   # stands for a separator inside a match
SPACE = r"\x20\x09-\x0D"
CONTEXT = 64    # characters looked at on either side of a slot
ROUNDS = 3
MIN_SUPPORT = 4      # distinct trusted instances of a usable pattern
MIN_CONFIDENCE = 0.8

_LOCAL = r"A-Za-z0-9._%+\x01-"
_RUN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x01]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_JOINED = {
    "email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
    "card": r"(?<=[0-9])[\x20-](?=[0-9])",
}
_IDENTIFIER = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"


def running_sum(x: Column, block: int = 64) -> Column:
    """Sums before each element of an array of ints, in blocks so that no array is copied n times."""
    def plain(a: Column) -> Column:
        return F.aggregate(
            a, F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("o")),
            lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")))["o"]

    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
                         lambda i: F.slice(x, i * block + 1, block))
    made = F.flatten(F.zip_with(blocks, plain(F.transform(blocks, total)),
                                lambda b, start: F.transform(plain(b), lambda v: v + start)))
    return F.when(F.size(x) > 0, made).otherwise(F.array().cast("array<long>"))


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string holds."""
    def value(i):
        v = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | (
            (F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


_SPAN = "struct<start: long, kind: int, end: long, value: string, l: string, r: string>"


def _with_spans(df: DataFrame, name: str, kind: int) -> DataFrame:
    """Adds ``name``: valid spans with the text around them, from matches _f and the text between, _b.

    The sums are a column of their own: an expression inside a lambda would be
    evaluated again for every element.
    """
    every = F.sequence(F.lit(0), F.size("_f") - 1)
    some = F.size("_f") > 0
    df = df.withColumn("_n", F.when(some, F.transform(
        every, lambda i: (F.length(F.get("_b", i)) + F.length(F.get("_f", i))).cast("long")))
        .otherwise(F.array().cast("array<long>")))
    df = df.withColumn("_p", running_sum(F.col("_n")))
    made = F.transform(every, lambda i: F.struct(
        (F.get("_p", i) + F.length(F.get("_b", i))).alias("start"), F.lit(kind).alias("kind"),
        (F.get("_p", i) + F.get("_n", i)).alias("end"),
        F.get("_f", i).alias("value"), F.right(F.get("_b", i), F.lit(CONTEXT)).alias("l"),
        F.left(F.get("_b", i + 1), F.lit(CONTEXT)).alias("r")))
    made = F.when(some, made).otherwise(F.array()).cast(f"array<{_SPAN}>")
    return df.withColumn(name, F.filter(made, _test(name[1:])))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``base`` (valid base spans by start, then kind) and ``other`` (words that
    look like identifiers, kind -1; some overlap base spans)."""
    out = docs.withColumn("_t", F.translate(F.coalesce("text", F.lit("")), JOIN, " "))
    digit, none = F.col("_t").rlike("[0-9]"), F.array().cast("array<string>")
    wanted = {"email": F.col("_t").contains("@"), "phone": F.col("_t").contains("+") & digit}
    searches = [(kind, k, _RUN[kind], wanted.get(kind, digit)) for k, kind in enumerate(KINDS)]
    searches.append(("other", -1, _IDENTIFIER, digit | wanted["email"]))
    for name, k, run, use in searches:
        joined = F.regexp_replace("_t", _JOINED[name], JOIN) if name in _JOINED else F.col("_t")
        out = out.withColumn("_j", F.when(use, joined))
        out = out.withColumn("_f", F.when(use, F.regexp_extract_all("_j", F.lit(run), F.lit(0))).otherwise(none))
        out = out.withColumn("_b", F.when(F.size("_f") > 0, F.split("_j", run, -1)).otherwise(none))
        out = _with_spans(out, f"_{name}", k)
    found = F.array_sort(F.concat(*[F.col(f"_{kind}") for kind in KINDS]))
    return out.select(*docs.columns, found.alias("base"), F.col("_other").alias("other"))


def _test(kind: str):
    return lambda x: _valid(kind, x["value"])


def free(rows: DataFrame) -> DataFrame:
    """Occurrences without the unknown ones that overlap a base span of their row."""
    known = F.col("kind") >= 0
    order = Window.partitionBy("row").orderBy("start", F.desc("kind"))
    ended = F.max(F.when(known, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(known, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (rows.withColumn("_e", ended).withColumn("_s", begins)
            .filter(known | ((F.coalesce("_e", F.lit(0)) <= F.col("start")) & (F.coalesce("_s", "end") >= F.col("end"))))
            .drop("_e", "_s"))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _patterns(rows: DataFrame) -> DataFrame:
    """The lexical patterns of each occurrence: two words before; one before and one after."""
    left = F.filter(F.split(F.lower("l"), rf"[{SPACE}]+"), lambda w: w != "")
    right = F.filter(F.split(F.lower("r"), rf"[{SPACE}]+"), lambda w: w != "")
    rows = rows.withColumn("_l", left).withColumn("_r", right)
    first, second = F.get("_l", F.size("_l") - 1), F.get("_l", F.size("_l") - 2)
    made = F.array(F.concat(F.lit("before "), second, F.lit(" "), first),
                   F.concat(F.lit("around "), first, F.lit(" "), F.get("_r", 0)))
    made = F.filter(made, lambda p: p.isNotNull())
    return rows.withColumn("pattern", F.explode(made)).drop("_l", "_r", "l", "r")


def bootstrap(occurrences: DataFrame, scratch: Written, rounds: int = ROUNDS, support: int = MIN_SUPPORT,
              confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Occurrences (row, start, end, kind) that confident patterns and instances agree on.

    ``occurrences``: row, start, end, kind (-1 unknown), value, l, r. The graph
    holds every distinct (pattern, value) once, so copies of a text add no
    trust. A pattern's confidence in a kind is the trust of its instances over
    their number plus one, an instance's is the chance that not all of its
    patterns are wrong.
    """
    links = scratch.put(_patterns(free(occurrences)), "links")
    graph = scratch.put(links.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    number = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    seeds = graph.filter("kind >= 0").select("value", "kind", F.lit(1.0).alias("trust"), F.lit(True).alias("seed")).distinct()
    trusted = seeds
    patterns = None
    for i in range(rounds):
        scored = (graph.select("pattern", "value").join(trusted, "value").groupBy("pattern", "kind")
                  .agg(F.sum("trust").alias("s"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= support)
                  .join(number, "pattern").withColumn("confidence", F.col("s") / (F.col("n") + 1))
                  .filter(F.col("confidence") >= confidence).select("pattern", "kind", "confidence"))
        patterns = scratch.put(scored, f"patterns-{i}")
        new = (graph.filter("kind < 0").select("pattern", "value").join(patterns, "pattern").groupBy("value", "kind")
               .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("trust"))
               .filter(F.col("trust") >= confidence))
        best = new.groupBy("value").agg(F.max(F.struct("trust", -F.col("kind"))).alias("b")) \
            .select("value", (-F.col("b")["col2"]).alias("kind"), F.col("b.trust").alias("trust"), F.lit(False).alias("seed"))
        trusted = scratch.put(seeds.unionByName(best), f"trusted-{i}")
    found = (links.filter("kind < 0").drop("kind").join(patterns, "pattern")
             .join(trusted.filter(~F.col("seed")).select("value", "kind"), ["value", "kind"]))
    return found.select("row", "start", "end", "kind").distinct()


def find(docs: DataFrame, keep: list[str] | None = None, scratch: Written | None = None, **options) -> DataFrame:
    """``keep`` columns plus base and spans (arrays of start, kind, end) per document.

    Null and empty texts have no span. Rows that repeat a doc_id stay rows of
    their own; extra columns are ignored unless kept.
    """
    keep = keep if keep is not None else ["doc_id"]
    scratch = scratch or Written(docs.sparkSession, "pii")
    names = [F.col(c).alias(f"c_{c}") for c in keep]
    rows = base_spans(docs.select("text", *names))
    rows = scratch.put(rows.withColumn("row", F.monotonically_increasing_id())
                       .select("row", *[f"c_{c}" for c in keep], "base", "other"), "base")
    each = rows.filter((F.size("base") > 0) | (F.size("other") > 0)).select(
        "row", F.explode(F.concat("base", "other")).alias("o")).select("row", "o.*")
    more = bootstrap(each, scratch, **options)
    extra = more.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    return rows.join(extra, "row", "left").select(
        *[F.col(f"c_{c}").alias(c) for c in keep], plain.alias("base"),
        F.array_sort(F.concat(plain, F.coalesce("more", none))).alias("spans"))


def redact(docs: DataFrame, scratch: Written | None = None, **options) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets.

    Overlapping spans become one, named after the first. Extra columns stay, whatever
    their names.
    """
    mine = [f"u_{i}" for i in range(len(docs.columns))]
    found = find(docs.select(F.col("text"), *[F.col(c).alias(u) for c, u in zip(docs.columns, mine)
                                              if c != "text"]),
                 ["text", *[u for c, u in zip(docs.columns, mine) if c != "text"]], scratch, **options)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))) \
            .otherwise(F.struct(x["end"].alias("at"), F.concat(
                acc["out"], F.array(gap, F.get(names, x["kind"]))).alias("out")))

    cut = F.aggregate("spans", start, step)
    rest = F.substring("text", (cut["at"] + 1).cast("int"), F.length("text"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(cut["out"], ""), rest)).otherwise(F.col("text"))
    return found.select(*[(text if c == "text" else F.col(u)).alias(c) for c, u in zip(docs.columns, mine)])
