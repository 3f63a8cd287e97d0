"""Feeds whose schema drifts between files: tagged-union inference, one canonical table, a change report.

Every cell of every record votes for one alternative of a tagged union (a bit). The votes of a path, that
is of one column of one file, are fused by ``bit_or``, a map-side combinable aggregate, so no file's rows
ever meet in one task and no record is parsed twice. The union decides the path's type; a file's schema is
compared with that of the file before it in the feed.

Alternatives: boolean (JSON only), integer (for open_time and close_time one alternative each for seconds,
milliseconds and microseconds), decimal (a number, some with fraction or point), text (anything else, and
every mixture with text).

Defined results: null records, blank cells and JSON nulls vote for nothing, though a JSON key counts as
present; records that are not JSON objects in a jsonl file say nothing, nor do JSON objects in a csv file;
nested values are text; of a key that an object repeats every value votes; rows of unknown files are left out;
files without rows have the columns of their header; repeated rows change nothing; further columns of the
inputs are ignored; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzbar.functions.fields import ARCHIVE_CSV_FIELDS, EPOCH_FIELDS, MEANINGS, QUANTITY_OF, WORD_OF
from quartzbar.session import checkpointed

BOOL, INT_S, INT_MS, INT_US, DECIMAL, TEXT = (1 << i for i in range(6))
INTEGER = INT_S | INT_MS | INT_US
#: An integer is of seconds below 10^11, of milliseconds below 10^14 and of microseconds beyond.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"


def alternative(value: Column, kind: Column) -> Column:
    """The bit that a value votes for; kind: string, bare (JSON) or cell (CSV). Null: no vote."""
    digits = F.length(F.regexp_replace(F.regexp_replace(value, r"^[+-]", ""), r"^0+(?=[0-9])", ""))
    return (
        F.when(value.isNull() | ((kind != "string") & (value == "")) | ((kind == "bare") & (value == "null")), None)
        .when((kind == "string") & (F.trim(value) == ""), None)
        .when(kind == "string", TEXT)
        .when((kind == "bare") & value.isin("true", "false"), BOOL)
        .when(value.rlike(_INTEGER), F.when(digits <= 11, INT_S).when(digits <= 14, INT_MS).otherwise(INT_US))
        .when(value.rlike(_NUMBER), DECIMAL)
        .otherwise(TEXT)
    )


def type_name(mask: Column, field: Column) -> Column:
    """The name of a tagged union's type; null without votes."""
    only = lambda bits: mask.bitwiseAND(F.lit((1 << 6) - 1 - bits)) == 0
    epoch = field.isin(*EPOCH_FIELDS)
    return (
        F.when(mask.isNull() | (mask == 0), None)
        .when(only(BOOL), "boolean")
        .when(epoch & (mask == INT_S), "integer_s")
        .when(epoch & (mask == INT_MS), "integer_ms")
        .when(epoch & (mask == INT_US), "integer_us")
        .when(only(INTEGER), "integer")
        .when(only(INTEGER | DECIMAL), "decimal")
        .otherwise("text")
    )


def alternatives(mask: Column, field: Column) -> Column:
    """The alternatives of a tagged union, as an array of names; integers have a unit in epoch fields only."""
    epoch = field.isin(*EPOCH_FIELDS)
    has = lambda bits: mask.bitwiseAND(F.lit(bits)) != 0
    units = [F.when(epoch & has(b), n) for b, n in ((INT_S, "int_s"), (INT_MS, "int_ms"), (INT_US, "int_us"))]
    names = [F.when(has(BOOL), "boolean"), F.when(~epoch & has(INTEGER), "integer"), *units, F.when(has(DECIMAL), "decimal"), F.when(has(TEXT), "text")]
    return F.array_compact(F.array(*names))


def quantity(name: Column) -> Column:
    """The quantity that a column name means; the name itself where none is known.

    A known spelling, as it stands (v and V differ), or words that all mean something: takerBuyBaseAssetVolume,
    num_trades, ClosePrice.
    """
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    parts = F.split(F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_")), r"[_\s.-]+")
    words = F.transform(parts, lambda w: F.try_element_at(table(WORD_OF), w))
    together = F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")
    meant = F.when(~F.exists(words, lambda w: w.isNull()), F.try_element_at(table(MEANINGS), together))
    return F.coalesce(F.try_element_at(table(QUANTITY_OF), name), F.when(F.length(name) > 2, meant), name)


def _members(record: Column) -> Column:
    """The members of a JSON object as array<struct<name, kind, value>>; null if it is none.

    Every member has the kind of its own value: string (nested values and what is no number of JSON, too) or bare.
    Parsed once into typed variants, so a value may be as long and as deep as the parser allows.
    """

    def member(e: Column) -> Column:
        kind, text = F.schema_of_variant(e["value"]), e["value"].cast("string")
        whole = kind.endswith(",0)") & (F.regexp_extract(kind, r"[0-9]+", 0).cast("int") < 19)
        return F.struct(
            e["key"].alias("name"),
            F.when(kind.rlike("^(BOOLEAN|BIGINT|DECIMAL|VOID)") | (kind.startswith("DOUBLE") & text.rlike("[0-9]")), "bare").otherwise("string").alias("kind"),
            # A decimal such as 12.0 keeps its point; whole numbers beyond 64 bits have none.
            F.when(kind.startswith("VOID"), "null").when(kind.startswith("DECIMAL") & whole, F.concat(text, F.lit(".0"))).otherwise(text).alias("value"),
        )

    return F.transform(F.map_entries(F.from_json(record, "map<string,variant>")), member)


def _cells(record: Column) -> Column:
    """The cells of a CSV record as array<struct<name, kind, value>>, named by position."""
    return F.transform(
        F.split(record, ",", -1),
        lambda x, i: F.struct(i.cast("string").alias("name"), F.lit("cell").alias("kind"), F.trim(x).alias("value")),
    )


def header_columns(files: DataFrame) -> DataFrame:
    """file_id, pos, name of every header column."""
    return files.where("header IS NOT NULL").select(
        "file_id", F.posexplode(F.split(F.regexp_replace("header", "^\ufeff", ""), ",", -1)).alias("pos", "name")
    ).select("file_id", F.col("pos").cast("string").alias("pos"), F.trim("name").alias("name"))


def path_unions(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per file and column: file_id, name, mask (the fused tagged union; 0 without a value).

    Rows are folded before they meet their files: JSON members by name, CSV cells by position, each under
    its reading. So the hot file's rows shrink to a few paths in the map-side aggregate.
    """
    members = F.when(F.ltrim("record").startswith("{"), _members(F.col("record")))
    votes = (
        rows.where("record IS NOT NULL AND file_id IS NOT NULL")
        .select("file_id", "record", members.alias("members"))
        .select("file_id", F.when(F.col("members").isNotNull(), "jsonl").otherwise("csv").alias("form"), F.explode(F.coalesce("members", _cells(F.col("record")))).alias("m"))
        .select("file_id", "form", F.col("m.name").alias("path"), alternative(F.col("m.value"), F.col("m.kind")).alias("bit"))
        .groupBy("file_id", "form", "path")
        .agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("mask"))
    )
    # A few rows per file, read several times from here on; the records are read once.
    votes = checkpointed(votes)
    known = files.select("file_id", F.col("file_format").alias("form"))
    votes = votes.join(known, ["file_id", "form"])
    json_paths = votes.where("form = 'jsonl'").select("file_id", F.trim("path").alias("name"), "mask")
    csv_paths = (
        header_columns(files.where("file_format = 'csv'"))
        .join(votes.where("form = 'csv'").select("file_id", F.col("path").alias("pos"), "mask"), ["file_id", "pos"], "left")
        .select("file_id", "name", F.coalesce("mask", F.lit(0)).alias("mask"))
    )
    return json_paths.unionByName(csv_paths).groupBy("file_id", "name").agg(F.bit_or("mask").alias("mask"))


def file_schemas(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per file and quantity: feed, file_seq, file_id, field, names, mask, type and known (both carried if no value).

    known is the mask of the last file with a value.
    """
    paths = path_unions(files, rows).withColumn("field", quantity(F.col("name")))
    fields = paths.groupBy("file_id", "field").agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.bit_or("mask").alias("mask")
    )
    # Windows run over files and fields, not rows: a feed has as many entries as files times columns.
    by_feed = Window.partitionBy("feed").orderBy("file_seq", "file_id")
    order = files.select("feed", "file_seq", "file_id").withColumn("k", F.row_number().over(by_feed))
    seen = fields.join(order, "file_id").withColumn("own", type_name(F.col("mask"), F.col("field")))
    path = Window.partitionBy("feed", "field").orderBy("k")
    seen = seen.withColumn("start", F.when(F.lag("k").over(path) == F.col("k") - 1, 0).otherwise(1))
    seen = seen.withColumn("run", F.sum("start").over(path))
    stay = Window.partitionBy("feed", "field", "run").orderBy("k")
    known = F.coalesce(F.last(F.when(F.col("mask") != 0, F.col("mask")), ignorenulls=True).over(stay), F.lit(0))
    return seen.withColumn("type", F.last("own", ignorenulls=True).over(stay)).withColumn("known", known).select(
        "feed", "file_seq", "file_id", "k", "field", "names", "mask", "own", "type", "known"
    )


def schema_changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, field, change (added, removed, renamed, retyped, alternative), with names and types before and after.

    An alternative is one that the file before, or the last one with a value, lacks. It has a row of its own
    unless it changes the type or comes with an added quantity: then it stands in that row.
    """
    schemas = file_schemas(files, rows)
    path = Window.partitionBy("feed", "field").orderBy("k")
    by_feed = Window.partitionBy("feed").orderBy("file_seq", "file_id")
    order = files.select("feed", "file_id", F.row_number().over(by_feed).alias("k"))
    s = (
        schemas.withColumn("before_k", F.lag("k").over(path))
        .withColumn("after_k", F.lead("k").over(path))
        .withColumn("before_names", F.when(F.col("before_k") == F.col("k") - 1, F.lag("names").over(path)))
        .withColumn("before_type", F.when(F.col("before_k") == F.col("k") - 1, F.lag("type").over(path)))
        .withColumn("before_mask", F.when(F.col("before_k") == F.col("k") - 1, F.lag("known").over(path)))
        .withColumn("new_alternatives", F.array_except(alternatives(F.col("mask"), F.col("field")), alternatives(F.coalesce("before_mask", F.lit(0)), F.col("field"))))
    )
    present = s.select(
        "feed", "file_id", "field",
        F.explode(F.array_compact(F.array(
            F.when((F.col("k") > 1) & F.col("before_names").isNull(), "added"),
            F.when(F.col("before_names").isNotNull() & (F.col("before_names") != F.col("names")), "renamed"),
            F.when(F.col("before_type") != F.col("type"), "retyped"),
            F.when(F.col("before_names").isNotNull() & (F.size("new_alternatives") > 0) & (F.coalesce("before_type", "type") == F.col("type")), "alternative"),
        ))).alias("change"),
        "before_names", "names", "before_type", "type", "new_alternatives",
    )
    # What the next file of the feed lacks came to its end there.
    gone = (
        s.where(F.col("after_k").isNull() | (F.col("after_k") != F.col("k") + 1))
        .select("feed", (F.col("k") + 1).alias("k"), "field", F.col("names").alias("before_names"), F.col("type").alias("before_type"))
        .join(order, ["feed", "k"])
        .select("feed", "file_id", "field", F.lit("removed").alias("change"), "before_names",
                F.lit(None).cast("array<string>").alias("names"), "before_type", F.lit(None).cast("string").alias("type"),
                F.lit(None).cast("array<string>").alias("new_alternatives"))
    )
    return present.unionByName(gone)


def _number(value: Column) -> Column:
    """Canonical conversion of a number that may carry a unit."""
    return F.regexp_extract(value, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*[A-Za-z]*\s*$", 1).try_cast("double")


def _instant(value: Column) -> Column:
    """Canonical conversion of an instant: an epoch in seconds, milliseconds or microseconds, or ISO 8601."""
    digits = F.length(F.regexp_replace(value, r"^0+(?=[0-9])", ""))
    scale = F.when(digits <= 11, 1_000_000).when(digits <= 14, 1_000).otherwise(1)
    return F.when(value.rlike(r"^[0-9]+$"), F.timestamp_micros(value.try_cast("bigint") * scale)).otherwise(
        F.try_to_timestamp(value)
    )


def branch(value: Column, kind: Column) -> Column:
    """A value in the typed branch of its alternative; integers beyond 64 bits are decimals, blanks are text."""
    bit = F.coalesce(alternative(value, kind), F.lit(TEXT))
    whole = F.when(bit.bitwiseAND(F.lit(INTEGER)) != 0, value.try_cast("bigint"))
    number = F.when((bit.bitwiseAND(F.lit(INTEGER | DECIMAL)) != 0) & whole.isNull(), value.try_cast("double"))
    name = F.when(bit == BOOL, "boolean").when(whole.isNotNull(), "integer").when(number.isNotNull(), "decimal").otherwise("text")
    return F.struct(
        name.alias("alternative"), F.when(bit == BOOL, value.try_cast("boolean")).alias("boolean"), whole.alias("integer"),
        number.alias("decimal"), F.when(name == "text", value).alias("text"),
    )


def _header(header: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(header, "^\ufeff", ""), ",", -1), lambda x: F.trim(x))


def consistent_bars(files: DataFrame, rows: DataFrame) -> DataFrame:
    """All records of all files in one bar table.

    Each quantity has its canonical column and, where a value could not be converted, ``unconverted`` (map of
    quantity to text) keeps it; quantities outside the bar are in ``extras`` (map of name to text). ``branches``
    has the values of both by their alternative, each in the typed branch of it. Of several values of one
    quantity or name in a record the first that is not empty holds.
    """
    # Names are read once per file, before the join; a hot file is split by the adaptive skew join.
    known = files.select("file_id", "feed", "file_seq", "symbol", "file_format", F.transform(_header(F.col("header")), lambda n: F.struct(n.alias("name"), quantity(n).alias("field"))).alias("columns"))
    joined = rows.select("file_id", "row_no", "record").join(known, "file_id")
    csv = F.transform(
        F.arrays_zip(F.col("columns").alias("c"), F.transform(F.split("record", ",", -1), lambda x: F.trim(x)).alias("value")),
        lambda x: F.struct(x["c"]["name"].alias("name"), x["c"]["field"].alias("field"), F.lit("cell").alias("kind"), x["value"].alias("value")),
    )
    json = F.transform(
        _members(F.col("record")),
        lambda x: F.struct(
            F.trim(x["name"]).alias("name"), quantity(F.trim(x["name"])).alias("field"), x["kind"].alias("kind"), F.when(~((x["kind"] == "bare") & (x["value"] == "null")), x["value"]).alias("value")
        ),
    )
    entries = F.filter(
        F.when(F.col("file_format") == "csv", csv).otherwise(json), lambda x: x["name"].isNotNull() & x["value"].isNotNull() & (F.trim(x["value"]) != "")
    )
    bars = joined.select("file_id", "feed", "file_seq", "symbol", "row_no", F.coalesce(entries, F.array()).alias("entries"))
    of = lambda f: F.get(F.filter("entries", lambda x: x["field"] == f), F.lit(0))
    bars = bars.withColumns({f"cell_{f}": of(f) for f in ARCHIVE_CSV_FIELDS})
    bars = bars.withColumn("rest", F.filter("entries", lambda x: ~x["field"].isin(*ARCHIVE_CSV_FIELDS)))
    out = {}
    for f in ARCHIVE_CSV_FIELDS:
        value = F.col(f"cell_{f}.value")
        if f in EPOCH_FIELDS:
            out[f] = _instant(value)
        elif f == "ignore":
            out[f] = value
        else:
            out[f] = _number(value)
    bars = bars.withColumns({f"out_{f}": c for f, c in out.items()})
    kept = [F.when(F.col(f"cell_{f}").isNotNull() & F.col(f"out_{f}").isNull(), F.struct(F.lit(f).alias("name"), F.col(f"cell_{f}.kind").alias("kind"), F.col(f"cell_{f}.value").alias("value"))) for f in ARCHIVE_CSV_FIELDS]
    names = F.transform("rest", lambda x: x["name"])
    firsts = F.filter("rest", lambda x, i: F.array_position(names, x["name"]) == i + 1)
    bars = bars.withColumns({"kept": F.array_compact(F.array(*kept)), "others": F.transform(firsts, lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["value"].alias("value")))})
    texts = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["name"], x["value"])))
    # A name of the others can be that of no quantity, so the two have no key in common.
    branches = F.map_from_entries(F.transform(F.concat("kept", "others"), lambda x: F.struct(x["name"], branch(x["value"], x["kind"]))))
    return bars.select(
        "file_id", "feed", "file_seq", "symbol", "row_no",
        *(F.col(f"out_{f}").alias(f) for f in ARCHIVE_CSV_FIELDS),
        texts("kept").alias("unconverted"), texts("others").alias("extras"), branches.alias("branches"),
    )
