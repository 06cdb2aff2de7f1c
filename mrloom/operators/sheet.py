"""Training sheets: from headers to one row per volume with coded columns and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .ranks import ranked


def to_fields(headers: DataFrame, names: dict[str, str]) -> DataFrame:
    """(file_name, name, value) of every element that a sheet holds. names: tag to name; personal names and unsheeted kinds go."""
    kept = {t: n for t, n in names.items() if n not in S.PERSONAL}
    known = F.create_map(*(F.lit(x) for pair in sorted(kept.items()) for x in pair))
    rows = headers.select("file_name", F.explode("tags").alias("tag", "e")).where(~F.col("e.vr").isin(S.UNSHEETED_KINDS))
    return rows.select("file_name", F.try_element_at(known, F.col("tag")).alias("name"), F.trim(F.array_join("e.Value", "/")).alias("value")).where("name IS NOT NULL")


def field_sheet(fields: DataFrame, columns: list[str], coded: DataFrame | None = None) -> DataFrame:
    """One row per file, one column per field; a coded column of the same name wins. columns: given, so that no pass looks for them."""
    sheet = fields.groupBy("file_name").pivot("name", columns).agg(F.first("value"))
    if coded is None:
        return sheet
    sheet, other = sheet.alias("s"), coded.alias("c")
    both = [c for c in columns if c in coded.columns]
    return sheet.join(other, "file_name", "left").select(
        "file_name",
        *(F.coalesce(F.col(f"c.`{c}`").cast("string"), F.col(f"s.`{c}`")).alias(c) if c in both else F.col(f"s.`{c}`") for c in columns),
        *(F.col(f"c.`{c}`") for c in coded.columns if c not in (*columns, "file_name")),
    )


def ordered_columns(names: list[str], first: list[str] = S.FIRST_COLUMNS) -> list[str]:
    """The preferred names that are there, then the rest, each once."""
    return list(dict.fromkeys([*(n for n in first if n in names), *names]))


def named_rows(sheet: DataFrame, column: str = "FileName") -> DataFrame:
    return sheet.where(F.col(column).isNotNull())


#: Words or values of a vocabulary at most: it becomes as many columns.
VOCABULARY = 10_000


def _vocabulary(values: DataFrame, column: str) -> list[str]:
    found = sorted(r[0] for r in values.limit(VOCABULARY + 1).collect())
    if len(found) > VOCABULARY:
        raise ValueError(f"over {VOCABULARY} values in {column}: give its vocabulary by configuration")
    return found


def array_tokens(sheet: DataFrame, column: str) -> list[str]:
    """The words of a column's distinct values; those with '_' are parted. More than VOCABULARY are an error."""
    words = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\b\w+\b"), F.lit(0)))
    values = sheet.select(column).distinct().select(words.alias("w")).select(F.explode(F.split("w", "_")).alias("w")).where("w <> ''").distinct()
    return _vocabulary(values, column)


def one_hot_array(column: str, tokens: list[str]) -> list[Column]:
    """A flag for each token that stands anywhere in the text, with its case."""
    return [F.coalesce(F.col(column).contains(t), F.lit(False)).cast("int").alias(f"{column}_{t}") for t in tokens]


def token_table(tokens: DataFrame, column: str = "token") -> DataFrame:
    """(token, index) of the distinct tokens, numbered from 0 in their order; of any number, nothing goes to the driver."""
    distinct = tokens.select(F.col(column).alias("token")).where("token <> ''").distinct().withColumn("_all", F.lit(0))
    return ranked(distinct, "_all", [F.col("token")], "_rank", "_size").select("token", (F.col("_rank") - 1).alias("index"))


def array_token_table(sheet: DataFrame, column: str) -> DataFrame:
    """token_table() of the words that array_tokens() finds."""
    words = sheet.select(column).distinct().select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\b\w+\b"), F.lit(0))).alias("w"))
    return token_table(words.select(F.explode(F.split("w", "_")).alias("token")))


def sparse_flags(sheet: DataFrame, column: str, vocabulary: DataFrame, out: str = "flags") -> DataFrame:
    """The sheet with the sorted indices of the tokens that stand anywhere in a column's text, with its case: the ones of a one-hot row, of any width.

    vocabulary: token and index. Each distinct text gives its stretches of the lengths that tokens have, and these are joined with the vocabulary. The lengths, as many
    as the longest token has characters, go to the driver.
    """
    lengths = [r[0] for r in vocabulary.select(F.char_length("token")).distinct().collect()]
    distinct = sheet.select(F.col(f"`{column}`").alias("_text")).where("_text <> ''").distinct()
    starts = distinct.select("_text", F.explode(F.sequence(F.lit(1), F.char_length("_text"))).alias("_at"))
    stretches = starts.select("_text", "_at", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n")).where(F.col("_at") + F.col("_n") - 1 <= F.char_length("_text"))
    found = stretches.select("_text", F.substring("_text", F.col("_at"), F.col("_n")).alias("token")).join(vocabulary, "token").groupBy("_text").agg(F.sort_array(F.collect_set("index")).alias(out))
    joined = sheet.join(found, F.col(f"`{column}`") == F.col("_text"), "left").drop("_text")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<long>")))


def distinct_values(sheet: DataFrame, column: str) -> list[str]:
    return _vocabulary(sheet.select(column).where(F.col(column).isNotNull()).distinct(), column)


def one_hot_text(column: str, values: list[str]) -> list[Column]:
    return [F.coalesce(F.col(column).contains(v), F.lit(False)).cast("int").alias(f"{column}_{v.replace(' ', '_')}") for v in values]


def manufacturer_bucket(c: Column) -> Column:
    out = F.lit("other")
    for name in reversed(S.MANUFACTURERS):
        out = F.when(F.lower(c).contains(name), F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def manufacturer_flags(c: Column, prefix: str = "Manufacturer") -> list[Column]:
    bucket = manufacturer_bucket(c)
    return [F.coalesce(bucket == name, F.lit(False)).cast("int").alias(f"{prefix}_{name}") for name in [*S.MANUFACTURERS, "other"]]


def training_sheet(sheet: DataFrame, config: list[tuple[str, str]], vocabularies: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns by (field, action): keep, one_hot_encoding_from_array, one_hot_encoding_from_str_col. Unknown fields are skipped, names cut."""
    columns: list[Column] = []
    given = vocabularies or {}
    for name, action in config:
        if name not in sheet.columns:
            continue
        if action == "keep":
            columns.append(F.col(f"`{name}`").alias(name[: S.NAME_LIMIT]))
        elif action == "one_hot_encoding_from_array":
            columns += one_hot_array(name, given.get(name) or array_tokens(sheet, name))
        elif name == "Manufacturer":
            columns += manufacturer_flags(F.col(name))
        else:
            columns += one_hot_text(name, given.get(name) or distinct_values(sheet, name))
    return sheet.select(*columns)


def first_of_each(sheet: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row for each value of the keys, nulls being equal; the sheet as it is if a key is no column."""
    if any(k not in sheet.columns for k in keys):
        return sheet
    w = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(order)
    return sheet.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unusable_columns(sheet: DataFrame) -> DataFrame:
    """(column, share, n) of columns with values in at most a twentieth of the rows, or fewer than two distinct values.

    One pass counts and takes the least and greatest value of all columns, which tells those with fewer than two values. Distinct values are counted only of
    the rare columns that are left, as rows of (column, value). The numbers of the first pass, three for each column, go to the driver.
    """
    own = lambda c: F.col(f"`{c}`")
    first = sheet.agg(F.count("*").alias("rows"), *(F.struct(F.count(own(c)).alias("n"), F.min(own(c)).eqNullSafe(F.max(own(c))).alias("one")).alias(f"_{i}") for i, c in enumerate(sheet.columns))).first()
    found, rare, shares = [], [], {}
    for i, c in enumerate(sheet.columns):
        n, one = first[f"_{i}"]
        shares[c] = n / first["rows"] if first["rows"] else 0.0
        if one:
            found.append((c, shares[c], int(n > 0)))
        elif shares[c] <= 0.05:
            rare.append(c)
    spark = sheet.sparkSession
    out = spark.createDataFrame(found, "column string, share double, n long")
    if not rare:
        return out
    # a hash map key: equal values have equal JSON, zeros of either sign too
    value = lambda c: F.to_json(F.struct((own(c) + 0 if dict(sheet.dtypes)[c] in ("double", "float") else own(c)).alias("v")))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.when(own(c).isNotNull(), value(c)).alias("v")) for c in rare)))
    counted = sheet.select(cells.alias("s")).select("s.column", "s.v").where("v IS NOT NULL").distinct().groupBy("column").agg(F.count("*").alias("n"))
    share = F.element_at(F.create_map(*(F.lit(x) for c in rare for x in (c, shares[c]))), F.col("column"))
    return out.unionByName(counted.select("column", share.alias("share"), "n"))


def merge_labels(sheet: DataFrame, labels: DataFrame, key: str = "FileName") -> DataFrame:
    """Left join; the engine broadcasts the labels if their measured size allows it."""
    return sheet.join(labels, key, "left")


def filled(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become 0 in columns with Type in their name, else the sentinel, and so do columns that the sheet lacks; rows with an infinite value go."""
    default = lambda c: 0 if "Type" in c else S.MISSING
    gone = {c: F.lit(float(default(c))) for c in columns if c not in sheet.columns}
    out = sheet.fillna({c: default(c) for c in columns if c not in gone}).withColumns(gone)
    finite = F.lit(True)
    for c in columns:
        finite = finite & (F.abs(F.col(f"`{c}`").cast("double")) < float("inf"))
    return out.where(finite)


def encode_labels(sheet: DataFrame, classes: dict[str, int], label: str = "label") -> DataFrame:
    """Rows of known labels, with their code."""
    codes = F.create_map(*(x for name, code in classes.items() for x in (F.lit(name), F.lit(code))))
    return sheet.where(F.col(label).isin(list(classes))).withColumn("code", F.element_at(codes, F.col(label)))


def orientation_set(headers: DataFrame, labels: DataFrame, keys: list[str], columns: list[str], own: list[str] | None = None) -> DataFrame:
    """Headers with the code of their plane, joined by the keys; rows with a null in any of the columns go.

    Datasets are stacked in one table: a column that names them is among the keys, and labels of one never meet headers of another. own: more columns of the headers.
    """
    codes = F.create_map(*(x for name, code in S.PLANES.items() for x in (F.lit(name), F.lit(code))))
    joined = headers.join(labels, keys).withColumn("code", F.try_element_at(codes, F.col("orientation")))
    return joined.select(*keys, *(own or []), *columns, "code").dropna(subset=[*columns, "code"])
