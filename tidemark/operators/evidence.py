"""Evidence for readiness findings beyond the profile: affixes around numbers, outliers, repeated rows.

`column_evidence` gives one row per column, `with_evidence` adds the actions that follow from it to findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.cells import cell, literal_rows, long_form, type_of
from tidemark.functions.convert import fits_date
from tidemark.operators.findings import SEVERITIES, ReportRules, plain
from tidemark.operators.profile import column_dictionary, plain_key
from tidemark.operators.quality import duplicate_rows, iqr_outliers

# A number with texts before and after it, none of which holds a digit or spans lines.
SPLIT_NUMBER = r"^([^0-9\n.,+-]{0,16})([+-]?[0-9][0-9.,]*)([^0-9\n]{0,16})$"


def affixes(df: DataFrame) -> DataFrame:
    """`column, before, after, n_affix, n_split`: the most frequent pair of texts around the numbers of text cells.

    A cell is split after quotes and outer blanks are gone; cells that hold no single number, and dates,
    are not split. `n_affix` cells have the pair, `n_split` any. Equal frequencies go to the smaller pair. Pairs
    are counted where cells are read, so a column gives a row for each pair and task, and only
    a column of free text around numbers has many pairs.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    schema = "column string, before string, after string, n_affix long, n_split long"
    if not texts:
        return literal_rows(df.sparkSession, [], schema)
    cells = long_form(df, {c: cell(c) for c in texts})
    # Cheap first: any cell that splits has a digit behind at most 16 other signs, quotes and blanks apart.
    may = F.col("value").rlike(r"""^[\s'"]*(?:[^0-9\n.,+-]['"]*){0,16}[+-]?['"]*[0-9]""")
    core = cells.where(may).select("column", plain(F.col("value")).alias("core"))
    split = core.where(F.col("core").rlike(SPLIT_NUMBER) & ~fits_date(F.col("core"))).select(
        "column", F.regexp_extract("core", SPLIT_NUMBER, 1).alias("before"), F.regexp_extract("core", SPLIT_NUMBER, 3).alias("after")
    )
    pairs = split.groupBy("column", "before", "after").agg(F.count("*").alias("n_affix"))
    best = Window.partitionBy("column").orderBy(F.desc("n_affix"), "before", "after")
    ranked = pairs.withColumns({"place": F.row_number().over(best), "n_split": F.sum("n_affix").over(Window.partitionBy("column"))})
    return ranked.where("place = 1").drop("place").select("column", "before", "after", "n_affix", "n_split")


def column_evidence(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: `before, after, n_affix, n_split` (text), quartile fences and counts beyond them (numeric), `n_valid`.

    `n_duplicates` is the table's number of repeated rows, the same in every row.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    beyond = iqr_outliers(df, numeric, approx=approx).select(
        "column", "lower_bound", "upper_bound", (F.col("n_lower") + F.col("n_upper")).alias("n_outliers"), F.col("n_valid").alias("n_numbers")
    )
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    known_texts = df.agg(*[F.count(plain_key(df, c)).alias(f"n{i}") for i, c in enumerate(texts)]) if texts else None
    # One row per table column, so the broadcasts are bounded by the schema.
    joined = column_dictionary(df).join(F.broadcast(beyond), "column", "left").join(F.broadcast(affixes(df)), "column", "left")
    if known_texts is not None:
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_texts")) for i, c in enumerate(texts)]
        joined = joined.join(F.broadcast(known_texts.select(F.inline(F.array(*rows)))), "column", "left")
    else:
        joined = joined.withColumn("n_texts", F.lit(None).cast("long"))
    repeated = duplicate_rows(df).scalar()
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_outliers", "n_affix", "n_split")}
    return joined.withColumns({**counts, "n_valid": F.coalesce("n_numbers", "n_texts", F.lit(0).cast("long")), "n_duplicates": repeated}).select(
        "column", "before", "after", "n_affix", "n_split", "lower_bound", "upper_bound", "n_outliers", "n_valid", "n_duplicates"
    )


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def with_evidence(
    findings: DataFrame, evidence: DataFrame, rules: ReportRules = ReportRules(), affix_share: float = 0.9, outlier_share: float = 0.05
) -> DataFrame:
    """Findings with `replace_substring` and `modify_numeric_col` where the evidence asks for them.

    `replace_substring` names the texts around the numbers of a column if one pair, not empty, stands in at
    least `affix_share` of its cells; it comes before the conversion that it makes possible, and is as
    urgent as that. `modify_numeric_col` is given for any value beyond the fences, at low severity, and
    medium from `outlier_share` on; columns that only number rows or hold years are left alone. A severity
    never falls.
    """
    has = lambda action: F.exists("suggested_actions", lambda a: a["action_type"] == action)
    named = F.concat_ws(" and ", *[F.when(F.col(c) != "", _quoted(F.col(c))) for c in ("before", "after")])
    affixed = (F.col("n_affix") >= F.lit(affix_share) * F.col("n_valid")) & (F.col("n_affix") > 0) & (F.concat("before", "after") != "")
    odd = (F.col("n_outliers") > 0) & ~has("drop_column") & ~has("create_derived_col")
    counted = F.concat(F.col("n_outliers").cast("string"), F.lit(" of "), F.col("n_valid").cast("string"))
    replace = F.struct(
        F.concat(named, F.lit(" stands around the numbers of "), F.col("n_affix").cast("string"), F.lit(" values.")).alias("explanation"),
        F.lit("replace_substring").alias("action_type"),
    )
    modify = F.struct(
        F.concat(counted, F.lit(" values lie beyond 1.5 interquartile ranges.")).alias("explanation"), F.lit("modify_numeric_col").alias("action_type")
    )
    actions = F.concat(
        F.when(affixed, F.array(replace)).otherwise(F.array()), F.col("suggested_actions"), F.when(odd, F.array(modify)).otherwise(F.array())
    )
    often = F.col("n_outliers") >= F.lit(outlier_share) * F.col("n_valid")
    levels = F.array(*[F.lit(s) for s in SEVERITIES])
    own = F.array_position(levels, F.col("severity"))
    asked = F.least(
        own,
        F.when(affixed, F.array_position(levels, F.lit("high"))),
        F.when(odd, F.array_position(levels, F.when(often, F.lit("medium")).otherwise(F.lit("low")))),
    )
    joined = findings.join(F.broadcast(evidence), "column", "left")
    return joined.select("position", "column", F.element_at(levels, asked.cast("int")).alias("severity"), actions.alias("suggested_actions"))


def text_counts(df: DataFrame, column: str) -> DataFrame:
    """`before, after, n` of all pairs around the numbers of one text column, to see what a replacement would leave."""
    if not isinstance(type_of(df, column), T.StringType):
        raise ValueError(f"Column '{column}' is no text.")
    core = df.select(plain(cell(column)).alias("core")).where(F.col("core").rlike(SPLIT_NUMBER))
    return core.groupBy(
        F.regexp_extract("core", SPLIT_NUMBER, 1).alias("before"), F.regexp_extract("core", SPLIT_NUMBER, 3).alias("after")
    ).agg(F.count("*").alias("n"))
