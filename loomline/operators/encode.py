"""One-hot encoding with a fitted vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.columns import string_columns, unique_names

# A category column becomes one output column per value, so its vocabulary must stay
# far below what one row can hold. Above this bound fitting fails; nothing is dropped.
MAX_VOCABULARY = 5000

Vocabulary = dict[str, list[str]]


def fit_vocabulary(df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_VOCABULARY) -> Vocabulary:
    """Sorted distinct values of each column, found in a single pass.

    Fit once, apply to train, test and every window: all get the same columns.
    """
    columns = list(string_columns(df) if columns is None else columns)
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    distinct = df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()
    rows = distinct.limit(limit * len(columns) + 1).collect()
    for c in columns:
        if len(rows) > limit * len(columns) or sum(r["c"] == c for r in rows) > limit:
            raise ValueError(f"more than {limit} distinct categories in a column of {columns}")
    return {c: sorted(r["v"] for r in rows if r["c"] == c) for c in columns}


def flag_names(vocabulary: Vocabulary, null_flag: bool = False) -> list[str]:
    return unique_names(
        [f"{c}_{v}" for c, values in vocabulary.items() for v in values + (["nan"] if null_flag else [])]
    )


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def flag_conditions(vocabulary: Vocabulary, null_flag: bool = False) -> dict[str, str]:
    """{flag name: SQL condition}: flags can be aggregated without being materialised."""
    conditions = []
    for c, values in vocabulary.items():
        conditions += [f"{quote(c)} = {literal(v)}" for v in values]
        if null_flag:
            conditions.append(f"{quote(c)} IS NULL")
    return dict(zip(flag_names(vocabulary, null_flag), conditions))


def one_hot(
    df: DataFrame,
    vocabulary: Vocabulary | None = None,
    null_flag: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Replace category columns by 0/1 flags; returns the frame and the new names."""
    vocabulary = fit_vocabulary(df) if vocabulary is None else vocabulary
    flags = flag_conditions(vocabulary, null_flag)
    kept = [quote(c) for c in df.columns if c not in vocabulary]
    coded = [f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {quote(name)}" for name, cond in flags.items()]
    return df.selectExpr(*kept, *coded), list(flags)


# ---------------------------------------------------------------- sparse flags

NULL_FLAG = "nan"


def fit_sparse(df: DataFrame, columns: Sequence[str], output: str = "flags") -> PipelineModel:
    """Flags of category columns as one sparse vector column, however many values they have.

    The flags of a column are in the order of its values, then one for NULL and values not seen here. A row
    stores only the flags it has, and the model only the values: nothing is as wide as the vocabulary.
    """
    index, flags = [f"_{output}_index{i}" for i in range(len(columns))], [f"_{output}_flags{i}" for i in range(len(columns))]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(columns), outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=flags, dropLast=False),
            VectorAssembler(inputCols=flags, outputCol=output),
        ]
    ).fit(df.select(*[F.col(quote(c)).cast("string").alias(c) for c in columns]))


def sparse_one_hot(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the vector column; its other columns stay as they are."""
    indexer, output = model.stages[0], model.stages[2].getOutputCol()
    typed = {c: df.schema[c].dataType for c in indexer.getInputCols()}
    text = df.withColumns({c: F.col(quote(c)).cast("string") for c in typed})
    kept = [F.col(quote(c)).cast(typed[c]).alias(c) if c in typed else F.col(quote(c)) for c in df.columns if c != output]
    return model.transform(text).select(*kept, output)


def sparse_names(model: PipelineModel) -> list[tuple[str, str]]:
    """(column, value) of every flag, in order."""
    indexer = model.stages[0]
    return [(c, v) for c, values in zip(indexer.getInputCols(), indexer.labelsArray) for v in [*values, NULL_FLAG]]


def sparse_shares(model: PipelineModel, df: DataFrame, by: str) -> DataFrame:
    """(by, column_name, value, share): how often each flag is set in each group; one vector aggregate."""
    output = model.stages[2].getOutputCol()
    means = sparse_one_hot(model, df).groupBy(by).agg(Summarizer.mean(F.col(output)).alias("m"))
    names = sparse_names(model)
    places = df.sparkSession.createDataFrame([(i, c, v) for i, (c, v) in enumerate(names)], "place int, column_name string, value string")
    long = means.select(by, F.posexplode(vector_to_array("m")).alias("place", "share"))
    return long.join(places, "place").select(by, "column_name", "value", "share")
