"""Readers (O-1..O-12): tolerant of key spellings and shards; every frame keeps its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_KEYS = ("question", "problem", "text", "input")
ANSWER_KEYS = ("answer", "majority_answer")
SCORE_KEYS = ("score", "max_voting_score")


def coalesce_keys(df: DataFrame, keys, default: Column | None = None) -> Column:
    """The first non-null of the columns that exist."""
    found = [F.col(k) for k in keys if k in df.columns]
    return F.coalesce(*found, *( [default] if default is not None else [])) if found or default is not None else F.lit(None).cast("string")


def read_json_questions(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """O-1 / O-2 / O-4: JSON arrays, or objects with ``questions``; corrupt and missing shards are passed over.

    Texts of at most ``least`` characters are dropped; the source falls back to dataset_source and the file's name.
    """
    raw = spark.read.option("multiLine", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).json(path)
    raw = raw.withColumn("__file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1))
    if "questions" in raw.columns and isinstance(raw.schema["questions"].dataType, T.ArrayType):
        raw = raw.select("__file", F.explode("questions").alias("q")).select("__file", "q.*")
    text = F.trim(coalesce_keys(raw, TEXT_KEYS))
    source = coalesce_keys(raw, ("source", "dataset_source"), F.col("__file"))
    return raw.select(text.alias("question"), source.alias("source"), F.col("__file").alias("shard")).where(F.length("question") > least)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """O-3: one object per line; blank lines are skipped."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_named(spark: SparkSession, name: str) -> DataFrame:
    """O-5: ``path`` or ``path@split``."""
    path, _, split = name.partition("@")
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def pool(frames: dict[str, DataFrame]) -> DataFrame:
    """O-6: several datasets as ``(problem, answer, score, diversity_score, source)``; rows with a blank answer, a "None"
    answer or an unreadable score are dropped."""
    parts = []
    for name, df in frames.items():
        parts.append(df.select(
            coalesce_keys(df, ("problem", "question")).cast("string").alias("problem"), coalesce_keys(df, ANSWER_KEYS).cast("string").alias("answer"), coalesce_keys(df, SCORE_KEYS).cast("string").try_cast("double").alias("score"),
            F.coalesce(coalesce_keys(df, ("diversity_score",)).cast("string").try_cast("double"), F.lit(0.0)).alias("diversity_score"), F.lit(name).alias("source"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("problem").isNotNull() & F.col("score").isNotNull() & (F.trim("answer") != "") & (F.col("answer") != "None"))


#: Bytes of a matrix file that a task reads.
MATRIX_BYTES = 64 << 20


def read_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """O-10: raw little-endian 4-byte floats as ``(path, index, vector)``; the row count follows from a file's size.

    ``path`` is a URI of a file or folder that all executors see. Files are read by byte ranges, so none needs to fit a task.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.fs as pafs

    sizes = spark.read.format("binaryFile").load(path).select("path", "length")  # the contents are pruned
    step = max(1, MATRIX_BYTES // (4 * dim))
    rows = (F.col("length") / (4 * dim)).cast("long")
    ranges = sizes.where(rows > 0).select("path", rows.alias("rows"), F.explode(F.sequence(F.lit(0).cast("long"), rows - 1, F.lit(step).cast("long"))).alias("first"))

    def run(batches):
        for batch in batches:
            for name, n, first in zip(*(c.to_pylist() for c in batch.columns)):
                fs, base = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(base) as f:
                    f.seek(4 * dim * first)
                    for at in range(first, min(first + step, n), 4096):
                        m = np.frombuffer(f.read(4 * dim * (min(at + 4096, first + step, n) - at)), "<f4")
                        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(m) + 1, dim, dtype=np.int32)), pa.array(m))
                        k = len(m) // dim
                        yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(np.arange(at, at + k)), vectors], ["path", "index", "vector"])

    return ranges.repartition("path", "first").mapInArrow(run, "path string, index long, vector array<float>")


def load_centroids(source: DataFrame | str, spark: SparkSession, column: str = "centroid", dim: int | None = None) -> DataFrame:
    """O-16b: ``(cluster_id, centroid)`` from the named column, else from a column ``centroids`` (an array of vectors), else, for a
    path without either, from a raw matrix of ``dim`` columns."""
    if isinstance(source, str):
        if dim is not None:
            return read_matrix(spark, source, dim).select(F.col("index").alias("cluster_id"), F.col("vector").alias("centroid"))
        source = spark.read.parquet(source)
    if column in source.columns:
        return source.select("cluster_id", F.col(column).alias("centroid")).where(F.col("centroid").isNotNull())
    if "centroids" in source.columns:
        first = source.where(F.col("centroids").isNotNull()).limit(1)
        return first.select(F.posexplode("centroids").alias("cluster_id", "centroid")).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    raise ValueError(f"neither {column} nor centroids is a column")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """O-7."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def final_hash_answer(answer: Column) -> Column:
    """O-8: what follows the last ``#### ``."""
    return F.trim(F.element_at(F.split(answer, "#### "), -1))


def benchmark_rows(df: DataFrame, question: str, answer: Column, repeat: int = 1) -> DataFrame:
    """O-8 / T-7: ``(question, answer, copy)``, each row ``repeat`` times."""
    return df.select(F.col(question).alias("question"), answer.alias("answer"), F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("copy"))


def option_rows(df: DataFrame, question: str, options: str, answer_index: str) -> DataFrame:
    """O-8: lettered prompts of multiple-choice sets."""
    from millrace.functions.text import options_text

    return df.select(F.concat(F.col(question), F.lit("\n"), options_text(F.col(options))).alias("question"), F.char(F.col(answer_index) + 65).alias("answer"))


def seeds(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """O-12: the first ``n`` rows of a seeded shuffle."""
    from millrace.operators.select import shuffled_head

    return shuffled_head(df, key, n, seed)


def seed_rows(df: DataFrame, problem: str = "problem", solution: str = "solution") -> DataFrame:
    """O-12: ``(problem, answer)``, the answer being the last box of the solution, which rows without one lack."""
    from millrace.functions.text import boxed_last

    return df.select(F.col(problem).alias("problem"), boxed_last(F.coalesce(F.col(solution), F.lit(""))).alias("answer"))


def hash_answer_benchmark(df: DataFrame, question: str = "question", answer: str = "answer", repeat: int = 1) -> DataFrame:
    """O-8: sets whose answer stands behind the last ``#### ``."""
    return benchmark_rows(df, question, final_hash_answer(F.col(answer)), repeat)


def first_answer_benchmark(df: DataFrame, question: str = "question", answers: str = "final_answer", repeat: int = 1) -> DataFrame:
    """O-8: sets with a list of answers, of which the first counts."""
    return benchmark_rows(df, question, F.get(F.col(answers), F.lit(0)), repeat)


def option_benchmark(df: DataFrame, key: str, question: str, options: str, answer_index: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """O-8: the first ``n`` of a seeded shuffle of a multiple-choice set, as lettered prompts."""
    from millrace.operators.select import shuffled_head

    return option_rows(shuffled_head(df, key, n, seed), question, options, answer_index)


def corpus(frames: dict[str, DataFrame], text: str, least: int = 1, most: int = 10_000) -> DataFrame:
    """O-9: the union of several sources as ``(text, kind, level, source)``; texts outside the bounds of length are dropped."""
    parts = [df.select(F.col(text).alias("text"), coalesce_keys(df, ("type", "subject")).cast("string").alias("kind"), coalesce_keys(df, ("level", "difficulty")).cast("string").alias("level"), F.lit(name).alias("source")) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.length("text").between(least, most))


def corpus_counts(df: DataFrame) -> DataFrame:
    """O-9: rows by source, kind and level."""
    return df.groupBy("source", "kind", "level").agg(F.count(F.lit(1)).alias("n"))


def read_limited(spark: SparkSession, paths: list[str], schema: str, limit: int) -> DataFrame:
    """O-11: JSON lines of several sources, one after the other, up to a limit over all; lines that do not parse are skipped.

    ``row`` counts from 0 by source, file and line, however the files are split: rows are counted by file block, a scan gives what lies before each
    block, and only within a block are rows put in order. Sources behind the one that reaches the limit are not read.
    """
    from pyspark.sql import Window

    from millrace.operators import scans
    from millrace.session import materialize

    bad, at = "__mr_bad", ["source_number", "__mr_file", "__mr_block"]
    taken, held = None, 0
    for i, path in enumerate(paths):
        if held >= limit:
            break
        rows = spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
        names = [c for c in rows.columns if c != bad]
        where = [F.lit(i).alias("source_number"), F.col("_metadata.file_path").alias("__mr_file"), F.col("_metadata.file_block_start").alias("__mr_block")]
        # The place within what a task reads is taken before any other step.
        rows = rows.select(*names, bad, *where, F.monotonically_increasing_id().alias("__mr_place")).where(F.col(bad).isNull() & F.to_json(F.struct(*names)).isNotNull()).drop(bad)
        held += rows.count()
        taken = rows if taken is None else taken.unionByName(rows)
    if taken is None:
        return spark.createDataFrame([], f"{schema}, source_number int, row long")
    blocks = materialize(taken.groupBy(*at).agg(F.count(F.lit(1)).alias("__mr_n"))).withColumn("__mr_all", F.lit(0))
    ahead = scans.affine(blocks, "__mr_all", at, F.lit(1), F.col("__mr_n")).where(F.col("before") < limit).select(*at, F.col("before").cast("long").alias("__mr_ahead"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("__mr_place")) - 1
    out = taken.withColumn("__mr_inside", inside).join(ahead, at).withColumn("row", F.col("__mr_ahead") + F.col("__mr_inside")).where(F.col("row") < limit)
    return out.drop("__mr_file", "__mr_block", "__mr_place", "__mr_inside", "__mr_ahead").orderBy("row")
