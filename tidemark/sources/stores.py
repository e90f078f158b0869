"""Saved stores of vectors, postings and results, and loaders of questions and of saved runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, tokens

# Keys that a file of questions may hold its list under.
QUESTION_KEYS = ("data", "items", "qa", "examples", "qa_pairs")


def write_vectors(chunks: DataFrame, path: str, config: dict) -> None:
    """Saves chunks(chunk_id, ..., vec) as a table, with what was made how in a second one: the number of chunks, the vectors' size, the configuration."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    saved = chunks.sparkSession.read.parquet(f"{path}/chunks")
    stats = saved.agg(F.count(F.lit(1)).alias("chunks"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("size"))
    stats.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).write.mode("overwrite").json(f"{path}/config")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(chunks, configuration) of a saved store; an error where a part is missing, or rows or vector sizes are not those that were saved."""
    told = spark.read.json(f"{path}/config").first()
    chunks = spark.read.parquet(f"{path}/chunks")
    rows, least, size = chunks.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if (rows, least, size) != (told["chunks"], told["size"] if rows else None, told["size"] if rows else None):
        raise ValueError(f"{path} holds {rows} chunks with vectors of {least} to {size}, but {told['chunks']} of {told['size']} were saved")
    return chunks, json.loads(told["config"])


def feature(token: Column, features: int = 1 << 18) -> Column:
    """A token's number in a table of fixed size."""
    return F.pmod(F.xxhash64(token), F.lit(features))


def weight_lists(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, postings) of rows: for each token of a text, in order, its feature and w, 1 + ln(tf) over the row's norm."""
    from ..functions.text import bind

    words = F.array_sort(tokens(F.lower(text)))

    def counted(ws: Column) -> Column:
        first = F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (F.get(ws, i - 1) != w), i)), lambda i: i.isNotNull())
        return bind(first, lambda at: F.transform(at, lambda a, i: F.struct(F.get(ws, a).alias("feature"), (1 + F.log((F.coalesce(F.get(at, i + 1), F.size(ws)) - a).cast("double"))).alias("w"))))

    def scaled(ps: Column) -> Column:
        length = F.sqrt(F.aggregate(ps, F.lit(0.0), lambda s, p: s + p["w"] * p["w"]))
        return bind(length, lambda n: F.transform(ps, lambda p: F.struct(p["feature"].alias("feature"), (p["w"] / n).alias("w"))))

    return rows.select(key, bind(bind(words, counted), scaled).alias("postings"))


def weights(rows: DataFrame, key: str, text: str = "text", hashed: int | None = None) -> DataFrame:
    """Postings (feature, key, w) of rows: 1 + ln(tf) over the row's norm; features are tokens, or their numbers in a hashed table.

    Counts and norms are taken within the row, so that no token is shuffled before it is a posting.
    """
    if hashed is None:
        return weight_lists(rows, key, text).select(key, F.inline("postings")).select("feature", key, "w")
    folded = rows.select(key, F.explode(tokens(F.lower(text))).alias("t")).groupBy(key, feature(F.col("t"), hashed).alias("feature")).agg((1 + F.log(F.count(F.lit(1)))).alias("w"))
    norms = folded.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return folded.join(norms, key).select("feature", key, (F.col("w") / F.col("n")).alias("w"))


def write_postings(rows: DataFrame, path: str, key: str, buckets: int = 64, hashed: int | None = None) -> None:
    """Saves the postings sorted by feature, in folders by a hash of it, so that a query reads the folders and row groups of its own features."""
    postings = weights(rows, key, hashed=hashed).withColumn("bucket", F.pmod(F.xxhash64("feature"), F.lit(buckets)).cast("int"))
    # a frequent feature's postings are dealt to several files by their key
    postings.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("bucket", "feature", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, asked: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """The saved postings; of the features of asked(feature, ...) only, where it is given: their folders are read alone."""
    rows = spark.read.parquet(path)
    if asked is None:
        return rows.drop("bucket")
    held = [r[0] for r in asked.select(F.pmod(F.xxhash64("feature"), F.lit(buckets)).cast("int")).distinct().collect()]  # at most the number of buckets
    return rows.filter(F.col("bucket").isin(held)).drop("bucket")


def upsert(rows: DataFrame, path: str, key: str, reset: bool = False) -> None:
    """Adds rows to a collection by key: a new row takes the place of the one with its key. reset begins anew.

    The new state is written beside the old one and takes its place when it is whole.
    """
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not reset and fs.exists(fs_path):
        old = spark.read.parquet(path)
        rows = old.join(rows.select(key), key, "left_anti").select(*old.columns).unionByName(rows, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(fs_path, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new"), fs_path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """Saves rows as JSON lines, keys in order of letters."""
    rows.select(*sorted(rows.columns)).write.mode("append" if append else "overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions (q_id, question, doc_ids, subqueries) of a JSON file: a list, a list under a known key, or companion records with the file of their source questions beside it.

    A companion's record takes its own expanded question, else the source's question, and the source's doc_ids.
    """
    rows = spark.read.json(path, multiLine=True)
    for name in QUESTION_KEYS:
        if name in rows.columns:
            return _questions(rows.select(F.inline(name)))
    if "records" not in rows.columns:
        return _questions(rows)
    source = rows.select("source_questions_file").first()[0] if "source_questions_file" in rows.columns else None
    records = rows.select(F.inline("records"))
    field = lambda name, kind: F.col(name).cast(kind) if name in records.columns else F.lit(None).cast(kind)
    plain = records.select(_id(records).alias("q_id"), F.nullif(F.trim(field("expanded_question", "string")), F.lit("")).alias("expanded"), field("subqueries", "array<string>").alias("subqueries"))
    if not source:
        return _checked(plain.select("q_id", F.col("expanded").alias("question"), F.lit(None).cast("array<string>").alias("doc_ids"), "subqueries"))
    known = read_questions(spark, f"{path.rsplit('/', 1)[0]}/{source}").select("q_id", F.col("question").alias("asked"), "doc_ids")
    joined = plain.join(known, "q_id", "left")
    return _checked(joined.select("q_id", F.coalesce("expanded", "asked").alias("question"), "doc_ids", "subqueries"))


def _id(rows: DataFrame) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in ("q_id", "qid") if c in rows.columns], F.lit(""))


def _questions(rows: DataFrame) -> DataFrame:
    field = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    return rows.select(_id(rows).alias("q_id"), field("question", "string").alias("question"), field("doc_ids", "array<string>").alias("doc_ids"), field("subqueries", "array<string>").alias("subqueries"))


def _checked(rows: DataFrame) -> DataFrame:
    bad = rows.filter(F.coalesce(F.trim("question"), F.lit("")) == "").select("q_id").limit(5).collect()
    if bad:
        raise ValueError(f"questions without text: {[r[0] for r in bad]}")
    return rows


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """read_questions, each with text and at least one document id that is not blank; an error names those without."""
    rows = read_questions(spark, path).withColumn("doc_ids", F.filter(F.transform(F.coalesce("doc_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    bad = [r[0] for r in rows.filter((F.coalesce(F.trim("question"), F.lit("")) == "") | (F.size("doc_ids") == 0)).select("q_id").limit(5).collect()]
    if bad:
        raise ValueError(f"records without a question or document ids: {bad}")
    return rows


def read_details(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Saved rows of runs from JSON-lines files, with the file each stands in and its line there (from 1, blank lines counted)."""
    lines = numbered_lines(spark, paths)
    schema = spark.read.json(paths).schema
    out = lines.filter(F.trim("value") != "").select("file", "line", F.from_json("value", schema).alias("r"))
    return out.select("r.*", F.col("file").alias("source_file"), F.col("line").alias("source_line"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value): lines with their numbers from 1. A file is read by one task, as numbers need all lines before."""
    whole = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("at", "value")).select("file", (F.col("at") + 1).alias("line"), "value")


def select_questions(rows: DataFrame, key: str, offset: int = 0, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Questions from an offset on, up to a limit, in order of the key or, with a seed, of a seeded hash of it."""
    order = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")) if seed is not None else F.col(key)
    out = rows.orderBy(order, F.col(key)).offset(offset)
    return out if limit is None else out.limit(limit)


def subset(questions: DataFrame, corpus: DataFrame, count: int, extras: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(questions, documents(doc_id, gold)): a seeded sample of questions(q_id, doc_ids), their documents, and a seeded sample of others of corpus(doc_id).

    An error where there are fewer questions or other documents than asked for, or where a document that is asked for is not in the corpus.
    """
    drawn = select_questions(questions, "q_id", 0, count, seed)
    gold = drawn.select(F.explode("doc_ids").alias("doc_id")).select(F.trim("doc_id").alias("doc_id")).filter("doc_id <> ''").distinct()
    absent = [r[0] for r in gold.join(corpus, "doc_id", "left_anti").orderBy("doc_id").limit(10).collect()]
    if absent:
        raise ValueError(f"documents that the corpus lacks: {absent}")
    others = corpus.select("doc_id").distinct().join(gold, "doc_id", "left_anti")
    held, rest = questions.count(), others.count()
    if count > held or extras > rest:
        raise ValueError(f"{count} questions and {extras} other documents asked for, {held} and {rest} there")
    more = select_questions(others, "doc_id", 0, extras, seed)
    return drawn, gold.withColumn("gold", F.lit(True)).unionByName(more.withColumn("gold", F.lit(False)))


def requested(documents: DataFrame, wanted: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(documents, missing): those of wanted(doc_id), and the ids that no document has; up to a limit in order of appearance (column at)."""
    out = documents if wanted is None else documents.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    missing = None if wanted is None else wanted.select("doc_id").distinct().join(documents.select("doc_id"), "doc_id", "left_anti")
    return (out if limit is None else out.orderBy("at").limit(limit)), missing


def document_ids(argument: str) -> list[str]:
    """Ids of an argument: a JSON list or string, or a list with commas or white space; each once."""
    try:
        value = json.loads(argument)
        listed = value if isinstance(value, list) else [value]
    except json.JSONDecodeError:
        listed = argument.replace(",", " ").split()
    return list(dict.fromkeys(x for x in (str(v).strip() for v in listed) if x))


def distinct_in_order(documents: DataFrame) -> DataFrame:
    """Each doc_id once, with its place (column at) where it came first."""
    return documents.groupBy("doc_id").agg(F.min("at").alias("at"))


def external_chunks(results: DataFrame, base_rank: int) -> DataFrame:
    """Chunks of what an external search gave, results(at, id, doc_id, title, text, score), with defaults for what is null; rows without text go."""
    rank = (F.col("at") + base_rank).cast("int")
    name = F.concat(F.lit("external::"), rank.cast("string"))
    made = results.select(
        F.coalesce("id", name).alias("chunk_id"),
        F.coalesce("doc_id", "id", name).alias("doc_id"),
        F.coalesce("title", F.lit("external result")).alias("title"),
        clean_text(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        rank.alias("rank"),
    )
    return made.filter("text <> ''")
