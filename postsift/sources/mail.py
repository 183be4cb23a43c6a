"""Reading and writing mail tables: JSON lines, resume scans, raw-message flattening, label lookups."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from postsift import constants as K
from postsift.functions import text as T
from postsift.functions.arrays import let
from postsift.schemas import EMAIL
from postsift.session import cut_lineage

PART_DEPTH = 5
SEQ_BITS = 63
#: Lines of one file; the other bits count files.
LINE_BITS = 36
#: Labels of one account; mail providers allow 10,000 a mailbox.
MAX_LABELS = 100_000
#: The column that holds the JSON fields a schema does not know.
EXTRA = "extra_fields"


def _listed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, root, file) from a listing only: no content is read. One row per input file."""
    if len(set(paths)) < len(paths):
        raise ValueError("an input path is given twice")
    listed = None
    for i, path in enumerate(paths):
        part = spark.read.format("binaryFile").load(path).select(
            F.lit(i).alias("source"), F.lit(path).alias("root"), F.col("_metadata.file_path").alias("file"))
        listed = part if listed is None else listed.unionByName(part)
    return listed


def file_ordinals(spark: SparkSession, paths: list[str], manifest: str | None = None) -> DataFrame:
    """(root, file, ordinal): the place of each file in the corpus, in argument and name order.

    With a ``manifest`` (the path of a table that this function keeps) a file has the ordinal it got when it was first
    listed, and new files come after all known ones. One job at a time may add to a manifest.
    """
    listed = _listed_files(spark, paths)
    place = F.row_number().over(W.orderBy("source", "file"))
    if manifest is None:
        return listed.select("root", "file", (place - 1).cast("long").alias("ordinal"))
    schema = "root string, file string, ordinal long"
    try:
        known = spark.read.schema(schema).parquet(manifest)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    last = known.agg(F.max("ordinal")).first()[0]
    fresh = listed.join(known, ["root", "file"], "left_anti").select(
        "root", "file", (place + F.lit(-1 if last is None else last)).cast("long").alias("ordinal"))
    fresh = cut_lineage(fresh, "new_files")
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(manifest)
    return spark.read.schema(schema).parquet(manifest) if last is not None or not fresh.isEmpty() else known


def numbered_lines(spark: SparkSession, paths: list[str], manifest: str | None = None) -> DataFrame:
    """(seq, value): every line of text files with its file's ordinal and its number in the file.

    Two passes: the first counts the lines of every (file, block), prefix sums over the blocks of a file say where a
    block starts, and the second adds the line's place in its block. So ``seq`` depends neither on how files are split
    nor, with a manifest, on files that come later. Only counts, a row per block, leave the first pass; a layout that
    changed between the passes is an error.
    """
    lines = None
    for path in paths:
        part = spark.read.text(path).select(
            F.lit(path).alias("__root"), F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
        lines = part if lines is None else lines.unionByName(part)
    counts = lines.groupBy("__root", "__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    before = F.sum("n").over(W.partitionBy("__root", "__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    placed = starts.join(file_ordinals(spark, paths, manifest), (F.col("__root") == F.col("root")) & (F.col("__file") == F.col("file")), "left")
    blocks = cut_lineage(placed.select(
        F.col("__root").alias("__r"), F.col("__file").alias("__f"), F.col("__block").alias("__b"), "n", "first", "before", "ordinal"), "blocks")
    same = (F.col("__root") == F.col("__r")) & (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b"))
    at = F.col("__id") - F.col("first")
    fault = lambda message: F.raise_error(F.concat(F.lit(message), F.col("__file"))).cast("long")
    seq = (F.when(F.col("n").isNull() | ~at.between(0, F.col("n") - 1), fault("the files were split anew between two passes: "))
           .when(F.col("ordinal").isNull(), fault("a file came after the listing: "))
           .when((F.col("before") + at >= F.lit(1 << LINE_BITS)) | (F.col("ordinal") >= F.lit(1 << (SEQ_BITS - LINE_BITS))),
                 fault("too many files or lines for the seq layout: "))
           .otherwise(F.shiftleft("ordinal", LINE_BITS) + F.col("before") + at))
    return lines.join(blocks, same, "left").select(seq.alias("seq"), "value")


def parsed_lines(lines: DataFrame, schema: StructType, mode: str = "FAILFAST", extra: str | None = EXTRA) -> DataFrame:
    """(fields of ``schema``, ``extra``, seq) of JSON lines; blank lines are none.

    ``mode`` is as in Spark's JSON reader: a bad line fails the job, becomes a row of nulls (PERMISSIVE) or goes
    (DROPMALFORMED). Fields that the schema does not know stay, with their types, as one JSON object in ``extra``.
    """
    lines = lines.filter(F.trim("value", F.lit(" \t\r\n")) != "")
    options = {"mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    wanted = StructType([*schema.fields, StructField("__bad", StringType())]) if mode == "DROPMALFORMED" else schema
    rows = lines.withColumn("__row", F.from_json("value", wanted, options))
    if mode == "DROPMALFORMED":
        rows = rows.filter(F.col("__row").isNotNull() & F.col("__row.__bad").isNull())
    columns = [F.col(f"__row.`{name}`").alias(name) for name in schema.names]
    if extra:
        unknown = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, _: ~k.isin(schema.names))
        columns.append(F.when(F.size(unknown) > 0, F.to_json(unknown)).alias(extra))
    return rows.select(*columns, "seq")


def read_emails(spark: SparkSession, paths: list[str], schema: StructType = EMAIL, mode: str = "FAILFAST",
                manifest: str | None = None, extra: str | None = EXTRA) -> DataFrame:
    """JSON-lines files, in argument order, with a ``seq`` that follows file and line order (:func:`numbered_lines`)."""
    return parsed_lines(numbered_lines(spark, paths, manifest), schema, mode, extra)


def json_lines(df: DataFrame, extra: str = EXTRA) -> DataFrame:
    """(value): one JSON object per row; the fields kept in ``extra`` are fields of the object again."""
    known = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != extra]))
    if extra not in df.columns:
        return df.select(known.alias("value"))
    comma = F.when(known == "{}", F.lit("")).otherwise(F.lit(","))
    both = F.concat(F.substring(known, F.lit(1), F.length(known) - 1), comma, F.substring(F.col(extra), F.lit(2), F.length(extra)))
    return df.select(F.when(F.coalesce(F.col(extra), F.lit("{}")) == "{}", known).otherwise(both).alias("value"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    json_lines(df).write.mode("append" if append else "overwrite").text(path)


def write_training_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_sender_report(report: dict[str, DataFrame], path: str) -> None:
    """One folder per part: candidate lists stay distributed, totals are a single JSON document."""
    for name, part in report.items():
        part.write.mode("overwrite").json(f"{path}/{name}")


def write_document(document: DataFrame, path: str) -> None:
    """The one row of a (value) table as one file: written beside ``path``, then renamed, so that a reader sees the old one or the new."""
    spark = document.sparkSession
    beside = f"{path}.writing"
    document.select("value").coalesce(1).write.mode("overwrite").text(beside)
    if spark.read.text(beside).count() != 1:
        raise ValueError("a document is one row, and one line")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(beside), hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    made = files.globStatus(hadoop.Path(folder, "part-*"))
    previous = hadoop.Path(f"{path}.previous")
    if files.exists(target):
        files.delete(previous, True)
        files.rename(target, previous)
    if not files.rename(made[0].getPath(), target):
        raise OSError(f"could not rename to {path}")
    files.delete(previous, True)
    files.delete(folder, True)


def _is_known(keys: list[str], prefix: str) -> Column:
    """Equal keys; the last is the message's id, and a missing id equals nothing."""
    same = F.col(f"`{keys[-1]}`") == F.col(f"`{prefix}{keys[-1]}`")
    for key in keys[:-1]:
        same = same & F.col(f"`{key}`").eqNullSafe(F.col(f"`{prefix}{key}`"))
    return same


def append_new(new: DataFrame, existing_ids: DataFrame, cap: int | None = None, keys: list[str] = ("message_id",)) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; ``cap`` limits the ids scanned, before the skip.

    Ids are unique in one mailbox: for tables of several, use ``keys=["account", "message_id"]`` here and in
    :func:`postsift.operators.labelling.existing_ids`.
    """
    scanned = new if cap is None else new.orderBy("seq").limit(cap)
    known = existing_ids.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys])
    return scanned.join(known, _is_known(list(keys), "__"), "left_anti")


def write_new(new: DataFrame, existing_ids: DataFrame, path: str, cap: int | None = None,
              keys: list[str] = ("message_id",)) -> dict[str, int]:
    """Append the new rows as JSON lines; exported and skipped counts come from the same pass."""
    from pyspark.sql import Observation

    scanned = new if cap is None else new.orderBy("seq").limit(cap)
    known = existing_ids.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys]).distinct().withColumn("__known", F.lit(True))
    seen = Observation("append")
    marked = scanned.join(known, _is_known(list(keys), "__"), "left").observe(
        seen, F.count_if(F.col("__known").isNull()).alias("exported"),
        F.count_if(F.col("__known").isNotNull()).alias("skipped"))
    write_jsonl(marked.filter(F.col("__known").isNull()).drop("__known", *[f"__{k}" for k in keys]), path, append=True)
    return seen.get


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header with this name, ignoring case."""
    hits = F.filter(headers, lambda h: F.lower(F.coalesce(h["name"], F.lit(""))) == name.lower())
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def decode_body(data: Column) -> Column:
    """base64url text to UTF-8, bad bytes replaced, undecodable data empty."""
    fixed = F.regexp_replace(F.translate(F.coalesce(data, F.lit("")), "-_", "+/"), "[^A-Za-z0-9+/]", "")
    # Only base64 characters are left, and the decoder needs no padding, so no row can fail the job.
    return let(fixed, lambda f: F.when(F.length(f) % 4 != 1, F.make_valid_utf8(F.unbase64(f).cast("string"))).otherwise(""))


LEAF = "struct<mime:string,data:string,rest:string>"


def _leaves(part: Column, depth: int) -> Column:
    """(mime, data, rest) of a part and all parts below it, depth first; parts below ``depth`` are one JSON ``rest``."""
    none = F.lit(None).cast("string")
    own = F.array(F.struct(part["mimeType"].alias("mime"), part["body"]["data"].alias("data"), none.alias("rest")))
    if depth == 0:
        deeper = F.struct(none.alias("mime"), none.alias("data"), part["parts"].alias("rest"))
        return F.concat(own, F.when(part["parts"].isNotNull(), F.array(deeper)).otherwise(F.array().cast(f"array<{LEAF}>")))
    below = F.flatten(F.transform(F.coalesce(part["parts"], F.array()), lambda child: _leaves(child, depth - 1)))
    return F.concat(own, below)


@F.pandas_udf(ArrayType(ArrayType(StructType([StructField(n, StringType()) for n in ("mime", "data", "rest")]))))
def _deep_leaves(rests: pd.Series) -> pd.Series:
    """The leaves of each JSON text of nested parts, depth first, however deep they go.

    What is no part (null, a number, a text) is skipped, and a list of parts that is no list, or no JSON, has none.
    """

    def below(parts) -> list[dict]:
        return [p for p in reversed(parts) if isinstance(p, dict)] if isinstance(parts, list) else []

    def known(value) -> str | None:
        return value if isinstance(value, str) else None

    def walk(text: str) -> list[dict]:
        try:
            stack = below(json.loads(text))
        except (ValueError, RecursionError):
            return []
        out = []
        while stack:
            part = stack.pop()
            body = part.get("body")
            data = body.get("data") if isinstance(body, dict) else None
            out.append({"mime": known(part.get("mimeType")), "data": known(data), "rest": None})
            stack += below(part.get("parts"))
        return out

    return rests.map(lambda texts: None if texts is None else [walk(t) for t in texts])


def _all_leaves(df: DataFrame, depth: int) -> DataFrame:
    """Adds ``__leaves``; only the JSON of parts below ``depth``, in most mail none, travels to Python."""
    df = df.withColumn("__flat", _leaves(F.col("payload"), depth))
    rests = F.filter("__flat", lambda e: e["rest"].isNotNull())
    df = df.withColumn("__deep", _deep_leaves(F.when(F.size(rests) > 0, F.transform(rests, lambda e: e["rest"]))))
    place = lambda i: F.size(F.filter(F.slice("__flat", F.lit(1), i + 1), lambda e: e["rest"].isNotNull())) - 1
    grown = F.flatten(F.transform("__flat", lambda e, i: F.when(e["rest"].isNull(), F.array(e)).otherwise(
        F.get("__deep", place(i)))))
    return df.withColumn("__leaves", F.when(F.col("__deep").isNull(), F.col("__flat")).otherwise(grown)).drop("__flat", "__deep")


def flatten_messages(raw: DataFrame, account: str | Column, label: str | Column = "", depth: int = PART_DEPTH) -> DataFrame:
    """Provider messages to mail records.

    Plain parts joined by newlines, HTML parts only when there is no plain part, at any depth. ``depth`` must match
    the schema (:func:`postsift.schemas.raw_message`): it says how far parts are columns, and what lies deeper is read
    from their JSON. ``body_raw`` keeps the text before cleaning.
    """
    def value(v: str | Column) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    df = _all_leaves(raw, depth)

    def texts(kind: str) -> Column:
        return F.transform(F.filter("__leaves", lambda p: p["mime"] == kind), lambda p: decode_body(p["data"]))

    df = df.withColumn("__plain", texts("text/plain"))
    df = df.withColumn("body_raw", F.array_join(
        F.when(F.size("__plain") > 0, F.col("__plain")).otherwise(texts("text/html")), "\n"))
    df = T.clean_text(T.clean_text(df, "snippet", "__snippet"), "body_raw", "text")
    passed = [c for c in raw.columns if c not in
              ("id", "threadId", "labelIds", "internalDate", "snippet", "payload")]
    headers = F.col("payload.headers")
    return df.select(
        *passed, value(account).alias("account"), T.normalize_label(value(label)).alias("label"),
        F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"),
        F.coalesce("labelIds", F.array().cast("array<string>")).alias("label_ids"),
        F.col("internalDate").alias("internal_date"),
        *[header_value(headers, h).alias(h) for h in ("subject", "from", "to", "cc", "date")],
        F.col("__snippet").alias("snippet"), "text", "body_raw")


def map_label_names(df: DataFrame, labels: DataFrame, ids: str = "label_ids", out: str = "gmail_label_names") -> DataFrame:
    """Label ids to names through an (account, label_id, name) table; unknown ids stay.

    Ids belong to one account's mailbox; two names for one id of an account are an error. Each account's labels become
    one map, which its messages carry through a join on the account and look their ids up in, so no message is taken
    apart. A mailbox has a few thousand labels at the most; an account with more than ``MAX_LABELS`` is an error.
    """
    named = labels.filter(F.col("label_id").isNotNull()).groupBy("account", "label_id").agg(
        F.min("name").alias("name"), F.max("name").alias("__other"))
    twice = F.raise_error(F.concat_ws(" ", F.lit("two names for label"), "account", "label_id"))
    named = named.withColumn("name", F.when(F.col("name").eqNullSafe(F.col("__other")), F.col("name")).otherwise(twice))
    sizes = named.groupBy("account").agg(F.collect_list(F.struct("label_id", "name")).alias("e"))
    many = F.raise_error(F.concat(F.lit("too many labels for account "), F.col("account"))).cast("map<string,string>")
    maps = sizes.select(F.col("account").alias("__a"),
                        F.when(F.size("e") > MAX_LABELS, many).otherwise(F.map_from_entries("e")).alias("__names"))
    # Written so that the planner knows the size: it broadcasts a small table by itself and joins by account beyond that.
    maps = cut_lineage(maps, "label_names")
    found = F.transform(F.coalesce(F.col(ids), F.array().cast("array<string>")), lambda i: F.coalesce(F.col("__names")[i], i))
    return df.join(maps, F.col("account").eqNullSafe(F.col("__a")), "left").withColumn(out, found).drop("__a", "__names")


def label_dictionary(spark: SparkSession, aliases: dict[str, list[str]] = K.LABEL_ALIASES) -> DataFrame:
    """(canonical, alias, priority): the canonical name itself comes first."""
    rows = spark.createDataFrame(list(aliases.items()), "canonical string, aliases array<string>")
    canonical = T.normalize_label(F.col("canonical"))
    return (rows.select(canonical.alias("canonical"), F.posexplode(
        F.concat(F.array(canonical), F.col("aliases"))).alias("priority", "alias")))


def resolve_labels(dictionary: DataFrame, mailbox: DataFrame) -> DataFrame:
    """(canonical, label_id): the first alias present in the mailbox's (label_id, name) table."""
    hits = dictionary.join(mailbox, F.lower("alias") == F.lower("name"))
    return hits.groupBy("canonical").agg(F.min_by("label_id", F.struct("priority", "label_id")).alias("label_id"))


def missing_labels(dictionary: DataFrame, mailbox: DataFrame) -> DataFrame:
    return dictionary.select("canonical").distinct().join(resolve_labels(dictionary, mailbox), "canonical", "left_anti")


def without_spam_trash(df: DataFrame) -> DataFrame:
    """Rows that carry neither the spam nor the trash label; missing labels are none."""
    ids = F.coalesce("label_ids", F.array().cast("array<string>"))
    return df.filter(~F.arrays_overlap(ids, F.array(F.lit("SPAM"), F.lit("TRASH"))))


def extract_by_label(df: DataFrame, resolved: DataFrame, n: int | None = None, include_spam_trash: bool = False) -> DataFrame:
    """One row per (message, resolved label); at most the first ``n`` messages of each label."""
    df = df if include_spam_trash else without_spam_trash(df)
    rows = (df.select("*", F.explode("label_ids").alias("__lid"))
            # At most one row per canonical label.
            .join(F.broadcast(resolved.select(F.col("canonical"), F.col("label_id").alias("__rid"))),
                  F.col("__lid") == F.col("__rid"))
            .withColumn("label", F.col("canonical")).drop("__lid", "__rid", "canonical"))
    if n is None:
        return rows
    # The planner limits each label's rows before they are shuffled.
    rank = F.row_number().over(W.partitionBy("label").orderBy("seq"))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
