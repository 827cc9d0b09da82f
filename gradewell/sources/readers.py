"""O-1, O-4..O-8: example files, split folders, prompt files, image references, streams."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.literal import literal_table
from ..functions.text import py_strip
from ..operators.normalize import to_prompt_reference
from ..operators.sample import with_row_index
from ..session import reliable_checkpoint

SFT_REQUIRED = ("text", "reasoning", "sentiment", "confidence")
RL_REQUIRED = ("text",)
CORRUPT = "_corrupt_record"


def read_examples(
    spark: SparkSession,
    path: str | Sequence[str],
    required: Iterable[str] = (),
    schema: T.StructType | str | None = None,
    fmt: str = "json",
    keep_corrupt: bool = False,
) -> DataFrame:
    """O-1: read JSON lines (or any batch format); a missing required column
    raises ``ValueError`` at plan time. Extra columns are allowed.

    With ``keep_corrupt`` malformed lines are kept in ``_corrupt_record``
    instead of failing the job (quarantine them with ``quarantine``).
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE" if keep_corrupt else "FAILFAST")
        if keep_corrupt:
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.load(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} (wanted: {', '.join(required)})")
    return df


def read_variant_rows(spark: SparkSession, path: str | Sequence[str], name: str = "row") -> DataFrame:
    """O-1 for JSON lines without a common schema: each line is one Variant
    value in column ``name``, so fields may be missing or change their type
    from row to row. A malformed line fails the job."""
    return spark.read.option("singleVariantColumn", name).option("mode", "FAILFAST").json(path)


LINE, MALFORMED = "line", "malformed"


def json_fields(spark: SparkSession, path: str | Sequence[str], by: str = "file") -> DataFrame:
    """O-1: what JSON-lines files really hold: (unit, field, type, n), n the
    lines of the unit (a ``file``, or a ``folder`` of files) in which the field
    has that type.

    Types are string, bigint, double (any number with a point or exponent),
    boolean, object, array and void (an explicit null). Two rows a unit have no
    field: type ``line`` counts its JSON objects, ``malformed`` the other lines.
    Blank lines are skipped. One pass over the text; each task adds up its own
    counts before the shuffle, which carries a row per unit, field and type.
    """
    if by not in ("file", "folder"):
        raise ValueError(f"by {by!r}: file or folder")
    file = F.col("_metadata.file_path")
    unit = file if by == "file" else F.regexp_replace(file, "/[^/]*$", "")
    parsed = spark.read.text(path).select(unit.alias("unit"), "value").filter(F.trim("value") != "")
    parsed = parsed.select("unit", F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").alias("m"))

    def kind(value):
        name = F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0))
        return F.when(name.isin("decimal", "float"), F.lit("double")).otherwise(name)

    whole = F.struct(
        F.lit(None).cast("string").alias("field"),
        F.when(F.col("m").isNull(), F.lit(MALFORMED)).otherwise(F.lit(LINE)).alias("type"),
    )
    own = F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("field"), kind(e["value"]).alias("type")))
    found = F.concat(F.array(whole), F.coalesce(own, F.slice(F.array(whole), 1, 0)))
    return parsed.select("unit", F.inline(found)).groupBy("unit", "field", "type").agg(F.count(F.lit(1)).alias("n"))


def schema_problems(fields: DataFrame, required: Iterable[str] = ()) -> DataFrame:
    """O-1: what is wrong in which unit of :func:`json_fields`: (unit, problem,
    field, found, wanted, n), n the lines concerned.

    ``missing``: lines without a required field (an explicit null is there).
    ``conflict``: values of another type than most lines of all units have (of
    equally frequent types the first by name). Whole numbers fit a double; a
    bigint column that also holds doubles is wanted as double. ``malformed``:
    lines that are no JSON object. The input is a row per unit, field and type.
    """
    text = F.lit(None).cast("string")
    lines = fields.filter(F.col("field").isNull())
    whole = lines.filter(F.col("type") == LINE).select("unit", F.col("n").alias("_gw_lines"))
    malformed = lines.filter(F.col("type") == MALFORMED).select(
        "unit", F.lit("malformed").alias("problem"), text.alias("field"), text.alias("found"), text.alias("wanted"), "n"
    )
    there = fields.filter(F.col("field").isNotNull())
    names = list(dict.fromkeys(required))
    asked = whole.withColumn("field", F.explode(F.array(*[F.lit(c) for c in names]).cast("array<string>")))
    held = there.groupBy("unit", "field").agg(F.sum("n").alias("_gw_held"))
    lacking = F.col("_gw_lines") - F.coalesce(F.col("_gw_held"), F.lit(0))
    missing = asked.join(held, ["unit", "field"], "left").select(
        "unit", F.lit("missing").alias("problem"), "field", text.alias("found"), text.alias("wanted"), lacking.alias("n")
    )
    typed = there.filter(F.col("type") != "void")
    number = F.col("type").isin("bigint", "double")
    of_all = typed.groupBy("field", F.when(number, F.lit("number")).otherwise(F.col("type")).alias("_gw_type")).agg(
        F.sum("n").alias("_gw_n"), F.max(F.col("type") == "double").alias("_gw_double")
    )
    exact = F.when(F.col("_gw_type") != "number", F.col("_gw_type")).when(F.col("_gw_double"), F.lit("double"))
    named = of_all.withColumn("_gw_type", exact.otherwise(F.lit("bigint")))
    most = named.groupBy("field").agg(F.min(F.struct((-F.col("_gw_n")).alias("n"), F.col("_gw_type").alias("wanted"))).alias("_gw_most"))
    fits = (F.col("type") == F.col("_gw_most.wanted")) | ((F.col("type") == "bigint") & (F.col("_gw_most.wanted") == "double"))
    conflict = typed.join(most, "field").filter(~fits).select(
        "unit", F.lit("conflict").alias("problem"), "field", F.col("type").alias("found"), "_gw_most.wanted", "n"
    )
    return malformed.unionByName(missing.filter(F.col("n") > 0)).unionByName(conflict)


MAX_NAMED = 20


def check_examples(spark: SparkSession, path: str | Sequence[str], required: Iterable[str] = (), by: str = "file") -> None:
    """Raise ``ValueError`` naming units and fields (the first ``MAX_NAMED``
    problems, and how many there are) before a job reads drifting files."""
    problems = schema_problems(json_fields(spark, path, by), required)
    shown = problems.orderBy("unit", "problem", "field", "found").limit(MAX_NAMED + 1).collect()
    if not shown:
        return
    texts = []
    for p in shown[:MAX_NAMED]:
        types = f" is {p['found']}, not {p['wanted']}" if p["problem"] == "conflict" else ""
        field = f" {p['field']}" if p["field"] is not None else ""
        texts.append(f"{p['unit']}: {p['problem']}{field}{types} ({p['n']} lines)")
    more = f" and more, {problems.count()} in all" if len(shown) > MAX_NAMED else ""
    raise ValueError("; ".join(texts) + more)


LABELLED_SCHEMA = T.StructType([T.StructField("sentence", T.StringType()), T.StructField("label", T.IntegerType())])


def read_labelled_sentences(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """O-2's source: (sentence, label) rows; a load failure only warns and
    gives no rows, so the example assembly falls back to synthetic rows."""
    import logging

    try:
        df = spark.read.format(fmt).load(path)
        missing = [c for c in ("sentence", "label") if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        return df
    except Exception as exc:  # noqa: BLE001 - the reference warns and continues
        logging.getLogger(__name__).warning("could not load labelled sentences from %s: %s", path, exc)
        return spark.createDataFrame([], LABELLED_SCHEMA)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a permissive read into (good rows, corrupt lines).

    The corrupt frame keeps every column: Spark refuses queries on raw files
    that reference only the corrupt-record column, so write it out whole.
    """
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def pick_splits(names: Iterable[str]) -> tuple[str, str | None]:
    """O-4: (train split, eval split or None) by name preference.

    Train: first present of the preferred names, else the first name
    containing ``train``, else the first name. Eval: first preferred eval
    name, else the first name containing ``test``/``valid`` that is not the
    train split; never the train split itself. Names are sorted first, so the
    fallbacks are deterministic (Q-18).
    """
    keys = sorted(set(names))
    if not keys:
        raise ValueError("no splits")
    train = next((k for k in K.PREFERRED_TRAIN_SPLITS if k in keys), None)
    if train is None:
        train = next((k for k in keys if "train" in k), keys[0])
    evaluation = next((k for k in K.PREFERRED_EVAL_SPLITS if k in keys), None)
    if evaluation is None:
        evaluation = next((k for k in keys if ("test" in k or "valid" in k) and k != train), None)
    if evaluation == train:
        evaluation = None
    return train, evaluation


def list_split_dirs(spark: SparkSession, root: str) -> list[str]:
    """Names of the sub-folders of ``root`` (one folder per split), on any
    Hadoop-compatible store."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    return sorted(
        st.getPath().getName()
        for st in fs.listStatus(path)
        if st.isDirectory() and not st.getPath().getName().startswith(("_", "."))
    )


def load_splits(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    normalise: bool = True,
    keep: list[str] | None = None,
    split: str | None = None,
    config: str | None = None,
) -> tuple[DataFrame, DataFrame | None, str, str | None]:
    """O-5: (train, eval, train name, eval name) from a folder.

    The folder holds a folder per split, a folder per config that holds the
    splits (``config`` names one; without it the first by name is taken), or
    the rows themselves: then they are all train and there is no eval split.
    ``split`` names the train split instead of the preference. Both splits are
    normalised to (prompt, reference) unless ``normalise`` is False. Failure to
    find or read any split raises ``RuntimeError``.
    """
    try:
        base = root.rstrip("/")
        names = list_split_dirs(spark, f"{base}/{config}" if config else base)
        if config:
            base = f"{base}/{config}"
        elif names and (inner := list_split_dirs(spark, f"{base}/{names[0]}")):
            base, names = f"{base}/{names[0]}", inner
        if not names:
            if split is not None:
                raise ValueError(f"no split {split!r}: the rows are not split")
            train_name, eval_name = "train", None
            train, evaluation = spark.read.format(fmt).load(base), None
        else:
            if split is not None and split not in names:
                raise ValueError(f"no split {split!r} among {names}")
            train_name, eval_name = pick_splits(names)
            if split is not None:
                train_name, eval_name = split, pick_splits(names)[1] if pick_splits(names)[1] != split else None
            train = spark.read.format(fmt).load(f"{base}/{train_name}")
            evaluation = spark.read.format(fmt).load(f"{base}/{eval_name}") if eval_name else None
    except Exception as exc:  # noqa: BLE001 - one error for every cause, as the reference
        raise RuntimeError(f"could not detect splits under {root!r}: {exc}") from exc
    if normalise:
        train = to_prompt_reference(train, keep=keep)
        evaluation = to_prompt_reference(evaluation, keep=keep) if evaluation is not None else None
    return train, evaluation, train_name, eval_name


MAX_SPLITS = 1000


def load_splits_by_column(
    spark: SparkSession,
    path: str,
    column: str = "split",
    fmt: str = "parquet",
    normalise: bool = True,
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame | None, str, str | None]:
    """O-5 for one table holding every split in ``column`` (usually a
    partition column, so the filters below prune whole folders). Only the
    distinct split names reach the driver, ``MAX_SPLITS`` of them at most: a
    column with more is no split column and raises ``RuntimeError``."""
    try:
        df = spark.read.format(fmt).load(path)
        names = [r[0] for r in df.select(column).distinct().limit(MAX_SPLITS + 1).collect() if r[0] is not None]
        if len(names) > MAX_SPLITS:
            raise ValueError(f"column {column!r} has over {MAX_SPLITS} values")
        train_name, eval_name = pick_splits(names)
    except Exception as exc:  # noqa: BLE001
        raise RuntimeError(f"could not detect splits in {path!r}: {exc}") from exc
    train = df.filter(F.col(column) == train_name).drop(column)
    evaluation = df.filter(F.col(column) == eval_name).drop(column) if eval_name else None
    if normalise:
        train = to_prompt_reference(train, keep=keep)
        evaluation = to_prompt_reference(evaluation, keep=keep) if evaluation is not None else None
    return train, evaluation, train_name, eval_name


PROMPT_SCHEMA = T.StructType([T.StructField("prompt_id", T.LongType()), T.StructField("prompt", T.StringType())])


def read_prompts(
    spark: SparkSession,
    literals: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """O-6: (prompt_id, prompt): literal prompts first, then the non-blank
    stripped lines of the prompt file in file order; the five built-in
    prompts only when neither is given."""
    literals = list(literals)
    if not literals and path is None:
        literals = list(K.DEFAULT_COMPARISON_PROMPTS)
    out = literal_table(spark, [(i, p) for i, p in enumerate(literals)], PROMPT_SCHEMA) if literals else None
    if path is not None:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("_gw_file"),
            F.col("_metadata.file_block_start").alias("_gw_block"),
            F.monotonically_increasing_id().alias("_gw_pos"),
            py_strip("value").alias("prompt"),
        )
        # the position must be the same for both uses in the row index
        kept = reliable_checkpoint(lines.filter(F.length("prompt") > 0))
        indexed, _ = with_row_index(kept, ["_gw_file", "_gw_block", "_gw_pos"], "_gw_line", count=False)
        from_file = indexed.select((F.col("_gw_line") + F.lit(len(literals))).alias("prompt_id"), "prompt")
        out = from_file if out is None else out.unionByName(from_file)
    return out


def _plain_path(path: str):
    """A path without the ``file:`` scheme and its empty authority."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def resolve_images(
    samples: DataFrame,
    files: DataFrame,
    image_path: str = "image_path",
    image_bytes: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """O-7: (resolved, skipped) samples.

    A sample resolves when it carries image bytes, or when its path names a
    file of ``files`` (a ``binaryFile`` listing with a row per path; a
    ``file:`` scheme is ignored). Resolved rows get ``image`` bytes; skipped
    ones are returned for reporting and never numbered. Which samples resolve
    is found from the paths alone, so the skipped list reads no bytes; these
    join only resolved samples that carry none. Remote URLs are not fetched.
    """
    paths = files.select(_plain_path("path").alias("_gw_path"), F.lit(True).alias("_gw_there"))
    keyed = samples.withColumn("_gw_path", _plain_path(image_path))
    own = F.col(image_bytes).isNotNull() if image_bytes is not None else F.lit(False)
    known = keyed.join(paths, "_gw_path", "left")
    have = own | F.col("_gw_there").isNotNull()
    skipped = known.filter(~have).drop("_gw_there", "_gw_path")
    contents = files.select(_plain_path("path").alias("_gw_path"), F.col("content").alias("image"))
    read = keyed.filter(~own).join(contents, "_gw_path").drop("_gw_path")
    if image_bytes is None:
        return read, skipped
    carried = keyed.filter(own).withColumn("image", F.col(image_bytes)).drop("_gw_path")
    return carried.unionByName(read), skipped


def image_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The ``binaryFile`` source over a folder of images (bytes read lazily)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def stream_examples(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """O-8: the same rows as a stream of arriving files (schema is required),
    at most ``files_per_batch`` files in a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
