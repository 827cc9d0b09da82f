"""O-20..O-24: length filter, caps, positional slices, take/skip splits, seeded samples.

Rows have no position in Spark. Where the reference relies on one, a dense
row index is built in parallel (never ``row_number()`` over an unpartitioned
window, which runs in one task): the order keys and a row hash are counted,
range-partitioned and sorted, numbered inside their partition and checkpointed;
the running count of the earlier partitions (a table with one row per
partition, broadcast back) makes the number global, and the rows get it by a
null-safe join on keys and hash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import reliable_checkpoint

_PID = "_gw_pid"
_MID = "_gw_mid"


def filter_token_len(df: DataFrame, max_len: int = K.MAX_PROMPT_TOKENS, col: str = "token_len") -> DataFrame:
    """O-20: keep ``token_len <= max_len`` (inclusive)."""
    return df.filter(F.col(col) <= max_len)


TASK_ROWS = 100_000  # rows that one task may order


def cap(df: DataFrame, n: int, order_by: list[str] | list[Column]) -> DataFrame:
    """O-21: the first n rows by key; n <= 0 keeps all.

    Up to ``TASK_ROWS`` rows it is planned as TakeOrderedAndProject: top n per
    partition, then one merge task that holds n rows. A larger n of plain
    column names goes through :func:`first_rows`, in no defined order.
    """
    if n is None or n <= 0:
        return df
    if n > TASK_ROWS and all(isinstance(c, str) for c in order_by):
        return first_rows(df, n, order_by)
    return df.orderBy(*order_by).limit(n)


def shuffle_sample(df: DataFrame, n: int, key: str, seed: int = K.DEFAULT_SEED) -> DataFrame:
    """O-24: seeded shuffle then the first n.

    The order is ``md5(seed:key)`` then key: a pure function of the row, so the
    sample does not change with partitioning (``rand(seed)`` would).
    """
    shuffle_key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ordered = df.withColumn("_gw_shuffle", shuffle_key)
    return cap(ordered, n, ["_gw_shuffle", key]).drop("_gw_shuffle")


_HASH, _TIMES, _START, _FLAGGED = "_gw_h", "_gw_times", "_gw_start", "_gw_flagged"
_COPIES = 10_000  # equal rows numbered by one task


def _row_hash(df: DataFrame, order_by: list[str]) -> Column:
    """Tells rows of equal keys apart; 0 if there is nothing but the keys."""
    rest = [f for f in df.schema.fields if f.name not in order_by]
    if not rest:
        return F.lit(0).cast("long")
    text = (T.MapType, T.VariantType)
    cols = [F.to_json(F.struct(F.col(f.name))) if isinstance(f.dataType, text) else F.col(f.name) for f in rest]
    return F.xxhash64(*cols)


_PIVOTS = 4_000  # sampled keys of one round


def _pivot_rows(keys: DataFrame, names: list[str], n: int, rows: int, seed: int) -> list:
    """Some keys around the n-th of ``rows``, ascending, from a sample of bounded
    size: two close on either side, two further off, and every eighth."""
    drawn = keys.orderBy(F.xxhash64(F.lit(seed), *names)).limit(_PIVOTS)
    drawn = drawn.orderBy(*names).collect()
    near, spread = len(drawn) * n / rows, max(1.0, len(drawn) ** 0.5)
    places = [near - 6 * spread, near - spread, near + spread, near + 6 * spread]
    places += [len(drawn) * i / 8 for i in range(9)]
    kept = sorted({min(max(int(x), 0), len(drawn) - 1) for x in places})
    return list(dict.fromkeys(drawn[i] for i in kept))


def first_rows(df: DataFrame, n: int, order_by: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """O-21, O-24 for any n: exactly the first n rows by ``order_by`` (nulls
    first, rows of equal keys by a hash of the others), in no defined order.

    A selection by pivots: each round samples some thousand keys, counts the
    rows below and up to a dozen of them in one aggregation without a shuffle
    of rows, and goes on with the stretch that holds the n-th row, until one
    task may order it (``task_rows``). Rows before the stretch are kept by a
    filter, so no task sees more than its own part. A stretch of rows equal
    altogether is made from one of them, however many there are. ``df`` is read
    once or twice a round and must give the same rows each time.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn(_HASH, _row_hash(df, order_by))
    names = [*order_by, _HASH]
    kinds = {f.name: f.dataType for f in hashed.schema.fields}
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])

    def literal(row) -> Column:
        return F.struct(*[F.lit(row[i]).cast(kinds[c]).alias(f"k{i}") for i, c in enumerate(names)])

    def upto(cut) -> Column:
        """Rows before a cut: (pivot, whether the pivot itself is before it)."""
        row, inclusive = cut
        first, least = F.col(f"`{names[0]}`"), row[0]
        whole = key <= literal(row) if inclusive else key < literal(row)
        if least is None:
            return whole
        return (first.isNull() | (first <= F.lit(least).cast(kinds[names[0]]))) & whole  # the scan prunes by it

    rows, low, high, below, seed = hashed.count(), None, None, 0, 0
    if n >= rows:
        return df
    while rows > task_rows:
        inside = hashed if low is None else hashed.where(~upto(low))
        inside = inside if high is None else inside.where(upto(high))
        pivots = _pivot_rows(inside.select(*names), names, n - below, rows, seed)
        cuts = [(row, inclusive) for row in pivots for inclusive in (False, True)]
        counts = inside.agg(*[F.count_if(upto(cut)).alias(f"c{i}") for i, cut in enumerate(cuts)]).first()
        left, right = 0, rows
        for cut, count in zip(cuts, counts):  # ascending
            if count > n - below:
                high, right = cut, count
                break
            low, left = cut, count
        below, rows, seed = below + left, right - left, seed + 1
        if below == n or (low is not None and high is not None and low[0] == high[0]):
            break  # nothing more is wanted, or the stretch is one key
    inside = hashed if low is None else hashed.where(~upto(low))
    inside = inside if high is None else inside.where(upto(high))
    rest = n - below
    if rest <= task_rows:
        last = inside.orderBy(*names).limit(rest)
    else:
        parts = -(-rest // task_rows)
        size = F.when(F.col("_gw_part") < parts - 1, F.lit(task_rows)).otherwise(F.lit(rest - (parts - 1) * task_rows))
        dealt = inside.limit(1).withColumn("_gw_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        last = dealt.repartition(parts, "_gw_part").withColumn("_gw_part", F.explode(F.sequence(F.lit(1), size.cast("int"))))
    last = last.select(*df.columns)
    return last if low is None else hashed.where(upto(low)).select(*df.columns).unionByName(last)


def _numbered(df: DataFrame, order_by: list[str], flag: Column | None = None) -> DataFrame:
    """One row per different (keys, row hash) of ``df``, which has the hash as
    a column: how many rows it stands for, the number of the first of them, and
    its number among the rows with the flag. Checkpointed."""
    flagged = (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias(_FLAGGED)
    keys = [*order_by, _HASH]
    groups = df.select(*keys, flagged).groupBy(*keys, _FLAGGED).agg(F.count(F.lit(1)).alias(_TIMES))
    lined = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    lined = reliable_checkpoint(lined.select("*", F.monotonically_increasing_id().alias(_MID)))
    lined = lined.withColumn(_PID, F.shiftright(_MID, 33)).withColumn("_gw_f", F.when(F.col(_FLAGGED), F.col(_TIMES)).otherwise(0))
    counts = lined.groupBy(_PID).agg(F.sum(_TIMES).alias("_gw_n"), F.sum("_gw_f").alias("_gw_nf"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum("_gw_n").over(before), F.lit(0)).alias("_gw_off"),
        F.coalesce(F.sum("_gw_nf").over(before), F.lit(0)).alias("_gw_off_f"),
    )
    inside = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, -1)
    return (
        lined.withColumn("_gw_in", F.coalesce(F.sum(_TIMES).over(inside), F.lit(0)))
        .withColumn("_gw_in_f", F.coalesce(F.sum("_gw_f").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), _PID)  # a row per partition of the range sort
        .select(
            *keys,
            _FLAGGED,
            _TIMES,
            (F.col("_gw_off") + F.col("_gw_in")).alias(_START),
            (F.col("_gw_off_f") + F.col("_gw_in_f")).alias("_gw_start_f"),
        )
    )


def number_rows(
    df: DataFrame, order_by: list[str], name: str, flag: Column | None = None, flag_name: str = "flag_index"
) -> tuple[DataFrame, int]:
    """Every row of ``df`` once, with its number ``name`` in ``order_by`` order
    and, if ``flag`` is given, its number among the flagged rows ``flag_name``
    (null for the others); also the row count.

    Keys may repeat and may be null (nulls first). Rows of equal keys come in
    the order of a hash of all columns, and rows that are equal altogether take
    consecutive numbers: one of them stands for all, so that a third of all rows
    being equal is no hot task. Only keys and hashes are range-sorted and
    checkpointed; rows meet their number by a null-safe join. Jobs at build
    time: the checkpoint (with its range sample), and its total.
    """
    hashed = df.withColumn(_HASH, _row_hash(df, order_by))
    groups = _numbered(hashed, order_by, flag)
    total = groups.agg(F.coalesce(F.sum(_TIMES), F.lit(0)).alias("n"), F.coalesce(F.max(_TIMES), F.lit(0)).alias("most")).first()
    repeated = total["most"] > 1
    if set(df.columns) == set(order_by):
        rows = groups.select(*df.columns, _FLAGGED, _TIMES, _START, "_gw_start_f")
    else:
        other = groups.select(*[F.col(k).alias(f"_gw_k{i}") for i, k in enumerate(order_by)], F.col(_HASH).alias("_gw_oh"), _FLAGGED, _TIMES, _START, "_gw_start_f")
        same = F.col(_HASH) == F.col("_gw_oh")
        for i, k in enumerate(order_by):
            same = same & F.col(k).eqNullSafe(F.col(f"_gw_k{i}"))
        rows = hashed.join(other, same)
    numbers = [(F.col(_START) + F.col("_gw_i")).alias(name)]
    if flag is not None:
        numbers.append(F.when(F.col(_FLAGGED), F.col("_gw_start_f") + F.col("_gw_i")).alias(flag_name))
    zero = F.lit(0).cast("long")
    if not repeated:
        return rows.withColumn("_gw_i", zero).select(*df.columns, *numbers), int(total["n"])
    single = rows.filter(F.col(_TIMES) == 1).withColumn("_gw_i", zero)
    many = rows.filter(F.col(_TIMES) > 1).dropDuplicates([_START])
    step = F.lit(_COPIES).cast("long")
    blocks = many.withColumn("_gw_from", F.explode(F.sequence(zero, F.col(_TIMES) - 1, step)))
    last = F.least(F.col("_gw_from") + step, F.col(_TIMES)) - 1
    copies = blocks.repartition(_START, "_gw_from").withColumn("_gw_i", F.explode(F.sequence(F.col("_gw_from"), last)))
    both = single.select(*df.columns, *numbers).union(copies.select(*df.columns, *numbers))
    return both, int(total["n"])


def with_row_index(
    df: DataFrame, order_by: list[str], name: str = "row_index", count: bool = True
) -> tuple[DataFrame, int | None]:
    """Dense 0..n-1 index in ``order_by`` order (:func:`number_rows`); returns
    (frame, row count or None when ``count`` is False)."""
    indexed, n = number_rows(df, order_by, name)
    return indexed, n if count else None


_SLICE = re.compile(r"^(?P<name>[^\[\]]*)(\[(?P<start>-?\d+%?)?:(?P<stop>-?\d+%?)?\])?$")


@dataclass(frozen=True)
class SliceSpec:
    name: str
    start: str | None
    stop: str | None

    @staticmethod
    def parse(text: str) -> "SliceSpec":
        m = _SLICE.match(text.strip())
        if not m:
            raise ValueError(f"bad split slice {text!r}")
        return SliceSpec(m.group("name"), m.group("start"), m.group("stop"))

    def bounds(self, n: int) -> tuple[int, int]:
        """Absolute [lo, hi) for n rows; percents round to the closest row
        (half to even), negative values count from the end."""

        def resolve(v: str | None, default: int) -> int:
            if v is None:
                return default
            if v.endswith("%"):
                pct = int(v[:-1])
                value = round(pct * n / 100)
            else:
                value = int(v)
            if value < 0:
                value += n
            return max(0, min(n, value))

        return resolve(self.start, 0), resolve(self.stop, n)


def slice_split(df: DataFrame, spec: str, order_by: list[str], name: str = "row_index") -> DataFrame:
    """O-22: ``name[a:b]`` prefix/suffix slices by count or percent."""
    s = SliceSpec.parse(spec)
    indexed, n = with_row_index(df, order_by, name)
    lo, hi = s.bounds(n)
    return indexed.filter((F.col(name) >= lo) & (F.col(name) < hi))


def split_by_slices(df: DataFrame, slices: dict[str, str], order_by: list[str], name: str = "row_index") -> DataFrame:
    """Several O-22 slices of one frame over one shared row index: each row
    once per slice it falls in, labelled with the slice's name in ``split``."""
    indexed, n = with_row_index(df, order_by, name)
    inside = []
    for label, spec in slices.items():
        lo, hi = SliceSpec.parse(spec).bounds(n)
        inside.append(F.when((F.col(name) >= lo) & (F.col(name) < hi), F.lit(label)))
    return indexed.withColumn("split", F.explode(F.array_compact(F.array(*inside))))


def take_skip_split(
    df: DataFrame,
    order_by: list[str],
    train_fraction: float = K.TRAIN_FRACTION,
    validation_fraction: float = K.VALIDATION_FRACTION,
    estimated_total: int | None = None,
    name: str = "row_index",
) -> DataFrame:
    """O-23: train = the first ``int(0.8 * total)`` rows, validation = the rest.

    ``total`` is the exact count, so every row is assigned and validation
    takes what rounding leaves over. With ``estimated_total`` (the reference
    always estimates 1,000, Q-21) validation is the next ``int(0.2 * total)``
    rows and what follows is not assigned.
    """
    indexed, n = with_row_index(df, order_by, name, count=estimated_total is None)
    total = n if estimated_total is None else estimated_total
    n_train = int(train_fraction * total)
    split = F.when(F.col(name) < n_train, F.lit("train")).otherwise(F.lit("validation"))
    if estimated_total is not None:
        indexed = indexed.filter(F.col(name) < n_train + int(validation_fraction * total))
    return indexed.withColumn("split", split)


def three_way_split(train: DataFrame, held_out: DataFrame, order_by: list[str], **kwargs) -> DataFrame:
    """O-23 in full: train and validation from the train rows by
    :func:`take_skip_split`, test = all rows of the ``val`` split (their row
    index is null). One frame labelled by ``split``."""
    test = held_out.withColumn("split", F.lit("test"))
    return take_skip_split(train, order_by, **kwargs).unionByName(test, allowMissingColumns=True)
