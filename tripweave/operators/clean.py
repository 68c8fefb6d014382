"""Raw telemetry to canonical rows, with one discard reason per lost row."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BuildSettings
from ..schema import require_columns
from ..session import stage

CANONICAL = ("vin", "trigger", "signal", "scalar", "series", "timestamp")
ROW_ID = "source_row_id"


@dataclass(frozen=True)
class Cleaned:
    """``data``: retained rows; ``discarded``: (source_row_id, reason); ``counts``:
    (reason, row_count), null reason for the retained rows."""

    data: DataFrame
    discarded: DataFrame
    counts: DataFrame


# The characters Python counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c.cast("string"), F.lit(WHITE_SPACE))


# Forms of time that are read besides ISO text: year first with / or ., compact, month
# first with /, and month names. Without an offset a time is UTC.
TIME_FORMS = (
    "yyyy/M/d[ H:mm[:ss[.SSSSSS]]][XXX]",
    "yyyy.M.d[ H:mm[:ss[.SSSSSS]]][XXX]",
    "yyyyMMdd['T'HHmmss[.SSSSSS]][XXX]",
    "M/d/yyyy[ H:mm[:ss[.SSSSSS]]][XXX]",
    "MMM d[,] yyyy[ H:mm[:ss[.SSSSSS]]][XXX]",
    "d MMM yyyy[ H:mm[:ss[.SSSSSS]]][XXX]",
)


def as_utc(df: DataFrame, name: str) -> Column:
    """A time column as TIMESTAMP; null where it holds no time.

    Times of any type, ISO text and the TIME_FORMS are read, row by row; numbers are
    nanoseconds since 1970.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(name)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.timestamp_micros(F.floor(F.col(name).cast("decimal(28,0)") / 1000).cast("bigint"))
    text = strip(F.col(name))
    # Spark would read a bare time of day as today's; ISO text must start with a year.
    iso = F.when(F.substring(text, 5, 1).isin("-", ""), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(form)) for form in TIME_FORMS])


def number_of(text: Column) -> Column:
    """Trimmed text to DOUBLE; null when it is no number.

    The cast also takes Java's type suffixes and hexadecimal digits, which are not
    numbers here; "inf" is the one ending in f that is.
    """
    low = F.lower(text)
    java_only = low.contains("x") | (F.right(low, F.lit(1)).isin("d", "f") & ~low.endswith("inf"))
    return F.when(~java_only, text.try_cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    number = F.col(name).cast("double") if isinstance(kind, T.NumericType) else number_of(strip(F.col(name)))
    return F.when(~F.isnan(number), number)


def as_series_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    text = F.to_json(F.col(name)) if isinstance(kind, T.ArrayType) else strip(F.col(name))
    return F.nullif(text, F.lit(""))


def with_row_id(df: DataFrame) -> DataFrame:
    """Dense 0-based id in scan order (file order for a single file)."""
    return _dense(df.withColumn(ROW_ID, F.monotonically_increasing_id()))


def _dense(df: DataFrame, written: bool = False) -> DataFrame:
    """Spark's own ids, which count from partition << 33, as numbers without gaps.

    The offsets table has one row per partition of the scan that gave the ids, so the join
    moves no data rows. A lazy ``df`` is evaluated twice; for a ``written`` one the offsets
    are written too.
    """
    part = F.shiftright(ROW_ID, 33)
    sizes = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    offsets = stage(offsets, "offsets") if written else offsets
    dense = F.col("_offset") + F.col(ROW_ID) - F.shiftleft(F.col("_part"), 33)
    return df.join(F.broadcast(offsets), part == F.col("_part")).withColumn(ROW_ID, dense).drop("_part", "_offset")


def canonical(raw: DataFrame, cfg: BuildSettings) -> DataFrame:
    """Rename, trim and type the raw columns; extra columns stay as they are."""
    require_columns(raw, cfg.required_columns, "Raw telemetry")
    if cfg.row_id_column is None:
        raw = with_row_id(raw)
    else:
        raw = raw.withColumnRenamed(cfg.row_id_column, ROW_ID)
    typed = {
        "vin": (cfg.vin_column, strip(F.col(cfg.vin_column))),
        "trigger": (cfg.trigger_column, strip(F.col(cfg.trigger_column))),
        "signal": (cfg.signal_column, strip(F.col(cfg.signal_column))),
        "scalar": (cfg.scalar_column, as_number(raw, cfg.scalar_column)),
        "series": (cfg.series_column, as_series_text(raw, cfg.series_column)),
        "timestamp": (cfg.timestamp_column, as_utc(raw, cfg.timestamp_column)),
    }
    if cfg.ingestion_column in raw.columns:
        typed["ingestion_timestamp"] = (cfg.ingestion_column, as_utc(raw, cfg.ingestion_column))
    sources = {source for source, _ in typed.values()}
    # NaN and null both mean missing, also when rows are compared for equality.
    extras = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in raw.schema.fields
        if f.name not in sources and f.name != ROW_ID
    ]
    return raw.select(ROW_ID, *[e.alias(n) for n, (_, e) in typed.items()], *extras)


def _all_finite(numbers: Column) -> Column:
    """Non-empty, without null, NaN or infinite members; null for a null array."""
    # array_contains is null, not false, when it meets a null member.
    whole = ~F.array_contains(numbers, F.lit(float("nan")))
    low, high = F.array_min(numbers), F.array_max(numbers)
    return (F.size(numbers) > 0) & whole & (low > F.lit(float("-inf"))) & (high < F.lit(float("inf")))


def with_series_values(df: DataFrame, text: str = "series", when: Column | None = None) -> DataFrame:
    """Append ``series_values``: the JSON array in ``text`` as ARRAY<DOUBLE>.

    Null unless a non-empty array of finite numbers, and on rows outside ``when``.
    A quoted number is a number too: where the direct reading is not sound, members
    are read as text and cast one by one. Columns hold the readings between steps,
    so each is parsed once however often the checks look at it.
    """
    c = F.col(text)
    # The parser stops at the first closing bracket; nothing may follow it.
    closed = F.locate("]", c) == F.length(c)
    wanted = closed if when is None else when & closed
    direct, members = F.col("_direct"), F.col("_members")
    sound = F.coalesce(_all_finite(direct), F.lit(False))
    cast = F.transform(F.from_json(c, "array<string>"), lambda m: number_of(strip(m)))
    return (
        df.withColumn("_direct", F.when(wanted, F.from_json(c, "array<double>")))
        .withColumn("_sound", sound)
        .withColumn("_members", F.when(wanted & ~F.col("_sound"), cast))
        .withColumn(
            "series_values",
            F.when(F.col("_sound"), direct).otherwise(F.when(_all_finite(members), members)),
        )
        .drop("_direct", "_sound", "_members")
    )


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def early_reason() -> Column:
    """Rules that apply before duplicates are looked for; first hit wins."""
    return (
        F.when(blank("vin"), "missing_vin")
        .when(blank("trigger"), "missing_trigger")
        .when(blank("signal"), "missing_signal")
        .when(F.col("timestamp").isNull(), "invalid_timestamp")
    )


def relevant(cfg: BuildSettings) -> Column:
    """The row's trigger and signal can feed a trip."""
    return F.col("trigger").isin(cfg.start_trigger, cfg.end_trigger, cfg.periodic_trigger) & F.col(
        "signal"
    ).isin(cfg.latitude_signal, cfg.longitude_signal, cfg.altitude_signal)


def late_reason(cfg: BuildSettings, values: Column | None = None) -> Column:
    """Rules that apply after duplicates are gone; first hit wins.

    ``values``: the parsed series of the row; without it arrays are not judged.
    """
    none = F.lit(False)
    not_included = ~F.col("vin").isin(*cfg.include_vins) if cfg.include_vins else none
    excluded = F.col("vin").isin(*cfg.exclude_vins) if cfg.exclude_vins else none
    periodic = F.col("trigger") == cfg.periodic_trigger
    unreadable = none if values is None else periodic & values.isNull()
    return (
        F.when(not_included, "vin_not_included")
        .when(excluded, "vin_excluded")
        .when(~relevant(cfg), "irrelevant_trigger_or_signal")
        .when(~periodic & F.col("scalar").isNull(), "invalid_scalar_value")
        .when(periodic & F.col("series").isNull(), "missing_series_value")
        .when(unreadable, "invalid_series_value")
    )


def _content_hash(content: list[str]) -> list[Column]:
    """Two hashes of 64 bits over a row's content; rows of equal content have equal ones.

    Nulls are told from absent values by flags, which the hash itself would skip.
    """
    flags = [F.col(c).isNull() for c in content]
    return [F.xxhash64(F.lit(seed), *flags, *content).alias(f"_hash{seed}") for seed in (0, 1)]


@dataclass(frozen=True)
class Judged:
    """Every received row with one reason or none, from one pass over the raw table.

    ``rows`` is written: row id, the rules' verdicts, a hash of the content, and the content
    of rows that may stay, arrays parsed. Copies are found on the hashes alone: 24 bytes a row
    are exchanged and fold on the map side, so a row copied a billion times sends one record
    per map task. Only contents that repeat are listed (``repeated``), and what reads the rows
    is joined with that list.
    """

    rows: DataFrame
    repeated: DataFrame | None
    content: list[str]

    @property
    def verdicts(self) -> DataFrame:
        """``rows`` with ``reason``: the early rules, then copies, then the late ones."""
        if self.repeated is None:
            return self.rows.withColumn("reason", F.coalesce("_early", "_late"))
        same = (F.col("_hash0") == F.col("_first0")) & (F.col("_hash1") == F.col("_first1")) & F.col("_early").isNull()
        copy = F.when(F.col("_first_id") != F.col(ROW_ID), "exact_duplicate")
        return self.rows.join(self.repeated, same, "left").withColumn("reason", F.coalesce("_early", copy, "_late"))

    @property
    def retained(self) -> DataFrame:
        """Rows that pass every rule, with ``series_values``."""
        kept = self.verdicts.filter(F.col("_early").isNull() & F.col("_late").isNull() & F.col("reason").isNull())
        return kept.select(*self.content, ROW_ID, "series_values")

    @property
    def discarded(self) -> DataFrame:
        """(source_row_id, reason) of every discarded row."""
        return self.verdicts.filter(F.col("reason").isNotNull()).select(ROW_ID, "reason")

    @property
    def counts(self) -> DataFrame:
        """(reason, row_count); reason is null for the retained rows."""
        return self.verdicts.groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))


def repeated_contents(rows: DataFrame) -> DataFrame:
    """(_first0, _first1, _first_id): hashes that more than one row has, and the least row id."""
    return (
        rows.filter(F.col("_early").isNull())
        .groupBy(F.col("_hash0").alias("_first0"), F.col("_hash1").alias("_first1"))
        .agg(F.min(ROW_ID).alias("_first_id"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
        .drop("_copies")
    )


def judge(raw: DataFrame, cfg: BuildSettings) -> Judged:
    """Run the rules once and write what they say."""
    own_ids = cfg.row_id_column is None
    if own_ids:
        # The scan's ids are written and made dense from what was written: one evaluation.
        raw = raw.withColumn(ROW_ID, F.monotonically_increasing_id())
        cfg = replace(cfg, row_id_column=ROW_ID)
    rows = canonical(raw, cfg)
    content = [c for c in rows.columns if c != ROW_ID]
    cheap = F.coalesce(early_reason(), late_reason(cfg))
    periodic = F.col("trigger") == cfg.periodic_trigger
    parsed = with_series_values(rows, when=cheap.isNull() & periodic)
    told = parsed.withColumn("_early", early_reason()).withColumn("_late", late_reason(cfg, F.col("series_values")))
    stays = F.col("_early").isNull() & F.col("_late").isNull()
    written = stage(
        told.select(
            ROW_ID,
            "_early",
            "_late",
            *_content_hash(content),
            *[F.when(stays, F.col(c)).alias(c) for c in (*content, "series_values")],
        ),
        "judged",
    )
    if own_ids:
        written = _dense(written, written=True)
    if not cfg.drop_exact_duplicates:
        return Judged(written, None, content)
    return Judged(written, stage(repeated_contents(written), "repeated"), content)


def cleaning_record(counts: DataFrame) -> DataFrame:
    """One row: received, retained, discarded, and a map of counts per reason."""
    lost = F.col("reason").isNotNull()
    return counts.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("raw_rows_received"),
        F.coalesce(F.sum(F.when(~lost, F.col("row_count"))), F.lit(0)).alias(
            "rows_retained_for_reconstruction"
        ),
        F.coalesce(F.sum(F.when(lost, F.col("row_count"))), F.lit(0)).alias(
            "rows_discarded_before_reconstruction"
        ),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(lost, F.struct("reason", "row_count"))))
        ).alias("preconstruction_discard_counts"),
    )


def clean(raw: DataFrame, cfg: BuildSettings | None = None) -> Cleaned:
    told = judge(raw, cfg or BuildSettings())
    return Cleaned(told.retained, told.discarded, told.counts)
