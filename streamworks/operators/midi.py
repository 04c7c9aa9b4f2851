"""Note events: state, time, durations, sample zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import carry

NOTE_ON, NOTE_OFF, PROGRAM, TEMPO = 1, 2, 3, 4
DEFAULT_TEMPO = 500_000  # microseconds for each quarter note


def match_zone(notes: DataFrame, zones: DataFrame) -> DataFrame:
    """The first zone (by zone_ord) of the note with vel_min <= velocity < vel_max, where 127 stands for 128; none: zone "NOT_FOUND".

    The zones of a note become one sorted list, so each note meets one row (Spark broadcasts the lists below its size limit); repeated notes stay."""
    z = zones.select("note", F.struct("zone_ord", "vel_min", F.when(F.col("vel_max") == 127, 128).otherwise(F.col("vel_max")).alias("top"), "name").alias("z"))
    listed = z.groupBy("note").agg(F.array_sort(F.collect_list("z")).alias("_zones"))
    fits = F.filter("_zones", lambda z: (F.col("velocity") >= z["vel_min"]) & (F.col("velocity") < z["top"]))
    return notes.join(listed, "note", "left").select(*notes.columns, F.coalesce(F.get(fits, F.lit(0))["name"], F.lit("NOT_FOUND")).alias("zone"))


def state_as_of(events: DataFrame, columns: tuple[str, ...] = ("program",)) -> DataFrame:
    """What is in force at each note-on of a channel (null before the first event of its kind): program, bank, pitch, pressure or other columns."""
    found = {("in_force" if columns == ("program",) else f"{c}_in_force"): ("last", F.col(c)) for c in columns}
    return carry(events, ["file_id", "channel"], "seq", found).filter(F.col("type") == NOTE_ON)


def ticks_to_ms(events: DataFrame, division: int) -> DataFrame:
    """Absolute ticks and milliseconds under a tempo that changes with each tempo event (which counts from its own tick on)."""
    rows = carry(events, ["file_id"], "seq", {"_tempo": ("last_before", F.col("tempo_us"))}).withColumn("_tempo", F.coalesce("_tempo", F.lit(DEFAULT_TEMPO)))
    summed = carry(rows, ["file_id"], "seq", {"tick": ("sum", F.col("delta_ticks")), "_us": ("sum", F.col("delta_ticks") * F.col("_tempo"))})
    return summed.withColumn("ms", F.col("_us") / division / 1000).drop("_tempo", "_us")


def note_durations(events: DataFrame, tick: str = "tick") -> DataFrame:
    """Each note-on with the next note-off of its channel and note, if that comes before another note-on."""
    own = Window.partitionBy("file_id", "channel", "note").orderBy("seq")
    notes = events.filter(F.col("type").isin(NOTE_ON, NOTE_OFF)).withColumn("_next", F.lead("type").over(own)).withColumn("_end", F.lead(tick).over(own))
    closed = F.when(F.col("_next") == NOTE_OFF, F.col("_end"))
    return notes.filter(F.col("type") == NOTE_ON).select("file_id", "channel", "note", "seq", "velocity", F.col(tick).alias("start"), (closed - F.col(tick)).alias("duration"))


def instrument_ranges(zones: DataFrame, by: str) -> DataFrame:
    """Least and greatest note, notes and distinct notes of each instrument."""
    return zones.groupBy(by).agg(F.min("note").alias("low"), F.max("note").alias("high"), F.count("*").alias("n"), F.count_distinct("note").alias("notes"))


def instrument_totals(zones: DataFrame, by: str, approximate: bool = False) -> DataFrame:
    """All notes, and how many instruments they are of (``approximate``: by a sketch, for very many)."""
    return zones.agg(F.count("*").alias("n"), (F.approx_count_distinct(by) if approximate else F.count_distinct(by)).alias("instruments"))
