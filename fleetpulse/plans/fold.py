"""Ordered folds over long histories, run as parallel slices.

A fold carries state from row to row (filters, accept/reject rules, lifecycle
detection). Running it per machine would put a whole machine into one task, so
it runs per ``(machine, slice)`` and hands state from slice to slice:

1. every slice runs from the empty state and reports its rows and exit state;
2. a slice whose entry state differs from the exit state of the slice before
   it runs again from that state; repeat until nothing changes;
3. of each slice the rows of its last run count.

When nothing changes any more every slice started from exactly the state its
predecessor ended in, so the rows equal those of one sequential pass. How many
rounds that takes depends on how soon a state forgets: a counter or clock that
restarts within a slice settles in the second round, a filter with decay d as
soon as d to the power of the rows per slice is below double precision, and a
state that never forgets needs one round per slice in the worst case. Numbers
that never forget (maxima, sums) therefore don't belong in a state; ``scan``
carries them. Only changed slices run again, each round is written to the
shared folder, and the driver sees one count per round, which is logged.

Where a state forgets too slowly but a slice's effect on it is a map that
composes, ``compose`` replaces the handing on: slices report maps, a pass over
the slices of a key (one row each) turns them into entries, and only slices whose
entry changed (by more than sums are rounded) run again.

Where a state is an automaton that stays in one of a few phases for long and forgets the
rest, ``Phases`` names an entry for each phase. The first pass runs every slice
from all of them (runs that come to the same state go on as one) and keeps the exits; composed in order they tell which phase each slice
is really entered in, and with which open clocks. The second pass runs from
these entries; a slice whose exit then differs from the one foretold sends the
slices behind it into another pass. Two states count as equal if their fractions agree to
nine digits: a filter that is started anew comes that near within a few dozen rows,
but to the last bit only after hundreds.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetpulse.plans.shared import cut, folder_for_cut
from fleetpulse.plans.slices import ORDER, spread

Step = Callable[[pd.DataFrame, dict], pd.DataFrame]
NEAR = 1e-9
STRETCH = 256  # rows after which runs from several entries are compared
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Phases:
    """Entries that stand for the phases of an automaton, and which of them a state is in."""

    entries: Mapping[str, dict]
    of: Callable[[dict], str]
    carry: Callable[[dict, dict], dict]  # from a state before a slice and a foretold exit: the exit with clocks still open

    def compose(self, exits: list[str]) -> list[str]:
        """Entries of a key's slices in order; a slice that ran from its entry hands on what it left."""
        now, out = {}, []
        for text in exits:
            seen = json.loads(text)
            out.append(json.dumps({"at": now, "foretold": seen["foretold"]}, sort_keys=True))
            now = seen["left"] if "left" in seen and _alike(seen["at"], now) else self.carry(now, seen["foretold"][self.of(now)])
        return out


def _alike(a, b) -> bool:
    """Whether two states are the same, fractions up to what sums are rounded by while a filter forgets."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-12 + NEAR * abs(b)
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_alike(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_alike(x, y) for x, y in zip(a, b))
    return a == b


def _close(old: str | None, now: str) -> bool:
    """Whether two entries start from the same state."""
    return old is not None and _alike(json.loads(old)["at"], json.loads(now)["at"])


def _foretold(rows: pd.DataFrame, step: Step, entries: Mapping[str, dict]) -> dict:
    """Exit of a slice from every entry; entries that come to the same state go on as one."""
    runs = [(json.loads(json.dumps(start)), [name]) for name, start in entries.items()]
    for first in range(0, len(rows), STRETCH):
        part = rows.iloc[first:first + STRETCH].reset_index(drop=True)
        merged: dict[str, list[str]] = {}
        for state, names in runs:
            step(part, state)
            merged.setdefault(json.dumps(state, sort_keys=True), []).extend(names)
        runs = [(json.loads(text), names) for text, names in merged.items()]
    return {name: state for state, names in runs for name in names}


def sliced_fold(df: DataFrame, keys: Sequence[str], step: Step, out: str | T.StructType, *,
                order: Sequence[str] = ORDER, compose: Callable[[list[str]], list[str]] | None = None,
                phases: Phases | None = None) -> DataFrame:
    """Run ``step(rows, state)`` over each machine's rows in order.

    ``rows`` is one slice, sorted; ``step`` changes ``state`` (a JSON-able dict,
    empty at the start) in place and returns one frame with the columns of ``out``.
    ``df`` needs a ``slice`` column that grows with ``order``.

    With ``compose``, ``step`` gets an empty state (a guess) or an entry with the fields
    ``at`` (numbers) and ``was``, and leaves the slice's map; ``compose`` turns the maps of all
    slices of a key, in order, into entries. A step whose map means the same as ``was``
    must leave that one, so that the entries behind it stay as they are. With ``phases``,
    ``step`` is as usual.
    """
    spark = df.sparkSession
    out_fields = (T._parse_datatype_string(out) if isinstance(out, str) else out).fields
    group = [*keys, "slice"]
    key_fields = [df.schema[n] for n in group]
    names = [*group, *[f.name for f in out_fields]]
    sort_by = list(order)

    if phases:
        compose = phases.compose

    def run(rows: pd.DataFrame, entry: str | None) -> tuple[pd.DataFrame | None, str]:
        state = json.loads(entry) if entry else {}
        if phases and not entry:
            return None, json.dumps({"foretold": _foretold(rows, step, phases.entries)}, sort_keys=True)
        if phases:
            told, state = state, state["at"]
            entered_with = json.loads(json.dumps(state))
        result = step(rows, state)
        if phases:
            state = {"at": entered_with, "left": state, "foretold": told["foretold"]}
        return result, json.dumps(state, sort_keys=True)

    # A marker row per run carries the states; its other cells stay null.
    run_schema = T.StructType(
        key_fields + [T.StructField(f.name, f.dataType) for f in out_fields]
        + [T.StructField("_round", T.IntegerType()), T.StructField("_entry", T.StringType()),
           T.StructField("_exit", T.StringType())])
    cells = to_arrow_schema(run_schema)

    def rerun(number: int):
        # A slice may hold few rows, so tables stay in Arrow but for what ``step`` reads and returns.
        def call(key: tuple, rows: pa.Table, entries: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return cells.empty_table()
            entry = entries["entry"][0].as_py() if entries.num_rows else None
            frame = rows.sort_by([(c, "ascending") for c in sort_by]).to_pandas(date_as_object=True)
            result, done = run(frame, entry)
            fixed = {name: value.as_py() for name, value in zip(group, key)} | {"_round": number, "_entry": None, "_exit": None}
            count = 0 if result is None else len(result)
            parts = [pa.Table.from_pylist([fixed | {"_entry": entry, "_exit": done}], cells)]
            if count:
                parts.append(pa.Table.from_arrays([
                    pa.repeat(pa.scalar(fixed[f.name], f.type), count) if f.name in fixed
                    else pa.Array.from_pandas(result[f.name], type=f.type, safe=False) for f in cells], schema=cells))
            return pa.concat_tables(parts)
        return call

    source = cut(df.select(*dict.fromkeys([*group, *df.columns])))
    folder = folder_for_cut(spark)
    paths: list[str] = []

    def execute(rows: DataFrame, entries: DataFrame) -> DataFrame:
        number = len(paths)
        paths.append(f"{folder}/round={number}")
        (spread(rows, group).groupBy(*group).cogroup(entries.groupBy(*group))
         .applyInArrow(rerun(number), run_schema).write.parquet(paths[-1]))
        return (spark.read.schema(run_schema).parquet(paths[-1]).filter(F.col("_exit").isNotNull())
                .select(*group, "_round", "_entry", "_exit"))

    none = source.select(*group, F.lit(None).cast("string").alias("entry")).filter(F.lit(False))
    states = execute(source, none)
    across = Window.partitionBy(*keys).orderBy("slice")
    entry_schema = T.StructType(key_fields + [T.StructField("_entry", T.StringType()), T.StructField("entry", T.StringType())])

    def entered(slices: pd.DataFrame) -> pd.DataFrame:
        slices = slices.sort_values("slice", ignore_index=True)
        new = [old if _close(old, now) else now for old, now in zip(slices["_entry"], compose(slices["_exit"].tolist()))]
        return slices[[*group, "_entry"]].assign(entry=new)

    while True:
        if compose is None:
            wanted = states.select(*group, "_entry", F.lag("_exit").over(across).alias("entry"))
            old, new = F.col("_entry"), F.col("entry")
        else:
            wanted = states.select(*group, "_entry", "_exit").groupBy(*keys).applyInPandas(entered, entry_schema)
            old, new = (F.get_json_object(c, "$.at") for c in ("_entry", "entry"))
        changed = cut(wanted.filter(~new.eqNullSafe(old)).select(*group, "entry"))
        if not changed.limit(1).count():
            break
        marked = changed.select(*group)
        fresh = execute(source.join(marked, group, "left_semi"), changed)
        states = cut(states.join(marked, group, "left_anti").unionByName(fresh))
    log.info("fold over %s settled after %d rounds", ", ".join(group), len(paths))
    rows = spark.read.schema(run_schema).parquet(*paths).filter(F.col("_exit").isNull())
    if len(paths) == 1:  # every slice's first run counts
        return rows.select(*names)
    return rows.join(states.select(*group, "_round"), [*group, "_round"], "left_semi").select(*names)
