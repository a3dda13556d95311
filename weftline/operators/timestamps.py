"""Mixed timestamp formats and zones to one UTC instant per record.

All valid interpretations of a value are generated in the JVM; a Viterbi pass over each source's record
order picks one per value, at the least cost of format switches and backward time jumps. Rules (day before month,
the earlier of two equal local times) are costs as well, far above all others, so a reading against a rule is
chosen only where the rule leaves none, and then it counts as none.

The order is cut into range-sorted chunks, so one source may hold any share of the rows. A row with one
reading separates what is before it from what is after it, so a chunk decodes all that lies between two such
rows. What touches the chunk's ends waits: for its first and its last source the chunk gives the least cost
between each state of the source's first row there and each of its last (a min-plus matrix), the driver chains
these few matrices, at most two a chunk, and the waiting rows are decoded with the end states that the chain fixed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.timeparse import is_normal, with_interpretations
from weftline.session import stored

#: Costs of a change of format, of a jump back in time by more than SLACK_MS, and of a less preferred reading.
SWITCH, BACK, LATER_CHOICE, SLACK_MS = 1.0, 2.0, 1e-3, 60_000
#: Cost of a reading against a rule: more than all switches and jumps of its neighbours together.
RULE = 1e6
#: Rows of a chunk, about: what one task sorts and holds.
CHUNK_ROWS = 2_000_000

State = tuple[list[str], list[int]]  # formats and instants of one row's interpretations


def breaks_rule(form: str, day_first: bool | None, fold: str) -> bool:
    """Whether a reading of this format goes against the rules: ``/mdy`` marks the month read first, ``/later`` the later
    of two equal local times."""
    swapped = day_first is True and "/mdy" in form or day_first is False and form.startswith("dmy/") and "/mdy" not in form
    return swapped or fold == "earlier" and "/later" in form


class Costs:
    """Costs of readings and of steps between them, under given rules."""

    def __init__(self, day_first: bool | None, fold: str) -> None:
        self.day_first, self.fold = day_first, fold

    def own(self, a: State) -> np.ndarray:
        return np.array([LATER_CHOICE * j + RULE * breaks_rule(f, self.day_first, self.fold) for j, f in enumerate(a[0])])

    def step(self, a: State, b: State) -> np.ndarray:
        """Cost of going from each state of one row to each state of the next, the own cost of b included."""
        fa, ta = a
        fb, tb = b
        c = np.tile(self.own(b), (len(ta), 1))
        for i, j in itertools.product(range(len(ta)), range(len(tb))):
            c[i, j] += SWITCH * (fa[i] != fb[j]) + BACK * (tb[j] < ta[i] - SLACK_MS)
        return c


def _matrix(states: list[State], costs: Costs) -> np.ndarray:
    """Least cost from each state of the first row to each state of the last. Single rows in between cut
    the chain: only the first and the last stretch matter for the choice of the ends."""
    k = len(states[0][1])
    m = np.where(np.eye(k, dtype=bool), costs.own(states[0])[:, None], np.inf)
    for a, b in zip(states, states[1:]):
        m = (m[:, :, None] + costs.step(a, b)[None]).min(axis=1)
    return m


def _decode(states: list[State], costs: Costs, first: int | None, last: int | None) -> list[int]:
    """The cheapest choice per row, ends fixed where given; the least index wins a tie."""
    cost = costs.own(states[0])
    if first is not None:
        cost[np.arange(len(cost)) != first] = np.inf
    back = []
    for a, b in zip(states, states[1:]):
        step = cost[:, None] + costs.step(a, b)
        back.append(step.argmin(axis=0))
        cost = step.min(axis=0)
    j = int(cost.argmin()) if last is None else last
    path = [j]
    for row in reversed(back):
        j = int(row[j])
        path.append(j)
    return path[::-1]


def _states(pdf: pd.DataFrame, lo: int, hi: int) -> list[State]:
    out = []
    for f, t, more in zip(pdf.form[lo:hi], pdf.millis[lo:hi], pdf.more[lo:hi]):
        out.append(([f], [t]) if more is None else ([x["form"] for x in more], [x["millis"] for x in more]))
    return out


def _sources(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    s = pdf.source.to_numpy(object)
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.array([], int)
    return list(zip(at, np.append(at[1:], len(s))))


def _thin(pdf: pd.DataFrame, lo: int, hi: int) -> list[State]:
    """The rows that decide the end states: up to the first row with one reading, and from the last one on."""
    single = np.flatnonzero(pdf.more[lo:hi].isna().to_numpy())
    if not len(single):
        return _states(pdf, lo, hi)
    return _states(pdf, lo, lo + int(single[0]) + 1) + _states(pdf, lo + int(single[-1]), hi)


_NAMES = ["kind", "table_name", "record_id", "utc_millis", "form", "n_readings", "normal", "chunk", "segment", "part", "pos", "source", "fa", "ta", "fb", "tb", "cost"]
_LOCAL = (
    "kind int, table_name string, record_id long, utc_millis long, form string, n_readings int, normal boolean, chunk int, segment int, "
    "part int, pos int, source string, fa array<string>, ta array<long>, fb array<string>, tb array<long>, cost array<double>"
)
#: Kinds of rows: decided, waiting, and a summary of a chunk's end; parts of a segment: its head, its tail, all of it.
DECIDED, WAITING, SUMMARY = 0, 1, 2
HEAD, TAIL, WHOLE = 0, 1, 2


def _local(costs: Costs):
    return lambda batches: _chunk(batches, costs)


def _chunk(batches, costs: Costs):
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    chunk = TaskContext.get().partitionId()
    every = pd.concat(parts, ignore_index=True)
    base = pd.DataFrame(
        {
            "kind": DECIDED,
            "table_name": every.table_name,
            "record_id": every.record_id,
            "utc_millis": every.millis.astype("Int64"),
            "form": every.form,
            "n_readings": every.n_readings,
            "normal": every.normal,
        }
    )
    rows = np.flatnonzero(every.n_readings.to_numpy() > 0)
    pdf = every.iloc[rows].reset_index(drop=True)
    waits = np.zeros(len(every), bool)
    extra = []
    if len(pdf):
        open_rows = ~pdf.more.isna().to_numpy()
        form, millis = pdf.form.to_numpy(object).copy(), pdf.millis.to_numpy(np.int64).copy()
        segments = _sources(pdf)
        for k, (lo, hi) in enumerate(segments):
            single = np.flatnonzero(~open_rows[lo:hi]) + lo
            edge = k in (0, len(segments) - 1)
            if edge:
                thin = _thin(pdf, lo, hi)
                (fa, ta), (fb, tb) = thin[0], thin[-1]
                extra.append((SUMMARY, None, None, None, None, None, None, chunk, k, None, None, pdf.source[lo], fa, ta, fb, tb, _matrix(thin, costs).ravel().tolist()))
            if not open_rows[lo:hi].any():
                continue
            stretches = [(lo, hi, WHOLE)] if not len(single) else [(lo, single[0] + 1, HEAD), *[(a, b + 1, None) for a, b in zip(single, single[1:])], (single[-1], hi, TAIL)]
            for a, z, part in stretches:
                if not open_rows[a:z].any():
                    continue
                states = _states(pdf, a, z)
                if edge and part is not None:
                    for n, (fs, ts) in enumerate(states):
                        r = a + n
                        own = open_rows[r]
                        if own:
                            waits[rows[r]] = True
                        extra.append((WAITING, pdf.table_name[r] if own else None, pdf.record_id[r], None, None, pdf.n_readings[r], pdf.normal[r], chunk, k, part, n, pdf.source[r], fs, ts, None, None, None))
                    continue
                for r, choice, (fs, ts) in zip(range(a, z), _decode(states, costs, None, None), states):
                    form[r], millis[r] = fs[choice], ts[choice]
        base.loc[rows, "form"], base.loc[rows, "utc_millis"] = form, millis
    base = base[~waits]
    for c in _NAMES[7:]:
        base[c] = None
    yield base[_NAMES]
    if extra:
        yield pd.DataFrame(extra, columns=_NAMES)


def _chain(rows: list, costs: Costs) -> dict[tuple[int, str], tuple[int, int]]:
    """End states of the segments of sources that span several chunks."""
    fixed = {}
    rows = sorted(rows, key=lambda r: (r["chunk"], r["segment"]))
    for source, group in itertools.groupby(rows, key=lambda r: r["source"]):
        group = list(group)
        if len(group) < 2:
            continue
        cost, back = None, []
        for k, r in enumerate(group):
            m = np.array(r["cost"]).reshape(len(r["ta"]), len(r["tb"]))
            if k:
                prev = group[k - 1]
                # the own cost of the first row is in the matrix as well as in the step
                enter = cost[:, None] + costs.step((prev["fb"], prev["tb"]), (r["fa"], r["ta"])) - costs.own((r["fa"], r["ta"]))[None]
                came, total = enter.argmin(axis=0), enter.min(axis=0)
            else:
                came, total = None, np.zeros(len(r["ta"]))
            full = total[:, None] + m
            back.append((came, full.argmin(axis=0)))
            cost = full.min(axis=0)
        j = int(cost.argmin())
        for k in range(len(group) - 1, -1, -1):
            came, first = back[k]
            i = int(first[j])
            fixed[group[k]["chunk"], source] = (i, j)
            j = int(came[i]) if came is not None else 0
    return fixed


def _waiting(fixed: dict, costs: Costs):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        part = int(pdf.part.iloc[0])
        first, last = fixed.get((int(pdf.chunk.iloc[0]), pdf.source.iloc[0]), (None, None))
        states = [(list(f), list(t)) for f, t in zip(pdf.fa, pdf.ta)]
        path = _decode(states, costs, first if part in (HEAD, WHOLE) else None, last if part in (TAIL, WHOLE) else None)
        pdf = pdf.assign(form=[f[c] for (f, _), c in zip(states, path)], utc_millis=[t[c] for (_, t), c in zip(states, path)])
        return pdf[pdf.table_name.notna()][["table_name", "record_id", "utc_millis", "form", "n_readings", "normal"]]

    return run


def normalise_timestamps(
    records: DataFrame, zones: DataFrame, day_first: bool | None = True, fold: str = "earlier", keep_normal: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per record of (table_name, record_id, time_text, source): table_name, record_id, utc_millis,
    form, n_readings; utc_millis and form are null where the text names no instant (n_readings 0). Readings are counted
    before the rules choose among them; a text all of whose readings break a rule has none.

    ``zones`` (writer_host, zone_id) gives the clock zone of a source; hosts that are missing, null or listed
    with a null zone have none (of several, the least counts). Sources are ordered by record_id within a
    table; records with a null source form one source. Repeated ids are kept as separate records. Rows with
    a null id are kept. An empty table gives an empty result. With ``keep_normal=False`` records already in
    the exact form ``YYYY-MM-DDThh:mm:ss.mmmZ`` take part in the order but are left out of the result.
    """
    z = zones.where("writer_host is not null").groupBy(F.col("writer_host").alias("source")).agg(F.min("zone_id").alias("host_zone"))
    rows = records.select("table_name", F.col("record_id").cast("long").alias("record_id"), "time_text", "source").join(z, "source", "left")
    rows = rows.withColumn("source", F.concat_ws("/", "table_name", F.coalesce("source", F.lit(""))))
    # sorted as raw text, so that the bounds are sampled without parsing and each text is parsed once
    key = ["source", "record_id"]
    chunks = -(-records.count() // chunk_rows)
    usual = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(chunks, *key) if chunks > usual else rows.repartitionByRange(*key)
    ordered = ranged.sortWithinPartitions(*key, "time_text")
    read = with_interpretations(ordered, "time_text", "host_zone", "readings", None, "both")
    if day_first is not None:
        against = (lambda f: f.contains("/mdy")) if day_first else (lambda f: f.startswith("dmy/") & ~f.contains("/mdy"))
        lawful = F.exists("readings", lambda r: ~against(r["form"]))
        read = read.withColumn("readings", F.when(lawful, F.col("readings")).otherwise(F.slice("readings", 1, 0)))
    if day_first is False:  # the preferred reading comes first
        law = F.filter("readings", lambda r: ~against(r["form"]))
        read = read.withColumn("readings", F.array_distinct(F.concat(law, F.col("readings"))))
    read = read.select(
        "source",
        "table_name",
        "record_id",
        F.size("readings").alias("n_readings"),
        F.get("readings", F.lit(0))["form"].alias("form"),
        F.get("readings", F.lit(0))["millis"].alias("millis"),
        F.when(F.size("readings") > 1, F.col("readings")).alias("more"),
        is_normal(F.col("time_text")).alias("normal"),
    )
    costs = Costs(day_first, fold)
    local = stored(read.mapInPandas(_local(costs), _LOCAL))
    fixed = _chain(local.where(F.col("kind") == SUMMARY).select("chunk", "segment", "source", "fa", "ta", "fb", "tb", "cost").collect(), costs)
    out = ["table_name", "record_id", "utc_millis", "form", "n_readings", "normal"]
    late = local.where(F.col("kind") == WAITING).groupBy("chunk", "segment", "part").applyInPandas(
        _waiting(fixed, costs), "table_name string, record_id long, utc_millis long, form string, n_readings int, normal boolean"
    )
    done = local.where(F.col("kind") == DECIDED).select(*out).unionByName(late)
    return (done if keep_normal else done.where(~F.col("normal"))).drop("normal")
