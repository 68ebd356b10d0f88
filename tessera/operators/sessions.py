"""Sessions: turn windows, summaries with a watermark, keyed state, and the dialogue's state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import consent_choice, is_cancel

WINDOW, BATCH = 20, 5
NORMAL, CONSENT, FORM = "normal", "awaiting_consent", "awaiting_form"
MISSES = 2


def last_turns(turns: DataFrame, n: int = WINDOW, key: str = "session_id", turn: str = "turn_index") -> DataFrame:
    """The last n turns of every session."""
    latest = Window.partitionBy(key).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= n).drop("_n")


def history(turns: DataFrame, key: str = "session_id", turn: str = "turn_index", role: str = "role", content: str = "content", only: str | None = None) -> DataFrame:
    """(key, turns): all turns, or those of one role, as array<struct<role, content>> in order."""
    rows = turns if only is None else turns.filter(F.col(role) == only)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))


def user_text(turns: DataFrame, key: str = "session_id", turn: str = "turn_index", role: str = "role", content: str = "content") -> DataFrame:
    """(key, text): what the user said, one line a turn."""
    rows = history(turns, key, turn, role, content, "user")
    return rows.select(key, F.array_join(F.transform("turns", lambda t: F.coalesce(t["content"], F.lit(""))), "\n").alias("text"))


def append_turns(turns: DataFrame, new: DataFrame, key: str = "session_id", turn: str = "turn_index", order: str = "created_at") -> DataFrame:
    """New turns numbered on from each session's last index (from 0 in a new one), in order of ``order``."""
    base = turns.groupBy(key).agg(F.max(turn).alias("_max"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    numbered = new.join(base, key, "left").withColumn(turn, (F.coalesce("_max", F.lit(-1)) + number).cast("long")).drop("_max")
    return turns.unionByName(numbered, allowMissingColumns=True)


def latest_summaries(summaries: DataFrame, key: str = "session_id") -> DataFrame:
    """One summary of each session: the last by ``updated_at``, of equal ones that of the further watermark, then of the greater text and employee."""
    names = summaries.columns
    order = [c for c in ("updated_at", "summarized_through_turn", "summary_text", "employee_id") if c in names]
    row = F.max_by(F.struct(*names), F.struct(*order)).alias("_s")
    return summaries.groupBy(key).agg(row).select(*(F.col(f"_s.{c}").alias(c) for c in names))


def due_summaries(turns: DataFrame, summaries: DataFrame, window: int = WINDOW, batch: int = BATCH, key: str = "session_id") -> DataFrame:
    """(key, total, through, watermark): sessions of which a batch of turns has left the window since the last summary."""
    totals = turns.groupBy(key).agg(F.count("*").alias("total"))
    marks = latest_summaries(summaries, key).select(key, F.col("summarized_through_turn").alias("_through"))
    rows = totals.join(marks, key, "left").select(key, "total", F.coalesce("_through", F.lit(0)).cast("long").alias("through"), (F.col("total") - window).alias("watermark"))
    return rows.filter((F.col("watermark") > 0) & (F.col("watermark") - F.col("through") >= batch))


def evicted_turns(turns: DataFrame, due: DataFrame, key: str = "session_id", turn: str = "turn_index") -> DataFrame:
    """The turns that a due summary takes in: from the old watermark up to the new one."""
    return turns.join(due, key).filter((F.col(turn) >= F.col("through")) & (F.col(turn) < F.col("watermark")))


def upsert_summaries(summaries: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """Keyed upsert: new values win, but a null employee keeps the old one and a null text keeps the old text; the watermark moves on all the same.
    Of several rows of a session on either side the one that ``latest_summaries`` names counts."""
    new = latest_summaries(new, key)
    old = latest_summaries(summaries, key).select(F.col(key), *(F.col(c).alias(f"_{c}") for c in ("employee_id", "summary_text", "summarized_through_turn", "updated_at")))
    both = old.join(new, key, "full_outer")
    return both.select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in ("employee_id", "summary_text", "summarized_through_turn", "updated_at")))


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; the order should be total."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def current_states(log: DataFrame, key: str = "session_id") -> DataFrame:
    """The states left by a log (key, state, miss_count, updated_at): the latest of each key; ``normal`` removes the key."""
    found = latest_per_key(log, key, F.desc("updated_at"), F.desc("state"))
    return found.filter(F.col("state") != NORMAL)


def record_misses(states: DataFrame, missed: DataFrame, key: str = "session_id") -> DataFrame:
    """Adds one miss per row of ``missed`` to the sessions that have a state; (key, state, miss_count)."""
    more = missed.groupBy(key).agg(F.count("*").alias("_more"))
    return states.join(more, key, "left").select(key, "state", (F.col("miss_count") + F.coalesce("_more", F.lit(0))).cast("long").alias("miss_count"))


def context(turns: DataFrame, summaries: DataFrame, sessions: DataFrame, n: int = WINDOW, key: str = "session_id") -> DataFrame:
    """(key, turns) for every row of ``sessions`` (key, employee_id): the last turns, after the summary of what came before.

    A session with neither turns nor a summary of its own begins with its employee's latest summary.
    """
    recent = history(last_turns(turns, n, key), key)
    own = latest_summaries(summaries, key).select(key, F.col("summary_text").alias("_own"))
    other = latest_per_key(summaries.filter("employee_id is not null"), "employee_id", F.desc("updated_at"), F.col(key)).select("employee_id", F.col("summary_text").alias("_other"))
    rows = sessions.join(recent, key, "left").join(own, key, "left").join(other, "employee_id", "left")
    seed = F.when(F.col("_own").isNull() & F.col("turns").isNull(), F.col("_other"))
    text = F.coalesce("_own", seed)
    told = F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("[Summary of earlier conversation: "), text, F.lit("]")).alias("content")))
    kept = F.coalesce("turns", F.array().cast("array<struct<role:string,content:string>>"))
    return rows.select(key, F.when(F.coalesce(text, F.lit("")) != "", F.concat(told, kept)).otherwise(kept).alias("turns"))


def flow_signal(message: Column, is_complaint: Column, has_form: Column) -> Column:
    """The signal of a turn for the state machine: what it may mean is told apart by the state it meets."""
    choice = consent_choice(message)
    return F.struct(is_cancel(message).alias("cancel"), (choice == "file_ticket").alias("file"), is_complaint.alias("complaint"), has_form.alias("form"))


def step(state: Column, misses: Column, signal: Column) -> Column:
    """struct(state, misses, action) after one turn.

    normal: a complaint opens the consent gate. Consent: cancel ends, file asks for the form, all else escalates. Form: cancel ends,
    a submission is filed, other text is a miss, and the second miss escalates by fail-safe.
    """
    on = lambda f: F.coalesce(signal[f], F.lit(False))
    to = lambda s, m, a: F.struct(F.lit(s).alias("state"), (F.lit(m) if isinstance(m, int) else m).cast("int").alias("misses"), F.lit(a).alias("action"))
    missed = misses + 1
    return (
        F.when((state == CONSENT) & on("cancel"), to(NORMAL, 0, "cancelled"))
        .when((state == CONSENT) & on("file"), to(FORM, 0, "form_required"))
        .when(state == CONSENT, to(NORMAL, 0, "escalated"))
        .when((state == FORM) & on("cancel"), to(NORMAL, 0, "cancelled"))
        .when((state == FORM) & on("form"), to(NORMAL, 0, "filed"))
        .when((state == FORM) & (missed >= MISSES), to(NORMAL, 0, "fail_safe"))
        .when(state == FORM, to(FORM, missed, "reminded"))
        .when(on("complaint"), to(CONSENT, 0, "consent_asked"))
        .otherwise(to(NORMAL, 0, "answered"))
    )


def run_flow(turns: DataFrame, key: str = "session_id", turn: str = "turn_index", signal: str = "signal") -> DataFrame:
    """(key, turn, state, misses, action) after every turn: a fold over each session's ordered turns."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(signal).alias("signal"))))
    rows = turns.groupBy(key).agg(ordered.alias("t"))
    kind = "array<struct<turn:bigint,state:string,misses:int,action:string>>"
    start = F.struct(F.lit(NORMAL).alias("state"), F.lit(0).alias("misses"), F.array().cast(kind).alias("out"))

    def fold(s: Column, t: Column) -> Column:
        new = step(s["state"], s["misses"], t["signal"])
        row = F.struct(t["turn"].cast("bigint").alias("turn"), new["state"].alias("state"), new["misses"].alias("misses"), new["action"].alias("action"))
        return F.struct(new["state"].alias("state"), new["misses"].alias("misses"), F.concat(s["out"], F.array(row)).alias("out"))

    done = rows.select(key, F.explode(F.aggregate("t", start, fold, lambda s: s["out"])).alias("r"))
    return done.select(key, F.col("r.turn").alias(turn), "r.state", "r.misses", "r.action")


#: What the machine can be in before a turn: (state, misses).
_STATES = [(NORMAL, 0), (CONSENT, 0), *((FORM, m) for m in range(MISSES))]
_BITS = (len(_STATES) - 1).bit_length()
#: Turns, or chunks of them, that are composed in one row.
CHUNK = 256


def _picked(packed: Column, state: Column) -> Column:
    """Where a packed map leads from a state's number."""
    return F.call_function("shiftright", packed, (state * _BITS).cast("int")).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")


def turn_map(signal: Column) -> Column:
    """A turn as a map over all states, packed into one number: for each state the number of the one that ``step`` leads to."""
    packed = F.lit(0).cast("long")
    for k, (state, misses) in enumerate(_STATES):
        after = step(F.lit(state), F.lit(misses), signal)
        number = F.coalesce(*(F.when((after["state"] == s) & (after["misses"] == m), n) for n, (s, m) in enumerate(_STATES)))
        packed = packed + F.shiftleft(number.cast("long"), k * _BITS)
    return packed


def _composed(maps: Column) -> Column:
    """The map of all turns one after the other; composition is associative."""
    same = sum(k << k * _BITS for k in range(len(_STATES)))

    def then(done: Column, f: Column) -> Column:
        packed = F.lit(0).cast("long")
        for k in range(len(_STATES)):
            packed = packed + F.shiftleft(_picked(f, _picked(done, F.lit(k))).cast("long"), k * _BITS)
        return packed

    return F.aggregate(maps, F.lit(same).cast("long"), then)


def _before(maps: Column, start: Column) -> Column:
    """The state's number before each of some maps, and after the last."""
    return F.aggregate(maps, F.array(start), lambda seen, f: F.concat(seen, F.array(_picked(f, F.element_at(seen, -1)))))


def _starts(totals: DataFrame, key: str, chunk: int, levels: int) -> DataFrame:
    """(key, _at, _start): the state before each of the rows (key, _at, _map). Chunks of rows are composed apart, their totals scanned on the level above."""
    entries = F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_e")
    maps = F.transform("_e", lambda e: e["_map"])
    if levels == 0:
        rows = totals.groupBy(key).agg(entries).withColumn("_start", F.lit(0))
    else:
        rows = totals.withColumn("_up", F.floor(F.col("_at") / chunk).cast("long")).groupBy(key, "_up").agg(entries)
        above = _starts(rows.select(key, F.col("_up").alias("_at"), _composed(maps).alias("_map")), key, chunk, levels - 1)
        rows = rows.join(above.withColumnRenamed("_at", "_up"), [key, "_up"])
    return rows.select(key, F.inline(F.arrays_zip(F.transform("_e", lambda e: e["_at"]).alias("_at"), F.slice(_before(maps, F.col("_start")), F.lit(1), F.size("_e")).alias("_start"))))


def scan_flow(turns: DataFrame, key: str = "session_id", turn: str = "turn_index", signal: str = "signal", chunk: int = CHUNK, levels: int = 2) -> DataFrame:
    """``run_flow`` as a parallel scan: the same rows, with no session in one row or task.

    Turns of a session go into chunks by ``turn`` div ``chunk``, which are composed apart; chunks of chunks, ``levels`` times, give the state at which each begins. A session of n
    turns numbered without gaps has n / chunk^(levels + 1) entries in the widest row. A chunk is one row, so turns of one number are to be few; they are taken in the order of their signals.
    """
    rows = turns.select(key, F.col(turn).cast("bigint").alias("_turn"), F.floor(F.col(turn) / chunk).cast("long").alias("_at"), F.col(signal).alias("_signal"))
    packed = F.array_sort(F.collect_list(F.struct(F.col("_turn").alias("turn"), F.col("_signal").alias("signal"), turn_map(F.col("_signal")).alias("map")))).alias("_t")
    chunks = rows.groupBy(key, "_at").agg(packed)
    maps = F.transform("_t", lambda t: t["map"])
    starts = _starts(chunks.select(key, "_at", _composed(maps).alias("_map")), key, chunk, levels)
    filled = chunks.join(starts, [key, "_at"]).select(key, F.inline(F.arrays_zip(F.col("_t").alias("t"), F.slice(_before(maps, F.col("_start")), F.lit(1), F.size("_t")).alias("s"))))
    named = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _STATES)), F.col("s") + 1)
    done = filled.select(key, F.col("t.turn").alias(turn), step(named(0), named(1), F.col("t.signal")).alias("r"))
    return done.select(key, turn, "r.state", "r.misses", "r.action")
