"""Problem 2: conversations from message rows, and the conversations to be dropped.

Rows are normalised (spelling of ids and roles, unit of the clock, blanks,
failure notices, repeated deliveries). The clock of each kind of sender is set
right by least squares over the constraints that arrival gives: a reply that
arrives between two questions lies between them in time. Then the messages are
put in order, and each conversation is judged by its reply-before constraints:
every question stands before a reply, and that reply before the next question.
Order and judgement are computed over range partitions, so one conversation may
spread over many tasks: a partition gives a summary of its stretch (first and
last speaker, whether a question was left open), and summaries are chained in
order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.scratch import stage

# Spellings of the speakers.
QUESTION_ROLES = ("user", "human")
REPLY_ROLES = ("assistant", "ai", "bot", "model")
SIDE_ROLES = ("system", "developer", "tool", "function")
#: White space and invisible characters.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ⠀ㅤﾠ]+"
#: What a reply is when no answer was produced; matched against the whole trimmed text in lower case.
FAILURES = (
    r"[\p{P}\p{S}\s]+",
    r"(null|none|undefined|nan|nil|n/?a|empty|void)[.!]?",
    r"[\[<({]\s*(no|empty|missing|blank|null|generation|response|completion|answer|output|request|model|message)?[ _-]*(response|completion|answer|output|reply|content|message|text|aborted|failed|error|timeout|timed out|cancelled|canceled|interrupted|unavailable|removed|deleted)( [a-z]+)?\s*[\]>)}]",
    r"(fatal |internal |server |api |model |llm )*(error|exception)(\s*:|\s+[\-–—]\s|\s+(code\s+)?\d{3}\b).*",
    r"traceback \(most recent call last\).*",
    r"http(/[\d.]+)?( error| status)?:? [45]\d\d\b.{0,60}",
    r"\{\s*\"(error|exception)\"\s*:.*\}",
    r"rate limit (was )?(reached|exceeded|hit)\b.{0,80}",
    r"(the )?(llm|model|api|request|generation|completion|upstream|backend|service)( call| request| model| service)? (has |was |is )?(failed|aborted|timed out|unavailable|overloaded|interrupted|cancelled)(\s*[.:;,!\-–—].{0,80})?",
    r"[\p{P}\p{S}\p{M}\s]*(sorry,? |oops,? )?(but )?(something went wrong|an (unexpected |internal )?error (has )?occurred)([.!,;:]+.{0,120})?",
    r"[\p{P}\p{S}\p{M}\s]*the (model|assistant|service) (did not|didn't|could not|couldn't) (answer|respond|reply)\b.{0,60}",
    r"[\p{P}\p{S}\p{M}\s]*(please )?try again later[.!]?",
)
REPEAT_WITHIN_S = 1.0
#: Corrected replies keep this distance from questions, so that ids needn't decide.
_APART_S = 1e-5
#: Offsets of a sender's clock that are looked for, in seconds; a violation counts up to CLOCK_CAP_S.
CLOCK_REACH_S, CLOCK_CAP_S = 120, 60
#: A clock is set only if that takes away this share of the squared violations, and as it stands it violates this share
#: of its constraints: other violations don't come from the clock.
CLOCK_GAIN, CLOCK_SHARE = 0.5, 0.4
#: Messages whose ids lie within this many of each other are neighbours by arrival.
_ARRIVAL_BLOCK = 1_000_000


def bare(c: Column) -> Column:
    """``c`` without blanks and invisible characters at its ends, '' for null."""
    return F.coalesce(F.regexp_replace(c.cast("string"), f"^{INVISIBLE}|{INVISIBLE}$", ""), F.lit(""))


def speaker(role: Column) -> Column:
    """'user', 'assistant', 'side' (system and tools) or '?' where it can't be told."""
    r = F.lower(bare(role))
    return F.when(r.isin(*QUESTION_ROLES), "user").when(r.isin(*REPLY_ROLES), "assistant").when(r.isin(*SIDE_ROLES), "side").otherwise("?")


def seconds(t: Column) -> Column:
    """An epoch time in seconds, from s, ms, us or ns; null where it is missing, NaN or not positive."""
    t = t.cast("double")
    unit = F.when(t < 1e11, 1.0).when(t < 1e14, 1e3).when(t < 1e17, 1e6).otherwise(1e9)
    return F.when(t.isNull() | F.isnan(t) | (t <= 0) | (t > 1e20), None).otherwise(t / unit)


def is_failure(text: Column) -> Column:
    """Nothing but a failure notice or a stand-in for a missing answer."""
    return F.lower(text).rlike("(?s)^(" + "|".join(FAILURES) + ")$")


def normalise(messages: DataFrame) -> DataFrame:
    """(cid, id, speaker, sender, content, ts, keep): rows with a conversation; keep marks those that can be turns.

    Repeated deliveries and repeats within a second are removed: of the rows with
    the same speaker and content, those with an id that came already or a time
    within a second of the one before.
    """
    text = bare(F.col("content"))
    m = messages.select(
        F.lower(bare(F.col("conversation_id"))).alias("cid"),
        "id",
        speaker(F.col("role")).alias("speaker"),
        F.lower(bare(F.col("role"))).alias("sender"),
        text.alias("content"),
        seconds(F.col("timestamp")).alias("ts"),
    ).where("cid <> ''")
    m = m.withColumn("h", F.xxhash64("content")).repartition("cid", "speaker", "h")
    same_id = Window.partitionBy("cid", "speaker", "h", "id").orderBy(F.col("ts").asc_nulls_last())
    same_text = Window.partitionBy("cid", "speaker", "h").orderBy(F.col("ts").asc_nulls_last(), "id")
    m = m.withColumn("nth", F.when(F.col("id").isNull(), 1).otherwise(F.row_number().over(same_id))).where("nth = 1")
    gap = F.col("ts") - F.lag("ts").over(same_text)
    m = m.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > REPEAT_WITHIN_S + 1e-4))
    turn = (F.col("content") != "") & (F.col("speaker") != "side") & ~((F.col("speaker") == "assistant") & is_failure(F.col("content")))
    return m.select("cid", "id", "speaker", "sender", "content", "ts", turn.alias("keep"))


def arrival_constraints(rows: DataFrame) -> DataFrame:
    """(sender, low, high): between which offsets of its sender's clock a reply lies where it arrived.

    Neighbours by id (which numbers arrivals) are compared, so a reply after a
    question gives a lower bound and one before a question an upper bound.
    """
    kept = rows.where("keep and ts is not null and id is not null and speaker in ('user', 'assistant')")
    block = F.floor(F.col("id").cast("double") / _ARRIVAL_BLOCK)
    w = Window.partitionBy("cid", block).orderBy("id")
    of = lambda f: F.when(f("speaker").over(w) == "user", f("ts").over(w))
    near = kept.select("speaker", "sender", "ts", of(F.lag).alias("before"), of(F.lead).alias("after")).where("speaker = 'assistant'")
    return near.select("sender", (F.col("before") - F.col("ts")).alias("low"), (F.col("after") - F.col("ts")).alias("high")).where("low is not null or high is not null")


def sender_offsets(constraints: DataFrame, reach: int = CLOCK_REACH_S, cap: int = CLOCK_CAP_S) -> dict[str, float]:
    """Seconds to add to the clock of each sender, by least squares over its ``constraints(sender, low, high)``.

    What an offset violates is squared, up to ``cap`` seconds, so broken
    conversations don't pull at a clock without bound. The sums that this needs
    are taken over slots of a second within ``reach``, so a sender gives at most
    a few hundred numbers, whatever the corpus; senders are the spellings of
    REPLY_ROLES. Of equally good offsets the one nearest to none is taken, and
    none at all where CLOCK_GAIN or CLOCK_SHARE isn't reached.
    """
    edge = reach + cap
    bounds = constraints.select("sender", F.lit(1).alias("side"), F.col("low").alias("x")).unionByName(constraints.select("sender", F.lit(-1).alias("side"), (-F.col("high")).alias("x")))
    # an upper bound is a lower one on the clock run backwards
    slot = F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor("x"))).cast("int")
    sums = bounds.where("x is not null").groupBy("sender", "side", slot.alias("slot")).agg(F.count("*").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    table: dict[str, np.ndarray] = {}
    for r in sums.collect():  # at most 2 * (2 * edge + 1) rows a sender
        table.setdefault(r["sender"], np.zeros((2, 2 * edge + 2, 3)))[0 if r["side"] > 0 else 1, r["slot"] + edge] = r["n"], r["s1"], r["s2"]
    return {k: _least_squares(t, reach, cap, edge) for k, t in sorted(table.items())}


def _least_squares(t: np.ndarray, reach: int, cap: int, edge: int) -> float:
    upto = np.concatenate([np.zeros((2, 1, 3)), np.cumsum(t, axis=1)], axis=1)

    def active(side: int, at: int) -> tuple[np.ndarray, float]:
        """Sums of the bounds that an offset ``at`` violates by less than ``cap``, and the number of those by more."""
        a, b = at + edge, min(at + edge + cap, 2 * edge + 1)
        return upto[side, b] - upto[side, a], upto[side, -1, 0] - upto[side, b, 0]

    def loss(at: int) -> float:
        total = 0.0
        for side, x in ((0, at), (1, -at)):
            (n, s1, s2), far = active(side, x)
            total += s2 - 2 * x * s1 + x * x * n + cap * cap * far
        return total

    violated = sum(n + far for (n, _, _), far in (active(0, 0), active(1, 0)))
    if violated < CLOCK_SHARE * upto[:, -1, 0].sum():
        return 0.0
    whole = sorted(range(-reach, reach + 1), key=lambda d: (round(loss(d), 6), abs(d), d))[0]
    if loss(whole) > (1 - CLOCK_GAIN) * loss(0):
        return 0.0
    # between whole seconds the same bounds are violated: their mean is the least
    (n, s1, _), _ = active(0, whole)
    (m, u1, _), _ = active(1, -whole)
    return float(np.clip((s1 - u1) / (n + m), whole - 1, whole + 1)) + _APART_S if n + m else float(whole)


def with_clocks_set(rows: DataFrame) -> DataFrame:
    """``rows`` with the times of replies on the clock of the questions."""
    move = F.lit(0.0)
    for sender, seconds_off in sender_offsets(arrival_constraints(rows)).items():
        if seconds_off:
            move = F.when(F.col("sender") == sender, seconds_off).otherwise(move)
    return rows.withColumn("ts", F.when(F.col("speaker") == "assistant", F.col("ts") + move).otherwise(F.col("ts")))


def order_keys(rows: DataFrame) -> DataFrame:
    """Adds ``at``: the time, or 0 in a conversation that has a message without one, so that ids decide."""
    untimed = rows.where("ts is null").select("cid").distinct().withColumn("untimed", F.lit(True))
    return rows.join(untimed, "cid", "left").withColumn("at", F.when(F.col("untimed"), 0.0).otherwise(F.col("ts"))).drop("untimed")


def clock_offsets(rows: DataFrame, most_s: float) -> DataFrame:
    """(cid, offset): seconds to add to the clock of the replies of a conversation.

    Replies aren't paired with questions: an offset meets all constraints if no
    reply comes before the first question and some reply, of any number, lies
    between each question and the next, or after the last. Reply a serves question
    q with offsets from q - a to next - a, so the offsets without any squared
    violation are those that an interval of every question covers; of these the
    one nearest to none is taken. Where none within ``most_s`` is left there is no
    row, and the conversation stays as it is.
    """
    turns = rows.where("keep and at > 0 and speaker in ('user', 'assistant')")
    q = turns.where("speaker = 'user'").withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy("at", "id")))
    q = q.select("cid", "k", F.col("at").alias("tq"), F.lead("at").over(Window.partitionBy("cid").orderBy("k")).alias("next"))
    a = turns.where("speaker = 'assistant'").select("cid", F.col("at").alias("ta")).distinct()
    # the questions a reply can serve: those within reach of it, and the last one before these
    span, at = 2 * most_s, lambda t: F.floor(t / (2 * most_s))
    near = a.withColumn("slot", F.explode(F.sequence(at(F.col("ta") - most_s), at(F.col("ta") + most_s)))).join(q.withColumn("slot", at(F.col("tq"))), ["cid", "slot"])
    near = near.where((F.col("tq") > F.col("ta") - most_s) & (F.col("tq") <= F.col("ta") + most_s)).select("cid", "k", "tq", "next", "ta")
    line = q.select("cid", F.col("tq").alias("t"), F.struct("k", "tq", "next").alias("q"), F.lit(None).cast("double").alias("ta"))
    line = line.unionByName(a.select("cid", (F.col("ta") - most_s).alias("t"), F.lit(None).cast(line.schema["q"].dataType).alias("q"), "ta"))
    earlier = F.last("q", ignorenulls=True).over(Window.partitionBy("cid").orderBy("t", F.col("ta").asc_nulls_first(), "q.k"))
    before = line.withColumn("q", earlier).where("ta is not null and q is not null").select("cid", "q.k", "q.tq", "q.next", "ta")
    low, high = F.col("tq") - F.col("ta") + _APART_S, F.coalesce(F.col("next") - F.col("ta") - _APART_S, F.lit(span))
    serves = near.unionByName(before).select("cid", "k", low.alias("low"), high.alias("high")).where("low <= high")
    # the intervals of a question, joined where they overlap
    upto = F.max("high").over(Window.partitionBy("cid", "k").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("new").over(Window.partitionBy("cid", "k").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0))
    joined = serves.withColumn("upto", upto).withColumn("new", (F.col("upto").isNull() | (F.col("low") > F.col("upto"))).cast("int")).withColumn("island", island)
    joined = joined.groupBy("cid", "k", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("cid", "low", "high")
    ends = q.groupBy("cid").agg(F.min("tq").alias("tq"), F.count("*").alias("n")).join(a.groupBy("cid").agg(F.min("ta").alias("ta")), "cid")
    joined = joined.unionByName(ends.select("cid", (F.col("tq") - F.col("ta") + _APART_S).alias("low"), F.lit(span).alias("high")).where("low <= high"))
    # along the offsets, where as many intervals are open as there are constraints
    steps = joined.select("cid", F.col("low").alias("x"), F.lit(1).alias("d")).unionByName(joined.select("cid", F.col("high").alias("x"), F.lit(-1).alias("d")))
    along = Window.partitionBy("cid").orderBy("x", F.desc("d"))
    swept = steps.withColumn("open", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("x").over(along))
    free = swept.join(ends.select("cid", "n"), "cid").where(F.col("open") == F.col("n") + 1)
    move = F.greatest("x", F.least(F.lit(0.0), "to"))
    return free.select("cid", move.alias("offset")).groupBy("cid").agg(F.min_by("offset", F.struct(F.abs("offset"), "offset")).alias("offset")).where((F.abs("offset") > 0) & (F.abs("offset") <= most_s + _APART_S))


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """The kept rows, range-partitioned by conversation and order, with ``part`` (ascending in that order)."""
    kept = rows.where("keep")
    return stage(kept.repartitionByRange("cid", "at", "id").withColumn("part", F.spark_partition_id()), name)


def judge(ordered: DataFrame, conversations: DataFrame) -> DataFrame:
    """(cid, reason) of each conversation whose constraints can't be met; ``conversations`` has every cid."""
    here = Window.partitionBy("part", "cid").orderBy("at", "id")
    q = F.col("speaker") == "user"
    step = ordered.select("cid", "part", "at", "id", "speaker", F.lag("speaker").over(here).alias("prev"))
    stretch = step.groupBy("cid", "part").agg(
        F.max((F.col("speaker") == "?").cast("int")).alias("unknown"),
        F.max((q & (F.col("prev") == "user")).cast("int")).alias("open"),
        F.min(F.struct("at", "id", "speaker"))["speaker"].alias("first"),
        F.max(F.struct("at", "id", "speaker"))["speaker"].alias("last"),
    )
    chain = Window.partitionBy("cid").orderBy("part")
    joined = stretch.withColumn("before", F.lag("last").over(chain)).withColumn("after", F.lead("first").over(chain))
    verdict = joined.groupBy("cid").agg(
        F.max("unknown").alias("unknown"),
        F.max(F.when((F.col("before") == "user") & (F.col("first") == "user"), 1).otherwise(F.col("open"))).alias("open"),
        F.max((F.col("before").isNull() & (F.col("first") != "user")).cast("int")).alias("headless"),
        F.max((F.col("after").isNull() & (F.col("last") == "user")).cast("int")).alias("unanswered"),
    )
    reason = (
        F.when(F.col("unknown").isNull(), "nothing said")
        .when(F.col("unknown") > 0, "unknown speaker")
        .when(F.col("headless") > 0, "no question at the start")
        .when((F.col("open") > 0) | (F.col("unanswered") > 0), "question without reply")
    )
    return conversations.join(verdict, "cid", "left").withColumn("reason", reason).where("reason is not null").select("cid", "reason")


def reassemble(messages: DataFrame, max_clock_offset_s: float = 0.0, set_clocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, dropped) of message rows.

    turns: conversation_id, turn (from 1), speaker, content, ts of the sound
    conversations; dropped: conversation_id, reason. Messages stand in order of
    time, then id; where a conversation has a message without a time, ids give
    the order. With ``set_clocks`` the clocks of the senders are set beforehand (:func:`sender_offsets`);
    ``max_clock_offset_s`` above 0 lets the replies of a single conversation be
    moved by at most that much beside, where this meets all its constraints.

    Null, blank and invisible contents are no turns; rows with a null or blank
    conversation belong to none; null ids order before others; an empty table
    gives two empty results. Further columns are ignored.
    """
    rows = normalise(messages)
    if set_clocks:
        rows = with_clocks_set(stage(rows, "rows"))
    rows = stage(order_keys(rows), "messages")
    if max_clock_offset_s > 0:
        # what is in order as it stands needs none
        broken = judge(in_order(rows, "as-stamped"), rows.select("cid").distinct()).select("cid")
        move = clock_offsets(rows.join(broken, "cid", "left_semi"), max_clock_offset_s)
        rows = stage(rows.join(move, "cid", "left").withColumn("at", F.col("at") + F.when(F.col("speaker") == "assistant", F.coalesce("offset", F.lit(0.0))).otherwise(0.0)).drop("offset"), "corrected")
    ordered = in_order(rows, "ordered")
    dropped = stage(judge(ordered, rows.select("cid").distinct()), "dropped")
    sound = ordered.join(dropped, "cid", "left_anti")
    own = sound.groupBy("cid", "part").agg(F.count("*").alias("n"))
    before = own.withColumn("offset", F.sum("n").over(Window.partitionBy("cid").orderBy("part")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("part", "cid").orderBy("at", "id"))
    turns = sound.withColumn("nth", nth).join(before, ["cid", "part"]).select(
        F.col("cid").alias("conversation_id"), (F.col("nth") + F.col("offset")).cast("long").alias("turn"), "speaker", "content", "ts"
    )
    return turns, dropped.select(F.col("cid").alias("conversation_id"), "reason")
