"""Who was on court when: presence intervals, minutes, five-man stints and their score change.

A player's state never depends on another player's. Each own row needs the own row before it, the last
substitutions, the next own row, and the period rows of its game, which come as one short array per game.
Those lookups split by (period interval, order range): one partial aggregate summarises every piece, the
summaries are carried along, and the row-level windows stay inside a piece, so neither a busy player nor a
busy game lands in one task. Lineups follow from the presence changes: running sums over a team's changes
give the number of players on court and, as bits over the team's roster, which ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import clock_seconds, exact_ratio, half_even, period_seconds
from hoopspark.functions.windows import last_before, running_state

CLOSING_ORDER = 1 << 61
WORD_BITS = 62
PLAYER = ["gameId", "personId"]
TEAM = ["gameId", "teamId"]


def _is_player() -> Column:
    person = F.col("personId").try_cast("bigint")
    return person.isNotNull() & (person != 0)


def period_bounds(pbp: DataFrame) -> DataFrame:
    """One row per game: its period starts (S) and ends (E) in order, two per period."""
    marks = pbp.where((F.col("actionType") == "period") & F.col("subType").isin("start", "end"))
    mark = F.struct(
        F.col("orderNumber").cast("bigint").alias("ord"),
        F.when(F.col("subType") == "start", "S").otherwise("E").alias("kind"),
        F.col("period").cast("int").alias("period"),
    )
    return marks.groupBy("gameId").agg(F.array_sort(F.collect_list(mark)).alias("bounds"))


def _last_of(items: Column, kind: str | None = None) -> Column:
    kept = items if kind is None else F.filter(items, lambda b: b["kind"] == kind)
    return F.try_element_at(kept, F.lit(-1))


def _own_rows(pbp: DataFrame, width: int | None) -> DataFrame:
    kind = (
        F.when((F.col("actionType") == "substitution") & (F.col("subType") == "in"), "I")
        .when((F.col("actionType") == "substitution") & (F.col("subType") == "out"), "O")
        .when(~F.col("actionType").isin("substitution", "period"), "X")
    )
    own = pbp.where(_is_player() & kind.isNotNull()).select(
        "gameId", F.col("personId").cast("bigint").alias("personId"), "teamId", "season",
        F.col("orderNumber").cast("bigint").alias("ord"), kind.alias("kind"),
        F.coalesce(clock_seconds("clock"), F.lit(0.0)).alias("clock_s"),
    )
    own = own.join(period_bounds(pbp), "gameId", "left")
    before = F.filter("bounds", lambda b: b["ord"] < F.col("ord"))
    own = own.withColumn("_before", F.coalesce(before, F.array().cast("array<struct<ord:bigint,kind:string,period:int>>")))
    own = own.withColumns({
        "iv": F.size("_before"),
        "rng": F.lit(0) if width is None else F.floor(F.col("ord") / F.lit(int(width))),
        "bound": _last_of(F.col("_before")),
        "start": _last_of(F.col("_before"), "S"),
        "end": _last_of(F.col("_before"), "E"),
        "on": F.when(F.col("kind") == "O", 0).otherwise(1),
    })
    earlier_starts = F.filter("_before", lambda b: b["kind"] == "S")
    return own.withColumn("previous_period", F.try_element_at(earlier_starts, F.lit(-2))["period"]).drop("_before")


def _linked(own: DataFrame) -> DataFrame:
    """Own rows with the own row before, the last substitutions, the next own row, and the state at the
    last period end and start."""
    piece = [*PLAYER, "iv", "rng"]
    state = F.struct("ord", "on")
    came = F.when(F.col("kind") == "I", F.struct("ord", "clock_s"))
    went = F.when(F.col("kind") == "O", F.col("ord"))
    ends = own.groupBy(*piece).agg(
        F.max(state).alias("last"), F.max(came).alias("came"), F.max(went).alias("went"), F.min("ord").alias("first"),
    )
    along = Window.partitionBy(*PLAYER).orderBy("iv", "rng")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    by_interval = Window.partitionBy(*PLAYER).orderBy("iv")
    carried = ends.select(
        *piece,
        F.max("last").over(earlier).alias("c_last"), F.max("came").over(earlier).alias("c_came"),
        F.max("went").over(earlier).alias("c_went"), F.lead("first").over(along).alias("c_next"),
        F.max("last").over(by_interval.rangeBetween(Window.unboundedPreceding, -1)).alias("at_bound"),
        F.max("last").over(by_interval.rangeBetween(Window.unboundedPreceding, -2)).alias("at_end"),
    )
    inside = Window.partitionBy(*piece).orderBy("ord")
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = own.join(carried, piece)
    return joined.withColumns({
        "prev": F.coalesce(F.lag(state).over(inside), F.col("c_last")),
        "came": F.coalesce(F.max(came).over(up_to), F.col("c_came")),
        "went": F.coalesce(F.max(went).over(up_to), F.col("c_went")),
        "next": F.coalesce(F.lead("ord").over(inside), F.col("c_next")),
    }).drop("c_last", "c_came", "c_went", "c_next")


def presence_changes(pbp: DataFrame, width: int | None = None) -> DataFrame:
    """Every arrival (+1) and departure (-1) of a player, also those a period boundary brings about.

    Arrivals: a substitution in; any other action of an absent player, dated back to the period start; a
    period start for those on court at the end before it and not substituted since. Departures: a
    substitution out, a period end, the end of the game. ``clock`` is the clock of the change;
    ``entry_clock``, on departures, the one minutes are counted from (a repeated substitution in restarts
    it). The feed opens every game with a period start.
    """
    rows = _linked(_own_rows(pbp, width))
    ord_, kind = F.col("ord"), F.col("kind")
    between = F.coalesce(F.col("bound.kind") == "E", F.lit(False))
    never = F.lit(-(1 << 62))
    at_end = F.coalesce(F.col("end.ord"), never)
    present = F.coalesce(
        (F.col("prev.on") == 1) & (~between | (F.col("prev.ord") > F.col("bound.ord"))), F.lit(False)
    )
    plen = period_seconds("start.period")
    # last own row before the last period end, and before the last period start
    was_on = F.coalesce(F.when(between, F.col("at_bound.on")).otherwise(F.col("at_end.on")) == 1, F.lit(False))
    early = ~between & ~was_on & (F.col("at_bound.on") == 1) & (F.col("at_bound.ord") > at_end) & (
        F.coalesce(F.col("went"), never) < F.col("bound.ord")
    )
    came_now = (F.col("came.ord") > F.coalesce(F.col("went"), never)) & (F.col("came.ord") > at_end)
    entry = (
        F.when(came_now, F.col("came.clock_s"))
        .when(early, period_seconds("previous_period"))
        .otherwise(plen)
    )
    rows = rows.withColumns({"present": present, "between": between, "entry": entry, "plen": plen, "was_on": was_on})
    after = (
        F.when(kind == "I", F.col("clock_s"))
        .when((kind == "X") & F.col("present"), F.col("entry"))
        .when(kind == "X", F.col("plen"))
    )
    gap = F.filter(
        "bounds", lambda b: (b["ord"] > ord_) & (F.col("next").isNull() | (b["ord"] < F.col("next")))
    )
    sub_since = (F.greatest(F.coalesce(F.col("came.ord"), never), F.coalesce(F.col("went"), never)) > at_end) | (kind != "X")
    rows = rows.withColumns({
        "after": after, "stays": F.when(kind == "O", False).otherwise(F.lit(True)), "gap": F.coalesce(gap, F.array().cast("array<struct<ord:bigint,kind:string,period:int>>")),
        "again": F.col("between") & F.col("was_on") & ~sub_since,
    })

    def event(o, delta, clock, since=None, carried=False):
        return F.struct(
            o.cast("bigint").alias("ord"), F.lit(delta).alias("delta"), clock.cast("double").alias("clock"),
            (F.lit(None) if since is None else since).cast("double").alias("entry_clock"),
            F.lit(carried).alias("carried"),
        )

    def start_clock(b, i):
        """Clock minutes count from after the i-th boundary of the gap, a period start."""
        return F.when((i == 0) & F.col("between") & ~F.col("again"), F.col("after")).otherwise(period_seconds(b["period"]))

    def at_boundary(b, i):
        opened = F.when(i == 0, F.col("after")).otherwise(start_clock(F.get("gap", i - 1), i - 1))
        arrival = F.when(~((i == 0) & F.col("between")), event(b["ord"], 1, period_seconds(b["period"]), carried=True))
        return F.when(b["kind"] == "E", event(b["ord"], -1, F.lit(0.0), opened)).otherwise(arrival)

    own_event = (
        F.when((kind == "O") & F.col("present"), event(ord_, -1, F.col("clock_s"), F.col("entry")))
        .when((kind == "I") & ~F.col("present"), event(ord_, 1, F.col("clock_s")))
        .when((kind == "X") & ~F.col("present") & F.col("plen").isNotNull(), event(ord_, 1, F.col("plen")))
    )
    n = F.size("gap")
    last_open = F.when(n == 0, F.col("after")).otherwise(start_clock(F.get("gap", n - 1), n - 1))
    closing = F.when(
        F.col("next").isNull() & ((n == 0) | (F.get("gap", n - 1)["kind"] == "S")),
        event(F.lit(CLOSING_ORDER), -1, F.lit(0.0), last_open),
    )
    later = F.when(F.col("stays"), F.concat(F.transform("gap", at_boundary), F.array(closing))).otherwise(
        F.array().cast("array<struct<ord:bigint,delta:int,clock:double,entry_clock:double,carried:boolean>>")
    )
    events = F.filter(F.concat(F.array(own_event), later), lambda e: e.isNotNull())
    return rows.select(*PLAYER, "teamId", "season", F.explode(events).alias("e")).select(
        *PLAYER, "teamId", "season", "e.*"
    )


def presence(pbp: DataFrame, width: int | None = None) -> DataFrame:
    """Closed presence intervals: entry and exit clock and the row that closes them."""
    return presence_changes(pbp, width).where("delta = -1").select(
        *PLAYER, F.col("ord").alias("end_ord"), "entry_clock", F.col("clock").alias("exit_clock")
    )


def minutes(pbp: DataFrame, width: int | None = None) -> DataFrame:
    """Minutes on court per player-game, one decimal."""
    entry, exit_ = (F.round(100 * F.col(c)).cast("bigint") for c in ("entry_clock", "exit_clock"))
    spent = presence(pbp, width).groupBy(*PLAYER).agg(F.sum(F.greatest(F.lit(0).cast("bigint"), entry - exit_)).alias("_hundredths"))
    return spent.select(*PLAYER, exact_ratio("_hundredths", F.lit(6000), 1).alias("min"))


def rosters(pbp: DataFrame) -> DataFrame:
    """Players of each team in each game, sorted; the rules allow at most fifteen."""
    seen = pbp.where(_is_player() & F.col("teamId").isNotNull())
    return seen.groupBy(*TEAM).agg(F.array_sort(F.collect_set(F.col("personId").cast("bigint"))).alias("roster"))


def team_changes(pbp: DataFrame, width: int | None = None) -> DataFrame:
    """Lineup changes of each team in row order, with the change in head count and in roster bits.

    A roster of any length is cut into words of WORD_BITS players; each change is one row per word of its team's roster.
    """
    moves = presence_changes(pbp, width).select(*TEAM, "season", "ord", "delta", "personId", "clock", "carried")
    subs = pbp.where(
        (F.col("actionType") == "substitution") & F.col("subType").isin("in", "out") & _is_player()
        & F.col("teamId").isNotNull()
    ).select(
        *TEAM, "season", F.col("orderNumber").cast("bigint").alias("ord"), F.lit(0).alias("delta"),
        F.lit(None).cast("bigint").alias("personId"), F.coalesce(clock_seconds("clock"), F.lit(0.0)).alias("clock"),
        F.lit(False).alias("carried"),
    )
    place = F.array_position("roster", F.col("personId")).cast("int") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % WORD_BITS) * F.col("delta")
    moved = F.when(F.col("personId").isNotNull(), F.struct(F.floor(place / WORD_BITS).cast("int").alias("word"), bit.alias("bit")))
    changes = moves.unionByName(subs).join(rosters(pbp), TEAM).groupBy(*TEAM, "ord").agg(
        F.sum("delta").alias("delta"), F.collect_list(moved).alias("_moved"), F.max("clock").alias("clock"),
        F.max("carried").alias("carried"), F.max("season").alias("season"), F.max(F.size("roster")).alias("_size"),
    )
    words = F.sequence(F.lit(0), F.floor((F.col("_size") - 1) / WORD_BITS).cast("int"))
    own = F.filter("_moved", lambda m: m["word"] == F.col("word"))
    return changes.withColumn("word", F.explode(words)).withColumn(
        "bits", F.aggregate(own, F.lit(0).cast("bigint"), lambda a, m: a + m["bit"])).drop("_moved", "_size")


def _segments(changes: DataFrame, pbp: DataFrame, ahead: dict, width: int | None) -> DataFrame:
    states = running_state(
        changes, [*TEAM, "word"], "ord", {"on_court": "delta", "mask": "bits"},
        {"end_ord": "ord", "end_clock": "clock", "end_carried": "carried", **ahead}, width,
    )
    fives = states.where((F.col("on_court") == 5) & F.col("end_ord").isNotNull() & ~F.col("end_carried"))
    rest = [c for c in fives.columns if c not in (*TEAM, "ord", "word", "mask", "bits")]
    fives = fives.groupBy(*TEAM, "ord").agg(
        *[F.first(c).alias(c) for c in rest], F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("masks"))
    bit_of = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int") % WORD_BITS)
    chosen = F.filter("roster", lambda p, i: F.get("masks", F.floor(i / WORD_BITS).cast("int")).bitwiseAND(bit_of(i)) != 0)
    spent = F.greatest(F.lit(0.0), F.col("clock") - F.col("end_clock")) / 60.0
    return fives.join(rosters(pbp), TEAM).withColumns({"min": half_even(spent, 2), "lineup": chosen}).withColumnRenamed(
        "ord", "start_ord"
    )


def lineup_segments(pbp: DataFrame, width: int | None = None) -> DataFrame:
    """Every stretch between two lineup changes of a team with exactly five players on court.

    A change is a substitution, a late first action, or a period boundary. Minutes run from the clock of
    the opening change to the clock of the closing one, rounded to two decimals.
    """
    rows = _segments(team_changes(pbp, width), pbp, {}, width)
    return rows.select(*TEAM, "start_ord", "end_ord", "season", "min", "lineup")


def score_margins(pbp: DataFrame, width: int | None = None) -> DataFrame:
    """Home minus away score at every row of a game and at its end: last known scores, 0 before any."""
    rows = pbp.select(
        "gameId", F.col("orderNumber").cast("bigint").alias("ord"),
        F.col("scoreHome").try_cast("double").alias("h"), F.col("scoreAway").try_cast("double").alias("a"),
    )
    final = pbp.select("gameId").distinct().withColumn("ord", F.lit(CLOSING_ORDER).cast("bigint"))
    rows = rows.unionByName(final, allowMissingColumns=True)
    filled = last_before(rows, ["gameId"], "ord", {"_h": F.col("h"), "_a": F.col("a")}, width, inclusive=True)
    return filled.select(
        "gameId", "ord",
        (F.coalesce(F.col("_h"), F.lit(0.0)) - F.coalesce(F.col("_a"), F.lit(0.0))).alias("margin"),
    )


def scored_segments(pbp: DataFrame, schedule: DataFrame, width: int | None = None) -> DataFrame:
    """Five-man segments with the score change seen from the lineup's side."""
    changes = team_changes(pbp, width).join(score_margins(pbp, width), ["gameId", "ord"])
    rows = _segments(changes, pbp, {"end_margin": "margin"}, width)
    sided = rows.join(schedule.select("gameId", "home_team_id"), "gameId", "left")
    sign = F.when(F.col("teamId") == F.col("home_team_id"), 1.0).otherwise(-1.0)
    return sided.withColumn("net_pts", half_even(sign * (F.col("end_margin") - F.col("margin")), 1)).select(
        *TEAM, "start_ord", "end_ord", "season", "min", "lineup", "net_pts"
    )
