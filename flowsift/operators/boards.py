"""Job boards, workers and requests: order, claims, liveness, matching."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import earlier_ranges
from .graphs import kept as cut
from .history import micros
from .states import PRIORITIES


def priority_rank(priority: Column) -> Column:
    """0 to 4; null for an unknown name. Case doesn't count."""
    return F.when(F.upper(priority).isin(PRIORITIES), F.array_position(F.array(*map(F.lit, PRIORITIES)), F.upper(priority)).cast("int") - 1)


def placed(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds `place`, from 1 within the group in the given order.

    Rows are dealt into ranges of (group, order); a row's place is its place in the range
    and the sizes of the group's ranges before it, so a large group is many tasks' work.
    """
    ranges = cut(df.repartitionByRange(F.col(group).asc(), *order).withColumn("__part", F.spark_partition_id()))
    within = ranges.withColumn("__place", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)))
    both = within.join(earlier_ranges(ranges, group, F.count("*")), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")), "left")
    return both.select(*df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__place")).cast("int").alias("place"))


def board_order(jobs: DataFrame, mode: str = "contract") -> DataFrame:
    """Place of every job on its board. contract: high priority first, then oldest; ascending
    and descending are the orders that boards really give."""
    rank = priority_rank(F.col("priority"))
    order = {"contract": (rank.desc(), F.asc("sequence")), "ascending": (rank.asc(), F.asc("sequence")), "descending": (rank.desc(), F.desc("sequence"))}[mode]
    return placed(jobs, "board", list(order))


def iter_jobs(jobs: DataFrame, only_unclaimed: bool = False) -> DataFrame:
    states = ["UNCLAIMED"] if only_unclaimed else ["UNCLAIMED", "CLAIMED", "COMPLETE"]
    return board_order(jobs.where(F.col("state").isin(states)))


#: Jobs of a board up to which the next ones are ranked in one task.
KEPT = 10_000


def claimable(jobs: DataFrame, most: int, in_flight: int = 0, max_dispatches: int | None = None) -> DataFrame:
    """The next unclaimed jobs of every board, `most - in_flight` of them; most <= 0 means no limit.

    max_dispatches is a further limit: none or a negative one means no limit, 0 no job. With a limit a
    task gives as many rows of a board at most before the shuffle (a ranking window with a
    limit on the rank, which Spark ranks on both sides of it); up to KEPT rows a board are
    ranked so, more of them are placed in ranges.
    """
    limits = ([max(0, most - in_flight)] if most > 0 else []) + ([max_dispatches] if max_dispatches is not None and max_dispatches >= 0 else [])
    if not limits or min(limits) > KEPT:
        ordered = iter_jobs(jobs, only_unclaimed=True)
        return ordered.where(F.col("place") <= min(limits)) if limits else ordered
    first = Window.partitionBy("board").orderBy(priority_rank(F.col("priority")).desc(), F.asc("sequence"))
    return jobs.where("state = 'UNCLAIMED'").withColumn("place", F.row_number().over(first)).where(F.col("place") <= min(limits))


def dispatch_order(ready: DataFrame, group: str, pos: str) -> DataFrame:
    """Place of ready atoms within their group by numeric priority, the highest first, ties in the order of `pos`."""
    return placed(ready, group, [F.desc("priority"), F.asc(pos)])


def job_state(postings: DataFrame, claims: DataFrame, as_of: Column) -> DataFrame:
    """No posting: COMPLETE; a claim that lives at as_of: CLAIMED; else UNCLAIMED."""
    both = postings.select("job", F.lit(True).alias("posted")).join(claims.select("job", "claimed_at", "expiry_s"), "job", "full")
    ends = F.timestamp_micros(micros(F.col("claimed_at")) + F.round(F.col("expiry_s") * 1_000_000).cast("bigint"))
    live = F.col("claimed_at").isNotNull() & (F.col("expiry_s").isNull() | (as_of < ends))
    return both.select("job", F.when(F.col("posted").isNull(), "COMPLETE").when(live, "CLAIMED").otherwise("UNCLAIMED").alias("state"))


def claim_lost(transitions: DataFrame, claims: DataFrame, expected: Column) -> DataFrame:
    """As-of join: for every transition of a job the claim in force, lost if the owner isn't the expected one.

    Both sides are laid into one sorted stream per job, so no range join is made.
    """
    left = transitions.select("job", "ts", "seq", F.lit(1).alias("side"), F.lit(None).cast("string").alias("owner"))
    right = claims.select("job", "ts", "seq", F.lit(0).alias("side"), "owner")
    w = Window.partitionBy("job").orderBy("ts", "side", "seq")
    held = left.unionByName(right).withColumn("owner", F.last("owner", ignorenulls=True).over(w)).where("side = 1")
    return held.select("job", "seq", "owner", (~F.col("owner").eqNullSafe(expected)).alias("lost"))


OWNED = ("claim", "consume", "abandon", "trash")


class Board:
    """One job's place on a board: whether it is there, who owns it until when, whether it was trashed."""

    def __init__(self) -> None:
        self.there, self.trashed, self.owner, self.until, self.modified = False, False, None, None, None

    def owner_at(self, at: int) -> str | None:
        """The owner, unless the claim has lapsed by itself."""
        return None if self.until is not None and at >= self.until else self.owner

    def take(self, command: str, who: str | None, at: int, expiry_s: float | None) -> str:
        """The result of a command at a time in microseconds; the errors leave the board as it is, but that
        claiming again what one owns is noted and applies a new expiry."""
        self.owner = self.owner_at(at)
        self.until = self.until if self.owner is not None else None
        given = expiry_s is not None and expiry_s == expiry_s  # not NaN
        if command in OWNED and not (isinstance(who, str) and who.strip()):
            return "BAD_OWNER"
        if (command == "claim" and given or command == "extend") and not (given and expiry_s * 1000 >= 1):
            return "BAD_EXPIRY"
        until = at + round(expiry_s * 1_000_000) if given else None
        if command == "post":
            if self.there:
                return "ALREADY_POSTED"
            self.__init__()
            self.there = True
            return "OK"
        if command == "extend":
            if not self.there or self.owner is None:
                return "NOT_EXTENDED"
            self.until = until
            return "OK"
        if not self.there:
            return "UNKNOWN_JOB"
        if command == "claim":
            if self.owner is not None:
                if self.owner == who:
                    self.modified, self.until = at, until if given else self.until
                return "ALREADY_CLAIMED"
            self.owner, self.until, self.modified = who, until, at
            return "OK"
        if self.owner is None:
            return "UNKNOWN_OWNER"
        if self.owner != who:
            return "WRONG_OWNER"
        self.owner = self.until = None
        self.modified = None if command == "consume" else at
        self.there, self.trashed = command == "abandon", command == "trash"
        return "OK"


    def dump(self) -> str:
        return json.dumps((self.there, self.trashed, self.owner, self.until, self.modified))

    @classmethod
    def load(cls, text: str | None) -> Board:
        board = cls()
        if text is not None:
            board.there, board.trashed, board.owner, board.until, board.modified = json.loads(text)
        return board


#: An owner that no command names, how a range without an owner is known; owners of a range whose first boards are tried each by itself.
STRANGER, FREE, NAMED = "\0", "\1", 8


def _dealt(commands: DataFrame) -> DataFrame:
    """Commands in ranges of (job, at, seq), with the number of their range; `key` is the job as text, told apart from null."""
    expiry = F.col("expiry_s").cast("double") if "expiry_s" in commands.columns else F.lit(None).cast("double")
    key = F.coalesce(F.concat(F.lit("="), F.col("job").cast("string")), F.lit(""))
    at = F.coalesce(micros(F.col("ts")), F.lit(0))
    rows = commands.select(key.alias("key"), F.col("seq").cast("bigint").alias("seq"), at.alias("at"), "who", "command", expiry.alias("expiry_s"))
    rows = rows.repartitionByRange("key", "at", "seq").sortWithinPartitions("key", "at", "seq")
    return cut(rows.withColumn("part", F.spark_partition_id()))


def _runs(batches: Iterator[pd.DataFrame], start: Callable[[int], str | None]) -> Iterator[tuple]:
    """(key, board, batch's rows, results) for each stretch of one job in a batch; the first job of a range starts from start(part)."""
    key, board = None, None
    for b in batches:
        part = int(b["part"].iloc[0]) if len(b) else 0
        for k, rows in b.groupby("key", sort=False):
            if board is None or k != key:
                board, key = Board.load(start(part) if board is None else None), k
            yield k, board, rows, [board.take(*c) for c in zip(rows["command"], rows["who"], rows["at"], rows["expiry_s"])]


def _incoming(dealt: DataFrame) -> tuple[dict[int, str], set[int]]:
    """For each range the board of its first job before it, where that job began in an earlier range; and the
    ranges whose last job goes on.

    A first pass tells how each range ends. One that holds a single job's commands ends by how it
    begins, so it is run for a job that isn't there, one without an owner, one that a stranger owns and ones that
    the first few workers own that it names; what the ranges before it say then predicts its begin. Ranges whose begin is only predicted are
    run from there, all at once, and where one ends otherwise than predicted, those behind it are
    predicted and run again. So each begin is one that a run has given, and usually one or two
    passes are enough. A range gives one row.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, until, part = [], 0, None
        tried = {"": Board(), FREE: Board(), STRANGER: Board()}  # by how the range begins
        tried[FREE].there = tried[STRANGER].there = True
        tried[STRANGER].owner = STRANGER
        for b in batches:
            part = int(b["part"].iloc[0]) if len(b) else part
            for key, rows in b.groupby("key", sort=False):
                if not heads or heads[-1] != key:
                    tried = tried if not heads else {"": Board()}
                    heads = [*heads[:1], key]
                for c in zip(rows["command"], rows["who"], rows["at"], rows["expiry_s"]):
                    if STRANGER in tried and tried[STRANGER].owner == STRANGER and c[1] not in tried and isinstance(c[1], str) and len(tried) < 3 + NAMED:
                        tried[c[1]] = Board.load(tried[STRANGER].dump())  # until now the same
                        tried[c[1]].owner = c[1]
                    for board in {id(x): x for x in tried.values()}.values():
                        board.take(*c)
                same: dict[str, Board] = {}  # boards that have come to the same go on as one
                tried = {how: same.setdefault(x.dump(), x) for how, x in tried.items()}
                until = int(rows["at"].iloc[-1])
        if heads:
            yield pd.DataFrame([(part, heads[0], heads[-1], until, json.dumps({how: x.dump() for how, x in tried.items()}))], columns=["part", "head", "last", "until", "ends"])

    found = sorted(map(tuple, dealt.mapInPandas(first, "part int, head string, last string, until bigint, ends string").collect()))
    ran: dict[int, tuple[str, str]] = {}  # begin and end of ranges that were run
    while True:
        held, before, at, begins, goes_on, ask = None, None, Board().dump(), {}, set(), {}
        for part, head, last, until, ends in found:
            begin = at if head == held else Board().dump()
            if head == held:
                begins[part] = begin
                goes_on.add(before)
            ends = json.loads(ends)
            if len(ends) == 1:
                at = ends[""]
            elif part in ran and ran[part][0] == begin:
                at = ran[part][1]
            elif begin == Board().dump():
                at = ends[""]
            else:
                ask[part] = begin
                at = _predicted(Board.load(begin), {how: Board.load(x) for how, x in ends.items()}, until)
            held, before = last, part
        if not ask:
            return begins, goes_on
        ran |= _ran(dealt, ask)


def _predicted(begin: Board, ends: dict[str, Board], until: int) -> str:
    """How a range of one job's commands probably ends."""
    if begin.there and begin.owner is not None and (begin.until is None or begin.until > until):
        end = ends.get(begin.owner, ends[STRANGER])
        same = end.owner in (STRANGER, begin.owner)
        end.owner, end.until = (begin.owner, begin.until if end.until is None else end.until) if same else (end.owner, end.until)
    else:
        end = ends[FREE if begin.there else ""]
    end.modified = begin.modified if end.modified is None and end.there else end.modified
    return end.dump()


def _ran(dealt: DataFrame, begins: dict[int, str]) -> dict[int, tuple[str, str]]:
    """(begin, end) of these ranges, which hold one job each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, board = None, None
        for b in batches:
            part = int(b["part"].iloc[0]) if len(b) else part
            if part is not None and part not in begins:
                return
            board = board or Board.load(begins[part])
            for c in zip(b["command"], b["who"], b["at"], b["expiry_s"]):
                board.take(*c)
        if board:
            yield pd.DataFrame([(part, board.dump())], columns=["part", "end"])

    return {part: (begins[part], end) for part, end in dealt.mapInPandas(run, "part int, end string").collect()}


def _each_job(commands: DataFrame, told: str) -> DataFrame:
    """Boards replayed in ranges; a task holds one job's Board at a time, however many commands it has.

    told: `results` for a row for each command, `board` for a row for each job.
    """
    dealt = _dealt(commands)
    begins, goes_on = _incoming(dealt)
    key = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(commands.schema["job"].dataType).alias("job")

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, _, rows, out in _runs(batches, begins.get):
            yield pd.DataFrame({"key": k, "seq": rows["seq"].to_numpy(), "result": out})

    def boards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = None, None
        for k, board, rows, _ in _runs(batches, begins.get):
            part = int(rows["part"].iloc[0])
            if held is not None and held[0] != k:
                yield final(*held)
            held = k, board
        if held is not None and part not in goes_on:
            yield final(*held)

    def final(key: str, b: Board) -> pd.DataFrame:
        out = pd.DataFrame([(key, b.there, b.trashed, b.owner, b.until, b.modified)], columns=["key", "there", "trashed", "owner", "until", "modified"])
        return out.astype({"until": "Int64", "modified": "Int64"})

    if told == "results":
        return dealt.mapInPandas(results, "key string, seq bigint, result string").select(key, "seq", "result")
    return dealt.mapInPandas(boards, "key string, there boolean, trashed boolean, owner string, until bigint, modified bigint").select(key, "there", "trashed", "owner", "until", "modified")


def arbitrate_jobs(commands: DataFrame) -> DataFrame:
    """(job, seq, result) of the commands (job, ts, seq, who, command, and expiry_s if there is one) in time order.

    post, claim, extend, abandon, consume and trash. Claiming what isn't there or is owned, and
    acting on another's job, are errors and change nothing; a claim with an expiry lapses by
    itself, and extend gives a claim in force a new one. Commands are replayed in ranges of
    (job, ts, seq), so one job with most of them is many tasks' work. A null job is a job, a null
    ts counts as 1970.
    """
    return _each_job(commands, "results")


def final_board(commands: DataFrame, as_of: Column) -> DataFrame:
    """(job, state, owner, until, modified) after all commands, as seen at as_of: CLAIMED, UNCLAIMED, TRASHED or GONE.

    until and modified are microseconds since 1970: when the claim lapses, and the last claim,
    abandon or trash.
    """
    last = _each_job(commands, "board")
    live = F.col("owner").isNotNull() & (F.col("until").isNull() | (micros(as_of) < F.col("until")))
    state = F.when(F.col("there"), F.when(live, "CLAIMED").otherwise("UNCLAIMED")).when(F.col("trashed"), "TRASHED").otherwise("GONE")
    return last.select("job", state.alias("state"), F.when(live, F.col("owner")).alias("owner"), F.when(live, F.col("until")).alias("until"), "modified")


def worker_sessions(beats: DataFrame, expiry_s: float) -> DataFrame:
    """Sessions of beats less than expiry_s apart; silence of expiry_s or more ends one. None or <= 0: never."""
    w = Window.partitionBy("topic").orderBy("ts", "seq")
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w))
    fresh = F.lit(False) if not expiry_s or expiry_s <= 0 else F.coalesce(gap >= round(expiry_s * 1_000_000), F.lit(False))
    numbered = beats.select("topic", "ts", "seq", fresh.cast("int").alias("fresh")).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return numbered.groupBy("topic", "session").agg(F.min("ts").alias("since"), F.max("ts").alias("last_seen"), F.count("*").alias("beats"))


def task_set(beats: DataFrame) -> Column:
    """A beat's tasks as text in which neither order nor repeats count: those of the array `tasks`, or the one of `task`."""
    return F.to_json(F.array_sort(F.array_distinct("tasks" if "tasks" in beats.columns else F.array("task"))))


def worker_identities(beats: DataFrame) -> DataFrame:
    """(seq, topic, identity) of each beat: another set of tasks than the topic's last one makes a new number, from 0."""
    w = Window.partitionBy("topic").orderBy("ts", "seq")
    rows = beats.select("topic", "ts", "seq", task_set(beats).alias("set"))
    fresh = F.coalesce(~F.col("set").eqNullSafe(F.lag("set").over(w)) & F.lag("seq").over(w).isNotNull(), F.lit(False))
    rows = rows.withColumn("fresh", fresh.cast("int"))
    return rows.select("seq", "topic", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("identity"))


def worker_registry(beats: DataFrame) -> DataFrame:
    """(topic, identity, task or tasks, last_seen) of a topic's workers: another set of tasks than before makes a new one.

    beats: (topic, ts, seq) with `tasks`, an array, or `task`, a set of one.
    """
    what = "tasks" if "tasks" in beats.columns else "task"
    numbered = beats.join(worker_identities(beats), ["seq", "topic"])
    return numbered.groupBy("topic", "identity").agg(F.min_by(what, F.struct("ts", "seq")).alias(what), F.max("ts").alias("last_seen"))


def expire_requests(states: DataFrame, timeout_s: float, as_of: Column | None = None) -> DataFrame:
    """(request, expired) of the requests that are decided at as_of, which is the last ts of all by itself.

    A request is opened by its first WAITING or PENDING row; what comes before that doesn't count. It
    is decided by the first stop state behind it, or once timeout_s are over without one, and
    has expired if it waited for longer than timeout_s.
    """
    waiting, stop = F.col("state").isin("WAITING", "PENDING"), F.col("state").isin("RUNNING", "SUCCESS", "FAILURE")
    at = F.struct("ts", "seq")
    opened = states.where(waiting).groupBy("request").agg(F.min(at).alias("created"))
    stopped = states.where(stop).join(opened, "request").where(at > F.col("created")).groupBy("request").agg(F.min("ts").alias("stopped"))
    by = opened.join(stopped, "request", "left")
    now = states.agg(F.max("ts").alias("now")) if as_of is None else states.sparkSession.range(1).select(as_of.alias("now"))
    by = by.join(F.broadcast(now), F.lit(True))  # a single row
    late = micros(F.coalesce("stopped", "now")) - micros(F.col("created.ts")) > round(timeout_s * 1_000_000)
    return by.select("request", late.alias("expired"), F.col("stopped").isNotNull().alias("__stopped")).where("expired OR __stopped").drop("__stopped")


def match_workers(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """A live worker with the request's task, the same one every time; null if there is none.

    Workers are numbered per task and the request's hash picks a number: one join row for
    each request, also where very many workers have one task.
    """
    numbered = workers.distinct().withColumn("n", F.row_number().over(Window.partitionBy("task").orderBy("worker")) - 1)
    many = workers.distinct().groupBy("task").agg(F.count("*").alias("many"))
    picked = requests.join(many, "task", "left").withColumn("n", F.pmod(F.col("request"), F.coalesce("many", F.lit(1))))
    return picked.join(numbered, ["task", "n"], "left").select("request", "task", "worker", F.when(F.col("worker").isNull(), "WAITING").otherwise("PENDING").alias("state"))


def match_live_workers(requests: DataFrame, workers: DataFrame, as_of: Column, expiry_s: float | None = 60.0) -> DataFrame:
    """match_workers() with the workers (worker, tasks array, last_seen) that are alive at as_of.

    A worker is alive while it was seen less than expiry_s ago; none or <= 0: for ever. A worker
    with several rows counts by its last one.
    """
    last = workers.groupBy("worker").agg(F.max_by("tasks", "last_seen").alias("tasks"), F.max("last_seen").alias("last_seen"))
    if expiry_s and expiry_s > 0:
        last = last.where(micros(as_of) - micros(F.col("last_seen")) < round(expiry_s * 1_000_000))
    return match_workers(requests, last.select("worker", F.explode("tasks").alias("task")))


#: Listeners of '*' that are held in one row, and of such rows that are broadcast.
LISTENERS, TOLD = 1_000, 100


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event to the listeners of its type and of '*'; an event of type '*' goes to nobody."""
    told = notify(events.select("seq", "event_type", F.lit(None).cast("string").alias("details")), subscriptions.select("event_type", "listener", F.monotonically_increasing_id().alias("pos")))
    return told.select("seq", "event_type", "listener")


def notify(events: DataFrame, subscriptions: DataFrame, wanted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(seq, event_type, details, listener, place): who is told of each event, in order.

    events: (seq, event_type, details), null details read as `{}`; subscriptions: (event_type,
    listener, pos). Listeners of '*' come first, each group in the order of pos. wanted: a
    predicate of details and listener. Listeners of '*' meet the events as arrays of some
    LISTENERS: up to TOLD of these are broadcast, more are joined by their numbers.
    """
    real = events.where("event_type <> '*'").withColumn("details", F.coalesce("details", F.lit("{}")))
    own = real.join(subscriptions.where("event_type <> '*'"), "event_type").select("seq", "event_type", "details", F.lit(1).alias("turn"), "pos", "listener")
    all_ = subscriptions.where("event_type = '*'")
    blocks = -(-all_.count() // LISTENERS) or 1
    every = all_.groupBy(F.pmod(F.xxhash64("listener", "pos"), F.lit(blocks)).alias("__b")).agg(F.collect_list(F.struct("pos", "listener")).alias("__all"))
    met = real.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__b", F.col("__b").cast("bigint"))
    stars = met.join(F.broadcast(every) if blocks <= TOLD else every, "__b").select("seq", "event_type", "details", F.lit(0).alias("turn"), F.inline("__all"))
    told = stars.unionByName(own)
    told = told.where(F.coalesce(wanted(F.col("details"), F.col("listener")), F.lit(False))) if wanted else told
    order = Window.partitionBy("seq").orderBy("turn", "pos", "listener")
    return told.withColumn("place", F.row_number().over(order)).select("seq", "event_type", "details", "listener", "place")


def claim_watch(transitions: DataFrame, board: DataFrame, expected: Column) -> DataFrame:
    """(job, seq, owner, lost, why): claim_lost() against all that happened on the board.

    transitions: (job, ts, seq); board: the commands that were done (job, ts, seq, command,
    who, expiry_s), as post, claim, extend, abandon, consume and trash. A claim is lost if the
    job is MISSING, UNCLAIMED (never claimed, given back or expired) or owned by OTHERs. One
    sorted stream per job; a command at the time of a transition comes before it.
    """
    c = F.col("command")
    until = F.when(F.col("expiry_s").isNotNull(), micros(F.col("ts")) + F.round(F.col("expiry_s") * 1_000_000).cast("bigint"))
    there = F.when(c == "post", True).when(c.isin("consume", "trash"), False)
    held = F.when(c == "claim", F.struct(F.col("who").alias("owner"))).when(c.isin("post", "abandon", "consume", "trash"), F.struct(F.lit(None).cast("string").alias("owner")))
    ends = F.when(c.isin("post", "claim", "abandon", "consume", "trash") | ((c == "extend") & until.isNotNull()), F.struct(until.alias("until")))
    told = board.select("job", "ts", "seq", F.lit(0).alias("side"), there.alias("there"), held.alias("held"), ends.alias("ends"))
    asked = transitions.select("job", "ts", "seq", F.lit(1).alias("side")).withColumns({k: F.lit(None).cast(told.schema[k].dataType) for k in ("there", "held", "ends")})
    w = Window.partitionBy("job").orderBy("ts", "side", "seq")
    both = told.unionByName(asked).withColumns({k: F.last(k, ignorenulls=True).over(w) for k in ("there", "held", "ends")}).where("side = 1")
    here = F.coalesce("there", F.lit(False))
    owner = F.when(here & (F.col("ends.until").isNull() | (micros(F.col("ts")) < F.col("ends.until"))), F.col("held.owner"))
    why = F.when(~here, "MISSING").when(owner.isNull(), "UNCLAIMED").when(owner != expected, "OTHER")
    return both.select("job", "seq", owner.alias("owner"), why.isNotNull().alias("lost"), why.alias("why"))


def flow_for_job(jobs: DataFrame, flows: DataFrame) -> DataFrame:
    """The only flow of a job's book, else why there is none. Flows are counted before the join."""
    per_book = flows.groupBy("parent_uuid").agg(F.count("*").alias("n"), F.min("uuid").alias("only"))
    found = jobs.join(per_book, jobs["book"] == per_book["parent_uuid"], "left")
    status = F.when(F.col("book").isNull(), "NO_BOOK").when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") > 1, "MULTIPLE_CHOICES").otherwise("FOUND")
    return found.select("job", status.alias("status"), F.when(F.col("n") == 1, F.col("only")).alias("flow"))


def pick_flow(jobs: DataFrame, flows: DataFrame) -> DataFrame:
    """(job, status, flow): flow_for_job() of jobs (job, book, flow_uuid): the flow that the job's details
    name counts if it is in the job's book, else it is NOT_FOUND."""
    named = jobs.where("flow_uuid IS NOT NULL").join(flows.select(F.col("uuid").alias("flow_uuid"), F.col("parent_uuid").alias("book"), F.col("uuid").alias("flow")).distinct(), ["flow_uuid", "book"], "left")
    status = F.when(F.col("book").isNull(), "NO_BOOK").when(F.col("flow").isNull(), "NOT_FOUND").otherwise("FOUND")
    return named.select("job", status.alias("status"), "flow").unionByName(flow_for_job(jobs.where("flow_uuid IS NULL"), flows))


def transition_rates(transitions: DataFrame, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Counts by state in tumbling windows; with a watermark it runs on streams as well."""
    rows = transitions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else transitions
    return rows.groupBy(F.window("ts", width), "state").agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), "state", "n")


def job_disposition(state: Column, failure: Column) -> Column:
    """consume, abandon or trash for a finished job."""
    lost = failure.isin("ExecutionFailure", "StorageFailure")
    return F.when(failure == "DispatchFailure", "trash").when((state == "SUSPENDED") | lost, "abandon").otherwise("consume")


# Exceptions after which a job is given back.
GIVEN_BACK = ["ExecutionFailure", "StorageFailure"]


def disposition(state: Column, wrapped: Column, raised: Column, dispatched: Column) -> Column:
    """consume, abandon or trash for a finished job.

    dispatched false: the dispatch itself blew up, trash. wrapped: the failures of the run, an array of
    arrays of type names, null without; all of them of the kind that gives jobs back: abandon.
    raised: type names of another exception, null without; of that kind: abandon. Without
    either, SUSPENDED is abandoned. Everything else is consumed.
    """
    back = lambda types: F.arrays_overlap(types, F.array(*map(F.lit, GIVEN_BACK)))
    return (
        F.when(~dispatched, "trash")
        .when(wrapped.isNotNull(), F.when(F.forall(wrapped, back), "abandon").otherwise("consume"))
        .when(raised.isNotNull(), F.when(back(raised), "abandon").otherwise("consume"))
        .when(state == "SUSPENDED", "abandon").otherwise("consume")
    )
