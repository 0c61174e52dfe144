"""State with event-time timers: rows wait until the watermark has passed them, and are then taken in order of time, as are deadlines.

However rows lie in files and batches, as long as none is later than the watermark allows, the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A machine's state, and what it gives out: machine(state, time, kind) -> (state, rows, deadline). kind is None at a deadline.
Machine = Callable[[tuple, int, str | None], tuple[tuple, list[tuple], int | None]]
#: Seconds until the first, second and third retry, and of a lease.
LADDER, LEASE = (300, 900, 1800), 7200


class InOrder(StatefulProcessor):
    """Gives each key's rows to a machine in order of time, when the watermark has passed them; its deadlines come in between.

    A key's state is its rows that still wait, the machine's state and its deadline. A state that is back at its start, with
    nothing that waits, is removed. Times are whole microseconds; rows of one time go by kind, and before a deadline of that time.
    """

    def __init__(self, machine: Machine, start: tuple, state: str, columns: Sequence[str]):
        self.machine, self.start, self.schema, self.row = machine, start, state, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.woken = handle, set()
        self.waiting = handle.getListState("waiting", "at array<bigint>, kind array<string>")  # an entry for each batch that had rows
        self.held = handle.getValueState("held", f"{self.schema}, deadline long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came, upto = sorted((row.at, row.kind) for row in rows), timerValues.getCurrentWatermarkInMs() * 1000
        if upto > 0:
            yield from self.advance(key, came, upto)
        else:
            self.waiting.appendValue(in_lists(came))
            self.wake(came[0][0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if key not in self.woken:
            yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)  # milliseconds; not before the instant has passed

    def advance(self, key, came: list[tuple[int, str]], upto: int) -> Iterator[Row]:
        """Takes the key's rows and deadlines up to the watermark. Its rows come before its timers, and all at one watermark, so once a batch
        is enough."""
        self.woken.add(key)
        waited = [row for some in self.waiting.get() for row in zip(*some, strict=True)]
        rows = sorted(waited + came)
        held = self.held.get()
        *state, deadline = held or (*self.start, None)
        state, out, done = tuple(state), [], 0
        while True:
            at, kind = rows[done] if done < len(rows) else (None, None)
            if deadline is not None and (at is None or deadline < at):
                at, kind = deadline, None
            elif at is not None:
                done += 1
            if at is None or at >= upto:
                done -= kind is not None
                break
            state, given, deadline = self.machine(state, at, kind)
            out += given
        if rows[done:] and not done and came:
            self.waiting.appendValue(in_lists(came))
        elif rows[done:] and done:
            self.waiting.put([in_lists(rows[done:])])
        elif not rows[done:] and waited:
            self.waiting.clear()
        if state != self.start or deadline is not None:
            if held is None or tuple(held) != (*state, deadline):
                self.held.update((*state, deadline))
        elif held is not None:
            self.held.clear()
        later = [at for at, _ in rows[done : done + 1]] + ([deadline] if deadline is not None else [])
        if later:
            self.wake(max(min(later), upto))
        yield from (self.row(*key, *row) for row in out)

    def close(self) -> None:
        pass


def in_lists(rows: list[tuple[int, str]]) -> tuple[list[int], list[str]]:
    return [at for at, _ in rows], [kind for _, kind in rows]


def in_order(stream: DataFrame, key: str, ts: str, kind: str, late: str, machine: Machine, start: tuple, state: str, result: str) -> DataFrame:
    """The rows (key, result) that a machine gives out over a stream; times in the result are columns of microseconds.

    Needs the state store that keeps timers (see run_available). The stream's rows are dropped where they are later than late.
    """
    given = stream.withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("at"), F.col(kind).alias("kind"))
    schema = T.StructType([given.schema[key], *T.StructType.fromDDL(result)])
    return given.groupBy(key).transformWithState(InOrder(machine, start, state, schema.names), schema, "Append", "EventTime")


def phase_machine(start: str, end: str) -> Machine:
    """Each row with its phase: before, within or after, by whether a start and an end have come. No deadlines."""

    def step(state: tuple, at: int, kind: str | None) -> tuple[tuple, list[tuple], int | None]:
        begun, ended = state
        begun, ended = begun or kind == start, ended or kind == end
        return (begun, ended), [(at, kind, "after" if ended else "within" if begun else "before")], None

    return step


def phases(stream: DataFrame, key: str, ts: str, kind: str, start: str, end: str, late: str) -> DataFrame:
    """The phase of each event of a key, in order of time. State is two flags for each key, and the rows that the watermark has not
    passed; a key whose flags are not set has no state but those."""
    found = in_order(stream, key, ts, kind, late, phase_machine(start, end), (False, False), "begun boolean, ended boolean", "at long, kind string, phase string")
    return found.select(key, F.timestamp_micros("at").alias(ts), F.col("kind").alias(kind), "phase")


def retry_machine(failed: str, finished: str, claimed: str, ladder: Sequence[int] = LADDER, lease: int = LEASE) -> Machine:
    """A work item's life: a failure waits for the ladder's next step and is retried when that is over, unless something came before;
    after the last step it is given up. A claim without an end is free again when its lease is over. Success forgets all.
    """

    def step(state: tuple, at: int, kind: str | None) -> tuple[tuple, list[tuple], int | None]:
        attempts, leased = state
        if kind is None:
            return (attempts, False), [(at, attempts, "lease_expired" if leased else "retry", None)], None
        if kind == finished:
            return (0, False), [(at, attempts, "done", None)] if attempts else [], None
        if kind == claimed:
            return (attempts, True), [], at + lease * 1_000_000
        if kind == failed:
            attempts += 1
            if attempts > len(ladder):
                return (attempts, False), [(at, attempts, "gave_up", None)] if attempts == len(ladder) + 1 else [], None
            due = at + ladder[attempts - 1] * 1_000_000
            return (attempts, False), [(at, attempts, "waiting", due)], due
        raise ValueError(f"no such kind of event: {kind}")

    return step


def retries(stream: DataFrame, key: str, ts: str, kind: str, failed: str, finished: str, claimed: str, late: str, ladder: Sequence[int] = LADDER, lease: int = LEASE) -> DataFrame:
    """(key, ts, attempts, action, due) over a stream of work items' events: waiting, retry, gave_up, done and lease_expired.

    An item's state is its attempts, whether it is claimed, and one deadline; success removes it.
    """
    wanted = stream.filter(F.col(kind).isin(failed, finished, claimed))
    found = in_order(wanted, key, ts, kind, late, retry_machine(failed, finished, claimed, ladder, lease), (0, False), "attempts int, leased boolean", "at long, attempts int, action string, due long")
    return found.select(key, F.timestamp_micros("at").alias(ts), "attempts", "action", F.timestamp_micros("due").alias("due"))
