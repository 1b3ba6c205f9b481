"""Blocks folded from a stream of lines: lines are put in order, blocks keep their numbers, documents that pause go on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

LINES = ["pos", "label", "amount", "terminal"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_blocks(lines: DataFrame, timeout: str | None = None, slack: int = 0, forget: str = "30 days") -> DataFrame:
    """Blocks of a stream of lines (doc, pos, label, amount, terminal, and lines, how many the document has, null where unknown): rows
    doc, block, label, amount.

    Lines go by ``pos``, whatever the batches they come in, as long as fewer than ``slack`` + 1 lines of the document overtake one:
    that many are held back, until all ``lines`` have come or, where a ``timeout`` is given, none has for so long. A terminal line closes its block, which then
    gives a row for each label with its last positive amount; lines without a label or a positive amount don't count, and a block
    that isn't closed gives none. A line that comes after later ones were folded, or twice, is given back as it is, with a null block.
    Numbers and open blocks go on after a timeout. With a timeout, batches without lines run too, so an ``availableNow`` stream
    wouldn't end, and a document is forgotten ``forget`` after its last change; without one it is kept.

    State is at most ``slack`` lines and one open block for each document. The session's state store is set to RocksDB, which timers
    and lists of state need.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000) if timeout else None
    kept = lines.select("doc", *LINES, "lines") if "lines" in lines.columns else lines.selectExpr("doc", *LINES, "cast(null as long) as lines")
    return kept.groupBy("doc").transformWithStateInPandas(_Fold(slack, ms(timeout), ms(forget)), "doc string, block long, label string, amount double", "Append", "ProcessingTime" if timeout else "None")


class _Fold(StatefulProcessor):
    def __init__(self, slack: int, timeout: int | None, forget: int | None):
        self.slack, self.timeout, self.forget = slack, timeout, forget

    def init(self, handle) -> None:
        self.handle = handle
        # One value has all of a document, as each call of a state costs more than what it brings.
        self.state = handle.getValueState("document", "block long, seen long, last long, timer long, held array<struct<pos:long,label:string,amount:double,terminal:boolean>>, open array<struct<label:string,amount:double>>", self.forget)

    def _known(self) -> tuple:
        return self.state.get() or (0, 0, None, None, [], [])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block, seen, last, timer, held, opened = self._known()
        fresh, late, total = [], [], None
        for part in rows:
            lines = list(zip(*[part[c].tolist() for c in LINES], strict=True))
            late += [x for x in lines if last is not None and x[0] <= last]
            fresh += lines if last is None else [x for x in lines if not x[0] <= last]
            known = part["lines"].max()
            total = known if pd.notna(known) and (total is None or known > total) else total
        seen += len(fresh)
        done = total is not None and seen >= total
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if done or self.timeout is None else timerValues.getCurrentProcessingTimeInMs() + self.timeout
        if timer is not None:
            self.handle.registerTimer(timer)
        yield from self._fold(key, fresh, 0 if done else self.slack, block, seen, last, timer, held, opened, [(None, label, amount) for _, label, amount, _ in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block, seen, last, _, held, opened = self._known()
        yield from self._fold(key, [], 0, block, seen, last, None, held, opened, [])

    def _fold(self, key, fresh: list[tuple], slack: int, block: int, seen: int, last: int | None, timer: int | None, held: list, opened: list, late: list[tuple]) -> Iterator[pd.DataFrame]:
        waiting = [*map(tuple, held), *fresh]
        waiting.sort(key=lambda x: (x[0], x[1] or "", x[2] if x[2] == x[2] and x[2] is not None else 0.0, bool(x[3])))
        at = max(0, len(waiting) - slack)
        ready, waiting = waiting[:at], waiting[at:]
        block_of, closed = dict(map(tuple, opened)), []
        for _, label, amount, terminal in ready:
            if label is not None and amount is not None and amount > 0:
                block_of[label] = float(amount)
                if terminal:
                    closed += [(block, k, v) for k, v in block_of.items()]
                    block, block_of = block + 1, {}
        kept = [(int(p), label, None if a is None or a != a else float(a), None if t is None else bool(t)) for p, label, a, t in waiting]
        self.state.update((block, seen, int(ready[-1][0]) if ready else last, timer, kept, list(block_of.items())))
        if found := closed + late:
            blocks, labels, amounts = zip(*found, strict=True)
            yield pd.DataFrame({"doc": key[0], "block": pd.array(blocks, "Int64"), "label": labels, "amount": amounts})

    def close(self) -> None:
        pass
