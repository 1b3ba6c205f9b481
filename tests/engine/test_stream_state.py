"""A streamed document is one value of state, read and written once a batch."""

from collections import Counter

import pandas as pd

from cuadra.streaming.blocks import _Fold


class _State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def exists(self):
        self.calls["exists"] += 1
        return self.value is not None

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    put = update

    def clear(self):
        self.calls["clear"] += 1


class _Handle:
    def __init__(self):
        self.calls = Counter()

    def getValueState(self, *_):
        return _State(self.calls)

    getListState = getValueState


def test_two_calls_of_state_a_batch_and_no_rows_of_what_is_open():
    fold, handle = _Fold(0, None, None), _Handle()
    fold.init(handle)
    lines = lambda *rows: iter([pd.DataFrame(rows, columns=["pos", "label", "amount", "terminal"]).assign(lines=5)])
    assert [len(d) for d in fold.handleInputRows(("d",), lines((1, "A", 2.0, False), (2, None, 1.0, True)), None) if len(d)] == []
    assert handle.calls == {"get": 1, "update": 1}
    (got,) = fold.handleInputRows(("d",), lines((4, "R", 3.0, True), (3, "A", 5.0, False), (1, "A", 9.0, False)), None)
    assert [tuple(None if x is pd.NA else x for x in r) for r in got.itertuples(index=False, name=None)] == [("d", 0, "A", 5.0), ("d", 0, "R", 3.0), ("d", None, "A", 9.0)]
    assert handle.calls == {"get": 2, "update": 2}
