from formline.streaming.processors import DayBarrier


class Store:
    """State handle in memory that counts what is written."""

    def __init__(self):
        self.rows, self.value, self.timers, self.written = [], None, [], 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        store = self

        class Value:
            exists, get = staticmethod(lambda: store.value is not None), staticmethod(lambda: store.value)

            def update(self, v):
                store.value = v

        return Value()

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def appendList(self, rows):
        self.written += len(rows)
        self.rows += rows

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


class Mark:
    def __init__(self, day):
        self.day = day

    def getCurrentWatermarkInMs(self):
        return self.day * DayBarrier.DAY_MS


def test_waiting_rows_share_blocks_and_days_see_the_state_before_them():
    import pandas as pd

    store, barrier = Store(), DayBarrier()
    barrier.init(store)
    rows = pd.DataFrame({"day": [d for d in range(10) for _ in range(300)], "match_id": range(3_000), "venue": ["H", None, "A"] * 1_000, "points": [3, 0, 1] * 1_000})
    end = pd.DataFrame({"day": [12], "match_id": [None], "venue": [None], "points": [None]})
    assert list(barrier.handleInputRows((7,), iter([rows.sample(frac=1, random_state=1), end]), None)) == []
    assert store.written == 1 and store.timers == [DayBarrier.DAY_MS]  # one block, not 3,000 state entries
    seen = []
    for mark in (0, 4, 4, 11):
        seen += [r for part in barrier.handleExpiredTimer((7,), Mark(mark), None) for r in part.itertuples(index=False)]
        assert len(seen) == min(mark, 10) * 300
    for r in seen:
        day = r.match_id // 300
        assert (r.ent, r.games, r.points) == (7, day * 300, day * 400)
    assert not store.rows and store.value == (3_000, 4_000) and store.timers[1:] == [DayBarrier.DAY_MS, 5 * DayBarrier.DAY_MS, 5 * DayBarrier.DAY_MS]
