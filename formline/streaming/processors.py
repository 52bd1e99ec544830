"""Keyed state for the streaming twins. One instance handles one key at a time; rows of a micro-batch
are put in (t, id) order, and state is read and written once per touched entry.

The order also holds across micro-batches: each key keeps the place (t, id) it has reached, and a row of an earlier place that
comes later is marked ``late``, gets no answer (nulls) and changes nothing."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from formline.operators.ratings import INIT, K, SCALE


def ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "match_id"], kind="stable", ignore_index=True)


class Place:
    """The last (t, id) of a key in its state."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("place", "t long, id long")

    def late(self, games: pd.DataFrame) -> int:
        """How many of the ordered rows stand before the place (they come first); moves the place to the last row."""
        places = list(zip(games["ts"].astype("datetime64[ns]").astype("int64").tolist(), games["match_id"].astype("int64").tolist()))
        reached = tuple(self.state.get()) if self.state.exists() else None
        n = 0 if reached is None else bisect_left(places, reached)
        if n < len(places):
            self.state.update(places[-1])
        return n


class EloState(StatefulProcessor):
    """Key: pool. State: entity -> rating. Emits the ratings before each game."""

    OUT = "pool long, match_id long, home_elo double, away_elo double, late boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "ent long", "elo double")
        self.place = Place(handle)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for ent, elo in zip(initialState["ent"], initialState["elo"]):
            self.ratings.updateValue((int(ent),), (float(elo),))

    def handleInputRows(self, key, rows, timerValues):
        games = ordered(rows)
        late = self.place.late(games)
        seen: dict[int, float] = {}

        def get(ent: int) -> float:
            if ent not in seen:
                seen[ent] = self.ratings.getValue((ent,))[0] if self.ratings.containsKey((ent,)) else INIT
            return seen[ent]

        before = [(None, None)] * late
        played = games.iloc[late:]
        for h, a, s in zip(played["home"].astype(int), played["away"].astype(int), played["score"]):
            rh, ra = get(h), get(a)
            before.append((rh, ra))
            if s is None or s != s:  # no result yet: answered, and nothing changes
                continue
            expected = 1.0 / (1.0 + 10.0 ** ((ra - rh) / SCALE))
            seen[h] = rh + K * (s - expected)
            seen[a] = ra + K * ((1.0 - s) - (1.0 - expected))
        for ent, elo in seen.items():
            self.ratings.updateValue((ent,), (float(elo),))
        home, away = (pd.Series([b[i] for b in before], dtype="float64") for i in (0, 1))
        yield pd.DataFrame({"pool": key[0], "match_id": games["match_id"], "home_elo": home, "away_elo": away, "late": games.index < late})

    def close(self) -> None:
        pass


class LastN(StatefulProcessor):
    """Key: entity. State: the last ``n`` values; a missing value leaves the list untouched."""

    OUT = "ent long, match_id long, venue string, mean double, n int, late boolean"

    def __init__(self, n: int = 5) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "items array<double>")
        self.place = Place(handle)

    def handleInputRows(self, key, rows, timerValues):
        games = ordered(rows)
        late = self.place.late(games)
        items = [float(x) for x in self.last.get()[0]] if self.last.exists() else []
        means, sizes = [None] * late, [None] * late
        for x in games["value"].iloc[late:]:
            means.append(sum(items) / len(items) if items else None)
            sizes.append(len(items))
            if x is not None and x == x:
                items = (items + [float(x)])[-self.n:]
        self.last.update((items,))
        yield pd.DataFrame({"ent": key[0], "match_id": games["match_id"], "venue": games["venue"],
                            "mean": pd.Series(means, dtype="float64"), "n": pd.Series(sizes, dtype="Int32"), "late": games.index < late})

    def close(self) -> None:
        pass


class PairCount(StatefulProcessor):
    """Key: unordered pair. State: wins of each side, draws, games. Emits the counts before each meeting."""

    OUT = "lo long, hi long, match_id long, lo_wins long, hi_wins long, draws long, games long, late boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "lo_wins long, hi_wins long, draws long, games long")
        self.place = Place(handle)

    def handleInputRows(self, key, rows, timerValues):
        games = ordered(rows)
        late = self.place.late(games)
        c = [int(v) for v in self.counts.get()] if self.counts.exists() else [0, 0, 0, 0]
        out = [(None,) * 4] * late
        for home, result in zip(games["home"].iloc[late:], games["result"].iloc[late:]):
            out.append(tuple(c))
            if result not in ("H", "D", "A"):  # answered, but no meeting yet
                continue
            if result == "D":
                c[2] += 1
            else:
                lo_won = (result == "H") == (home == key[0])
                c[0 if lo_won else 1] += 1
            c[3] += 1
        self.counts.update(tuple(c))
        counts = pd.DataFrame(out, columns=["lo_wins", "hi_wins", "draws", "games"], dtype="Int64")
        yield pd.concat([pd.DataFrame({"lo": key[0], "hi": key[1], "match_id": games["match_id"]}), counts], axis=1).assign(late=games.index < late)

    def close(self) -> None:
        pass


class Carrying(StatefulProcessor):
    """Another processor's results beside the rows they belong to, so that operators can follow each other."""

    def __init__(self, inner: StatefulProcessor, new: list[str], kept: list[str]) -> None:
        self.inner, self.new, self.kept = inner, new, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        games = ordered(rows)
        for out in self.inner.handleInputRows(key, iter([games]), timerValues):
            yield pd.concat([games[self.kept], out[self.new]], axis=1)

    def close(self) -> None:
        self.inner.close()


class BucketLast(StatefulProcessor):
    """``LastN`` for a bucket of entities at once: key, the bucket; state, by entity its last values and the place it has reached."""

    NEW = ["mean", "n"]
    NO_ENT = np.iinfo(np.int64).min  # a null entity is one of its own

    def __init__(self, n: int, kept: list[str]) -> None:
        self.n, self.kept = n, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "ent long", "items array<double>, t long, id long")

    def means(self, items: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean (null without any) and number of the last ``n`` items at most, for each count of the items that stand before a row."""
        size = np.minimum(before, self.n)
        total = np.zeros(len(before))
        for j in range(self.n if len(items) else 0):  # oldest first
            total += np.where(j < size, items[np.minimum(before - size + j, len(items) - 1)], 0.0)
        return np.divide(total, size, out=np.full(len(before), np.nan), where=size > 0), size

    def handleInputRows(self, key, rows, timerValues):
        sides = ordered(rows)
        ents = sides["ent"].fillna(self.NO_ENT).to_numpy().astype("int64")
        by_ent = np.argsort(ents, kind="stable")  # each entity's rows stay in order
        sides, ents = sides.iloc[by_ent].reset_index(drop=True), ents[by_ent]
        times, ids, values = sides["ts"].astype("datetime64[ns]").astype("int64").to_numpy(), sides["match_id"].to_numpy().astype("int64"), sides["value"].to_numpy().astype("float64")
        mean, n, late = np.empty(len(sides)), np.empty(len(sides), "int64"), np.zeros(len(sides), bool)
        first = np.flatnonzero(np.r_[True, ents[1:] != ents[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ents)]):
            ent = (int(ents[a]),)
            held, t, i = self.last.getValue(ent) if self.last.containsKey(ent) else ([], None, None)
            if t is not None:
                late[a:b] = (times[a:b] < t) | ((times[a:b] == t) & (ids[a:b] < i))
            counts = ~late[a:b] & ~np.isnan(values[a:b])
            items = np.r_[np.array(held, "float64"), values[a:b][counts]]
            mean[a:b], n[a:b] = self.means(items, len(held) + np.cumsum(counts) - counts)
            if not late[b - 1]:
                self.last.updateValue(ent, (items[-self.n:].tolist(), int(times[b - 1]), int(ids[b - 1])))
        mean[late] = np.nan
        yield sides[self.kept].assign(mean=mean, n=pd.Series(n, dtype="Int32").mask(late))

    def close(self) -> None:
        pass


class BothSides(StatefulProcessor):
    """Key: bucket of games. Holds the side of a game that came first until the other one comes, then gives one row with both means."""

    def __init__(self, kept: list[str]) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "match_id long", "venue string, mean double")

    def handleInputRows(self, key, rows, timerValues):
        sides = ordered(rows)
        means = {v: sides[sides["venue"] == v].drop_duplicates("match_id", keep="last").set_index("match_id")["mean"] for v in ("H", "A")}
        games = sides.drop_duplicates("match_id", ignore_index=True)
        got = pd.DataFrame({v: games["match_id"].map(m).astype("float64") for v, m in means.items()})
        came = pd.DataFrame({v: games["match_id"].isin(m.index) for v, m in means.items()})
        whole = came["H"] & came["A"]  # the usual case: both came at once, and no state is touched
        for i in games.index[~whole]:
            game, own = (int(games["match_id"][i]),), "H" if came["H"][i] else "A"
            if not self.held.containsKey(game):
                mean = got[own][i]
                self.held.updateValue(game, (own, None if mean != mean else float(mean)))
                continue
            venue, mean = self.held.getValue(game)
            if venue != own:
                got.loc[i, venue], whole[i] = float("nan") if mean is None else mean, True
                self.held.removeKey(game)
        if whole.any():
            yield games.loc[whole, self.kept].assign(home_mean=got["H"][whole], away_mean=got["A"][whole]).reset_index(drop=True)

    def close(self) -> None:
        pass


class BucketPairs(StatefulProcessor):
    """``PairCount`` for a bucket of pairs at once: key, the bucket; state, by pair its counts and the place it has reached."""

    NEW = ["lo_wins", "hi_wins", "draws", "games"]

    def __init__(self, kept: list[str]) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "lo long, hi long", "lo_wins long, hi_wins long, draws long, games long, t long, id long")

    def handleInputRows(self, key, rows, timerValues):
        games = ordered(rows)
        times, ids = games["ts"].astype("datetime64[ns]").astype("int64").tolist(), games["match_id"].astype("int64").tolist()
        opened: dict[tuple, tuple | None] = {}  # the place each pair had reached before this batch
        state: dict[tuple, list] = {}  # counts, then the place reached
        moved, out = set(), []
        for lo, hi, home, result, *place in zip(games["lo"].tolist(), games["hi"].tolist(), games["home"].tolist(), games["result"].tolist(), times, ids):
            pair = (lo, hi)
            if pair not in opened:
                held = [int(v) for v in self.counts.getValue(pair)] if self.counts.containsKey(pair) else None
                opened[pair], state[pair] = (None, [0] * 6) if held is None else (tuple(held[4:]), held)
            c = state[pair]
            if opened[pair] is not None and tuple(place) < opened[pair]:  # late
                out.append((None,) * 4)
                continue
            out.append(tuple(c[:4]))
            c[4:] = place
            moved.add(pair)
            if result not in ("H", "D", "A"):  # answered, but no meeting yet
                continue
            c[2 if result == "D" else 0 if (result == "H") == (home == lo) else 1] += 1
            c[3] += 1
        for pair in moved:
            self.counts.updateValue(pair, tuple(state[pair]))
        yield pd.concat([games[self.kept], pd.DataFrame(out, columns=self.NEW, dtype="Int64")], axis=1)

    def close(self) -> None:
        pass


class DayBarrier(StatefulProcessor):
    """Key: entity. Rows wait until the watermark passes the end of their day; the whole day is then
    answered from the state before it, and only afterwards folded into the state.

    Waiting rows are kept as Arrow blocks of up to ``BLOCK`` rows, so a row costs no call of the state store of its own."""

    OUT = "ent long, match_id long, venue string, games long, points long"
    DAY_MS = 86_400_000
    BLOCK = 100_000
    ROW = pa.schema([("day", pa.int64()), ("match_id", pa.int64()), ("venue", pa.string()), ("points", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.total = handle.getValueState("total", "games long, points long")

    def blocks(self, rows: pa.Table) -> list[tuple[bytes]]:
        out = []
        for at in range(0, rows.num_rows, self.BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.ROW) as writer:
                writer.write_table(rows.slice(at, self.BLOCK))
            out.append((sink.getvalue().to_pybytes(),))
        return out

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["match_id"].notna()]  # the end of the log only moves the watermark
        if batch.empty:
            return iter([])
        named = batch[self.ROW.names].astype({"day": "int64", "match_id": "int64", "points": "int64"})
        self.waiting.appendList(self.blocks(pa.Table.from_pandas(named, self.ROW, preserve_index=False)))
        # One timer for the earliest open day is enough: its firing arms the next one.
        self.handle.registerTimer((int(named["day"].min()) + 1) * self.DAY_MS)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # One firing settles every day the watermark has closed.
        if not self.waiting.exists():
            return
        end = timerValues.getCurrentWatermarkInMs() // self.DAY_MS
        rows = pa.concat_tables(pa.ipc.open_stream(bytes(r[0])).read_all() for r in self.waiting.get())
        is_open = pc.greater_equal(rows["day"], end)
        rest, done = rows.filter(is_open), rows.filter(pc.invert(is_open))
        if rest.num_rows:
            self.handle.registerTimer((pc.min(rest["day"]).as_py() + 1) * self.DAY_MS)
        if not done.num_rows:
            return
        games, points = (int(v) for v in self.total.get()) if self.total.exists() else (0, 0)
        done = done.sort_by([("day", "ascending"), ("match_id", "ascending"), ("venue", "ascending")])
        first = np.unique(done["day"].to_numpy(), return_index=True)[1]
        each = np.diff([*first, done.num_rows])
        won = np.add.reduceat(done["points"].to_numpy(), first)
        before = [np.repeat(held + np.cumsum(n) - n, each) for held, n in ((games, each), (points, won))]
        self.waiting.clear()
        if rest.num_rows:
            self.waiting.appendList(self.blocks(rest))
        self.total.update((games + int(each.sum()), points + int(won.sum())))
        yield pd.DataFrame({"ent": key[0], "match_id": done["match_id"].to_numpy(), "venue": done["venue"].to_pandas(), "games": before[0], "points": before[1]})

    def close(self) -> None:
        pass
