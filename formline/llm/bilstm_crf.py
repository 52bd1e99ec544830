"""A character tagger: bidirectional LSTM with CRF transitions, trained in numpy by Adam on fixed windows; it reads through a graph of onnxruntime."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from formline.llm import onnx_graph as onnx

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
VOCAB = 100
BLOCK, SLACK = 768, 0.05  # rows read at once; what a run must lack of paying for its row to be left out of the search


def char_ids(code: np.ndarray) -> np.ndarray:
    """0 padding, 1..95 printable ASCII, then line ends, other letters up to Latin, and the rest."""
    out = np.full(code.shape, 98, dtype=np.int64)
    printable = (code >= 32) & (code < 127)
    out[printable] = code[printable] - 31
    out[(code == 10) | (code == 13) | (code == 9)] = 96
    out[(code >= 0xC0) & (code < 0x250)] = 97
    out[code == 0] = 0
    return out


def allowed_moves() -> np.ndarray:
    """By (tag before, tag): 0, or a large negative number where an inside tag lacks its begin."""
    moves = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        begin, inside = 1 + 2 * k, 2 + 2 * k
        moves[:, inside] = -1e4
        moves[[begin, inside], inside] = 0
    return moves


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    def __getstate__(self) -> dict:
        return {"weights": self.weights}  # the graph is compiled where it is run

    @staticmethod
    def fresh(hidden: int = 24, width: int = 12, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {"emb": rng.normal(0, 0.3, (VOCAB, width)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "out_b": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for side in "lr":
            w["x" + side] = rng.normal(0, 0.3, (width, 4 * hidden))
            w["h" + side] = rng.normal(0, 0.3, (hidden, 4 * hidden))
            w["b" + side] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def _lstm(self, side: str, emb: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states by (step, row); ``emb`` by (step, row), already turned around for the right-to-left side."""
        w = self.weights
        wh, hidden = w["h" + side], w["h" + side].shape[0]
        x = emb @ w["x" + side] + w["b" + side]
        h = c = np.zeros((emb.shape[1], hidden), dtype=np.float32)
        out = np.empty((emb.shape[0], emb.shape[1], hidden), dtype=np.float32)
        for t in range(emb.shape[0]):
            a = x[t] + h @ wh
            ifo, g = sigmoid(a[:, :3 * hidden]), np.tanh(a[:, 3 * hidden:])
            i, f, o = ifo[:, :hidden], ifo[:, hidden:2 * hidden], ifo[:, 2 * hidden:]
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, g, before, tc, h_before))
        return out

    def _lstm_back(self, side: str, emb: np.ndarray, keep: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        w = self.weights
        wh = w["h" + side]
        hidden = wh.shape[0]
        da = np.empty((*emb.shape[:2], 4 * hidden), dtype=np.float32)
        dh = dc = np.zeros((emb.shape[1], hidden), dtype=np.float32)
        g_wh = np.zeros_like(wh)
        for t in range(emb.shape[0] - 1, -1, -1):
            i, f, o, g, before, tc, h_before = keep[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            d = da[t]
            d[:, :hidden] = dc * g * i * (1 - i)
            d[:, hidden:2 * hidden] = dc * before * f * (1 - f)
            d[:, 2 * hidden:3 * hidden] = dh * tc * o * (1 - o)
            d[:, 3 * hidden:] = dc * i * (1 - g * g)
            g_wh += h_before.T @ d
            dh, dc = d @ wh.T, dc * f
        grads["h" + side] = g_wh
        grads["x" + side] = np.tensordot(emb, da, ((0, 1), (0, 1)))
        grads["b" + side] = da.sum((0, 1))
        return da @ w["x" + side].T

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores by (step, row, tag); ``ids`` by (row, step)."""
        w = self.weights
        emb = w["emb"][ids.T]
        lists = ([], []) if keep is not None else (None, None)
        left, right = self._lstm("l", emb, lists[0]), self._lstm("r", emb[::-1], lists[1])[::-1]
        both = np.concatenate([left, right], axis=2)
        if keep is not None:
            keep |= {"emb": emb, "lists": lists, "both": both}
        return both @ w["out"] + w["out_b"]

    def moves(self) -> np.ndarray:
        return self.weights["move"] + allowed_moves()

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores and the log-total of each row."""
        m = self.moves()[None]
        first = np.where(np.arange(TAGS) % 2 == 0, -1e4, 0.0)  # an inside tag opens no row
        first[0] = 0.0
        a, b = np.empty(e.shape, dtype=np.float64), np.empty(e.shape, dtype=np.float64)
        a[0] = e[0] + first
        for t in range(1, len(e)):
            s = a[t - 1][:, :, None] + m
            top = s.max(axis=1)
            a[t] = top + np.log(np.exp(s - top[:, None]).sum(axis=1)) + e[t]
        b[-1] = 0
        for t in range(len(e) - 2, -1, -1):
            s = m + (e[t + 1] + b[t + 1])[:, None, :]
            top = s.max(axis=2)
            b[t] = top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))
        top = a[-1].max(axis=1)
        return a, b, top + np.log(np.exp(a[-1] - top[:, None]).sum(axis=1))

    @cached_property
    def read(self) -> Callable[[np.ndarray], np.ndarray]:
        """Tag scores by (step, row, tag) of ``ids`` by (row, step): ``emissions`` for reading only, with the weights as they are when it is first used.
        One compiled graph: both sides step together, products of characters and weights are looked up."""
        w, hidden = self.weights, self.weights["hl"].shape[0]
        gates, third = np.array([3 * hidden, hidden], dtype=np.int64), np.array([hidden] * 3, dtype=np.int64)
        constants, step = [onnx.tensor("gates", gates), onnx.tensor("third", third), onnx.tensor("out_b", w["out_b"][:, None])], []
        for s, out in (("l", w["out"][:hidden]), ("r", w["out"][hidden:])):
            constants += [onnx.tensor("seen" + s, w["emb"] @ w["x" + s] + w["b" + s]), onnx.tensor("w" + s, w["h" + s]), onnx.tensor("out" + s, out)]
            step += [onnx.node("Gather", f"seen{s} id{s}", f"x{s}"), onnx.node("Gemm", f"h{s} w{s} x{s}", f"a{s}"),
                     onnx.node("Split", f"a{s} gates", f"ifo{s} g{s}", axis=1), onnx.node("Sigmoid", f"ifo{s}", f"open{s}"), onnx.node("Tanh", f"g{s}", f"tg{s}"),
                     onnx.node("Split", f"open{s} third", f"i{s} f{s} o{s}", axis=1), onnx.node("Mul", f"f{s} c{s}", f"fc{s}"), onnx.node("Mul", f"i{s} tg{s}", f"ig{s}"),
                     onnx.node("Add", f"fc{s} ig{s}", f"cn{s}"), onnx.node("Tanh", f"cn{s}", f"tc{s}"), onnx.node("Mul", f"o{s} tc{s}", f"hn{s}"),
                     onnx.node("Gemm", f"out{s} hn{s}", f"en{s}", transA=1, transB=1)]
        states = ("hl", "cl", "hr", "cr")
        body = onnx.graph("step", step, [onnx.value(x, onnx.FLOAT, "n", hidden) for x in states] + [onnx.value("id" + s, onnx.INT32, "n") for s in "lr"],
                          [onnx.value(x[0] + "n" + x[1], onnx.FLOAT, "n", hidden) for x in states] + [onnx.value("en" + s, onnx.FLOAT, TAGS, "n") for s in "lr"])
        turned = [0, 1]  # the right-to-left side reads and writes from the end
        nodes = [onnx.node("Scan", "zero zero zero zero ids ids", "hl_ cl_ hr_ cr_ el er", body=body, num_scan_inputs=2, scan_input_directions=turned, scan_output_directions=turned),
                 onnx.node("Add", "el er", "both"), onnx.node("Add", "both out_b", "e")]
        run = onnx.runner(onnx.graph("tagger", nodes, [onnx.value("ids", onnx.INT32, "t", "n"), onnx.value("zero", onnx.FLOAT, "n", hidden)],
                                     [onnx.value("e", onnx.FLOAT, "t", TAGS, "n")], constants))
        return lambda ids: run({"ids": np.ascontiguousarray(ids.T.astype(np.int32)), "zero": np.zeros((len(ids), hidden), dtype=np.float32)})[0].transpose(0, 2, 1)

    def plainly_outside(self, e: np.ndarray) -> np.ndarray:
        """Rows whose best tags are certainly all outside: no run of other tags, wherever it opens and closes, gains over staying outside.
        A run may go on from any tag to any begin at the best such move, so the gain is not put too low but for rounding in single precision, which
        SLACK covers: gains are tens at most where a row is near its limit, so some hundred steps round by less than a hundredth."""
        m = (self.moves() - self.moves()[0, 0]).astype(np.float32)
        begins, insides = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        enter, leave, again = m[0, begins][:, None], max(np.float32(0), m[1:, 0].max()), m[1:, begins].max()
        after_begin, after_inside = m[begins, insides][:, None], m[insides, insides][:, None]
        scores = e.transpose(0, 2, 1)  # as the graph wrote them
        run = np.full((TAGS - 1, e.shape[1]), -np.inf, dtype=np.float32)
        best, most = run[0].copy(), run[0].copy()
        for t, gain in enumerate(scores[:, 1:] - scores[:, :1]):
            inside = np.maximum(run[0::2] + after_begin, run[1::2] + after_inside)
            run[0::2] = np.maximum(enter, best + again) if t else 0.0  # a row opens without a move
            run[1::2] = inside
            run += gain
            np.max(run, axis=0, out=best)
            np.maximum(most, best, out=most)
        return most + leave < -SLACK

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags and their marginal probabilities by (row, step); rows that are plainly outside get probability one."""
        tags, sure = np.zeros(ids.shape, dtype=np.int64), np.ones(ids.shape)
        rows, scores = [], []
        for at in range(0, len(ids), BLOCK):
            e = self.read(ids[at:at + BLOCK])
            open_ = np.flatnonzero(~self.plainly_outside(e))
            rows.append(at + open_)
            scores.append(e[:, open_])
        if rows:
            open_, e = np.concatenate(rows), np.concatenate(scores, axis=1)
            for at in range(0, len(open_), BLOCK):
                some = open_[at:at + BLOCK]
                tags[some], sure[some] = self.best(e[:, at:at + BLOCK])
        return tags, sure

    def best(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags and their marginal probabilities by (row, step) from scores by (step, row, tag)."""
        m = self.moves()[None]
        a, b, z = self.marginals(e)
        v = e[0] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0.0)
        back = np.zeros(e.shape, dtype=np.int8)
        for t in range(1, len(e)):
            s = v[:, :, None] + m
            back[t] = s.argmax(axis=1)
            v = s.max(axis=1) + e[t]
        tags = np.empty((e.shape[1], e.shape[0]), dtype=np.int64)
        rows = np.arange(e.shape[1])
        tags[:, -1] = v.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        sure = np.exp(np.take_along_axis((a + b - z[None, :, None]).transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0])
        return tags, sure

    def loss_and_grads(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, keep, grads = self.weights, {}, {}
        e = self.emissions(ids, keep).astype(np.float64)
        m = self.moves()
        a, b, z = self.marginals(e)
        n, steps = ids.shape
        y = tags.T
        gold = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(axis=0) + m[y[:-1], y[1:]].sum(axis=0)
        d_e = np.exp(a + b - z[None, :, None])
        pairs = np.exp(a[:-1, :, :, None] + m + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        d_e[np.arange(steps)[:, None], np.arange(n)[None], y] -= 1
        d_e = (d_e / n).astype(np.float32)
        grads["move"] = pairs / n
        grads["out"] = np.tensordot(keep["both"], d_e, ((0, 1), (0, 1)))
        grads["out_b"] = d_e.sum((0, 1))
        d_both = d_e @ w["out"].T
        hidden = w["hl"].shape[0]
        d_emb = self._lstm_back("l", keep["emb"], keep["lists"][0], d_both[:, :, :hidden], grads)
        d_emb = d_emb + self._lstm_back("r", keep["emb"][::-1], keep["lists"][1], d_both[::-1, :, hidden:], grads)[::-1]
        grads["emb"] = np.zeros_like(w["emb"])
        np.add.at(grads["emb"], ids.T, d_emb)
        return float((z - gold).mean()), grads


def train(ids: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Tagger:
    """Fits a tagger on windows by (row, step); gradients are clipped to norm 5."""
    model, rng = Tagger.fresh(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, steps + 1 if len(ids) else 1):
        at = rng.choice(len(ids), size=min(batch, len(ids)), replace=False)
        _, grads = model.loss_and_grads(ids[at], tags[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            pace = rate * (1 - 0.9 * step / steps)
            model.weights[k] = (model.weights[k] - pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model
