"""Personal data in texts: exact base patterns, and spans that a character tagger adds.

The tagger (bidirectional LSTM with CRF transitions, in numpy) learns what the patterns miss: from the base spans of a
bounded sample, and from the same spans as people disguise or mistype them (``disguised``: a spelled-out at sign, spaced
or bracketed dots, digits in dotted groups, a phone number without its plus), each in its own surroundings. Plain digits
that fail the base rules stay outside. The sample is ``sample_rows`` rows expected (chosen by a hash of the text), of
their windows the ``windows`` with the smallest hash.
It learns from windows of WIDTH characters, one each STRIDE: all that hold a digit, ``@``, a bracketed ``at`` or the word ``dot``,
and one in PLAIN of the others. It reads every text whole, whatever it holds, in even windows of READ characters at most, of which
neighbours share LAP or more. Globally a character takes its tag from the window in which it stands most centrally; runs of a kind are the spans. A tagger's span is added if each
of its characters has a marginal of at least ``sure``, it has MIN_ADDED characters, overlaps no base span and is ``sound``:
its digits keep the rules of its kind (Luhn, parts up to 255, 10 to 15 digits), an address reads as one with its signs put back.

Defined results: a null or empty text has no spans; ids may be null or repeated (one result row for each input row); an
empty table gives no rows; without any base span in the sample nothing is added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.bilstm_crf import KINDS, Tagger, char_ids, train
from formline.llm.common import id_text, query, slices, table

WIDTH, STRIDE, PLAIN, MIN_ADDED = 96, 48, 32, 6
READ, LAP, ROWS = 480, 48, 16384  # characters of a window that is read, those it shares with the next, windows decoded at once
WAYS, SURE = 4, 0.5  # disguises shown of each base span; least marginal of an added span's characters
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({]at[\])}]|\bdot\b", re.IGNORECASE)
BASE = re.compile("[0-9@]")
DIGITS = re.compile(r"[^0-9]")
AT_SIGN = re.compile(r" ?[\[({](?:at|@)[\])}] ?| at | @ |@", re.IGNORECASE)
DOT_SIGN = re.compile(r" ?[\[({](?:dot|\.)[\])}] ?| dot | \. |\.", re.IGNORECASE)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Ways to write a sign otherwise; (at, dot) of an address, the dot of an ip, the gap between groups of digits.
SIGNS = ((" at ", " dot "), (" at ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", "."), ("{at}", "."))
DOTS, GAPS, PHONE_GAPS = (" . ", "[.]", " dot ", "(.)"), (".", "/", "  ", " - "), (" ", "-", ".", "/")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in one pass: an ``@`` can only end the run of local characters before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    if not BASE.search(text):
        return []
    spans = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for kind, pattern, least, most in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = DIGITS.sub("", m[0])
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def disguised(span: str, kind: int, rng: np.random.Generator) -> str:
    """A base span as the patterns miss it; digits of numbers are drawn anew."""
    def pick(ways):
        return ways[int(rng.integers(len(ways)))]

    if kind == 0:
        local, domain = span.rsplit("@", 1)
        at, dot = pick(SIGNS)
        return local + at + dot.join(domain.split("."))
    if kind == 1:
        return pick(DOTS).join(str(int(x)) for x in rng.integers(0, 256, size=4))
    digits = "".join(map(str, rng.integers(0, 10, size=len(DIGITS.sub("", span)))))
    if kind == 2:
        return pick(GAPS).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    local, gap = digits[-10:], pick(PHONE_GAPS)
    area = pick((f"({local[:3]}) ", local[:3] + gap))
    return pick(("", "00 " + digits[:-10] + gap, digits[:-10] + gap)) + area + local[3:6] + gap + local[6:]


def sound(span: str, kind: int) -> bool:
    """Whether a span that the tagger found keeps the rules of its kind."""
    if kind == 0:
        return ADDRESS.fullmatch(DOT_SIGN.sub(".", AT_SIGN.sub("@", span))) is not None
    digits = DIGITS.sub("", span)
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15 and len(digits) < len(span)


def lessons(text: str) -> Iterator[tuple[str, list[Span]]]:
    """The text with its base spans, then a stretch around each base span with that span disguised, some ways each."""
    base = base_spans(text)
    yield text, base
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for a, kind, b in base:
        for _ in range(WAYS):
            left, right = text[max(0, a - int(rng.integers(WIDTH))):a], text[b:b + int(rng.integers(WIDTH))]
            new = disguised(text[a:b], kind, rng)
            whole, at = left + new + right, len(left)
            old = base_spans(whole)
            if all(y <= at or at + len(new) <= x for x, _, y in old):  # else the patterns find a part of it
                yield whole, sorted([*old, (at, kind, at + len(new))])


def characters(text: str) -> np.ndarray:
    return char_ids(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)).astype(np.uint8)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows to learn from, and their character ids."""
    code = characters(text)
    starts = np.arange(max(1, -(-len(code) // STRIDE) - 1)) * STRIDE  # the last window reaches the end
    padded = np.concatenate([code, np.zeros(WIDTH + STRIDE, dtype=np.uint8)])
    return starts, padded[starts[:, None] + np.arange(WIDTH)]


def cut_evenly(length: int) -> tuple[np.ndarray, int]:
    """Starts and width of the windows in which a text of ``length`` characters is read: all of it, the last one up to its end."""
    n = max(1, -(-(length - LAP) // (READ - LAP)))
    width = -(-(length + (n - 1) * LAP) // n)
    return np.minimum(np.arange(n) * (width - LAP), length - width), width


def gold_tags(length: int, spans: list[Span]) -> np.ndarray:
    """Tags of the characters; where kinds overlap, the one that starts first and listed first stays."""
    tags = np.zeros(length + WIDTH, dtype=np.int64)
    for a, kind, b in spans:
        if not tags[a:b].any():
            tags[a] = 1 + 2 * kind
            tags[a + 1:b] = 2 + 2 * kind
    return tags


def fit(docs: DataFrame, sample_rows: int = 8000, windows: int = 4096) -> Tagger:
    rows = docs.select(F.col("text")).filter(F.col("text").isNotNull())
    share = min(1.0, sample_rows / max(rows.count(), 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            found = []
            for text in batch.column("text").to_pylist():
                for shown, spans in lessons(text):
                    starts, ids = windows_of(shown)
                    hit = np.unique([m.start() // STRIDE for m in TRIGGER.finditer(shown)]).astype(np.int64)
                    learned = np.array([zlib.crc32(row.tobytes()) % PLAIN == 0 for row in ids])
                    learned[np.intersect1d(np.concatenate([hit, hit - 1]), np.arange(len(ids)))] = True
                    starts, ids = starts[learned], ids[learned]
                    tags = gold_tags(len(shown), spans)
                    for s, row in zip(starts, ids):
                        mine = tags[s:s + WIDTH].copy()
                        n = 0
                        while n < WIDTH and mine[n] and mine[n] % 2 == 0:  # a span cut by the window opens there
                            n += 1
                        if n:
                            mine[0] -= 1
                        found.append(row.tobytes() + mine.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["pair"])

    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = sample.mapInArrow(cut, "pair binary").orderBy(F.xxhash64("pair"), "pair").limit(windows).collect()
    pairs = np.array([np.frombuffer(bytes(r.pair), dtype=np.uint8) for r in picked], dtype=np.int64).reshape(-1, 2 * WIDTH)
    return train(pairs[:, :WIDTH], pairs[:, WIDTH:])


def stitched(windows: list[tuple[int, np.ndarray, np.ndarray]], starts: np.ndarray, width: int) -> list[tuple[Span, float]]:
    """Spans of one text from those of its decoded windows (number, tags, marginals) that hold any, with the least marginal of their characters."""
    spans: list[tuple[Span, float]] = []
    open_: list | None = None  # start, kind, end, least
    for w, row, prob in windows:
        s = int(starts[w])
        low = 0 if w == 0 else (s + int(starts[w - 1]) + width) // 2  # the middle of what two windows share
        high = s + width if w == len(starts) - 1 else (int(starts[w + 1]) + s + width) // 2
        for i in np.flatnonzero(row[low - s:high - s]) + low:
            tag = int(row[i - s])
            kind = (tag - 1) // 2
            if open_ and open_[2] == i and open_[1] == kind and tag % 2 == 0:
                open_[2], open_[3] = int(i) + 1, min(open_[3], prob[i - s])
            else:
                if open_:
                    spans.append(((open_[0], open_[1], open_[2]), open_[3]))
                open_ = [int(i), kind, int(i) + 1, prob[i - s]]
    if open_:
        spans.append(((open_[0], open_[1], open_[2]), open_[3]))
    return spans


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]], sure: float) -> list[list[Span]]:
    codes = [characters(t) for t in texts]
    cuts = [cut_evenly(len(c)) for c in codes]
    order = sorted(((width, i, w) for i, (starts, width) in enumerate(cuts) if width for w in range(len(starts))))  # windows of like width are read together
    tagged: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for at in range(0, len(order), ROWS):
        some = order[at:at + ROWS]
        ids = np.zeros((len(some), some[-1][0]), dtype=np.uint8)
        for row, (width, i, w) in zip(ids, some):
            start = cuts[i][0][w]
            row[:width] = codes[i][start:start + width]
        tags, prob = model.decode(ids)
        for r in np.flatnonzero(tags.any(axis=1)):
            width, i, w = some[r]
            tagged[i].append((w, tags[r, :width], prob[r, :width]))
    out: list[list[Span]] = [[] for _ in texts]
    for i, (text, found) in enumerate(zip(texts, tagged)):
        for (a, kind, b), least in stitched(sorted(found, key=lambda x: x[0]), *cuts[i]):
            if least >= sure and b - a >= MIN_ADDED and sound(text[a:b], kind) and not any(x < b and a < y for x, _, y in base[i]):
                out[i].append((a, kind, b))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,added:boolean>>"


def personal_data(docs: DataFrame, model: Tagger, sure: float = SURE) -> DataFrame:
    """doc_id and spans (kind, start, end in characters, end exclusive, added) by start, then kind, for each row of ``docs``."""
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 22):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(model, texts, base, sure)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "added": new} for a, k, b, new in
                     sorted([(*s, False) for s in old] + [(*s, True) for s in extra])] for old, extra in zip(base, more)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind_type)], names=["doc_id", "spans"])

    return id_text(docs).mapInArrow(find, f"doc_id long, spans {SPANS}")


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: ~s["added"])

    def of_kind(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"))
