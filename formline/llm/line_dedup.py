"""Near-duplicate lines by an edit join, in DataFrame functions only.

The edits allowed follow the length (``edit_bands``): lines of lo to hi - 1 characters, hi = 1.2 lo, may differ by hi / 20 edits, two at
least: one edit in 17 to 20 characters from 40 on. Of two lines the shorter one's band decides. Two such lines share a run of
lo / (edits + 1) characters whole, at places at most that many edits apart. A run that long holds at least one full window of
``w`` grams of ``k`` characters, and equal windows choose the same gram (the least hash, the leftmost of equals), so lines meet under
(group of bands, chosen gram, stretch of places); the next group's shortest lines are guests of a group. The number of keys is linear in the
length, whatever the edits. Lines of different groups never meet, so the groups meet in passes of about an eighth of the characters each, and only one pass's keys are on disk at a time.

With a fixed ``threshold`` lines meet by segments instead: a line of l characters is cut into threshold + 1 even segments.
Two lines within ``threshold`` edits of each other share one of them whole, at a place that the lengths confine: each line indexes its own segments under (length, number, hash) and
probes, for every length it may meet, the substrings at those places. Lines that meet are stripped of their common
prefix and suffix, found by halving steps, and what is left is rated by the banded bit-parallel recurrence: one
column of the band of 2 * threshold + 1 rows is one machine word, one step of ``aggregate`` a character. Bands of lines that
allow more than WORD edits (the recurrence, interpreted, is slow there; from 15 on it would not fit the word) are rated by Spark's own ``levenshtein`` with its limit, which is exact too, and it turns away the pairs of the other bands that are not near.

Lines stand in the order of (id, null ids last; text hash; line number). A line goes if an equal line, or one within the
threshold, stands before it. Lines of fewer than ``min_chars`` characters always stay. Lines end at newlines.

Equal lines are one class before anything meets, so a very common line costs as little as a rare one.

Defined results: a null text has no lines; an empty text has one empty line, which stays; rows that repeat id and text stand in
the same place, so none of them is before the other and they are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import query, table
from formline.session import stored as written

MIN_CHARS, WORD, CHUNK, PIECE = 24, 6, 512, 16
PASSES, PASS_CHARS = 8, 5_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``session.stored``, whose shuffle files go as soon as the table is written."""
    conf = df.sparkSession.conf
    held = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, held)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def common_prefix(a: Column, b: Column, n: Column, steps: int = 24) -> Column:
    """Length of the common prefix of two strings of at least ``n`` characters, n at most: doubling steps up, then down."""
    def grow(done: Column, step: Column) -> Column:
        return F.when((done + step <= n) & (F.substring(a, done + 1, step) == F.substring(b, done + 1, step)), done + step).otherwise(done)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(steps, -1, -1)]), F.lit(0), grow)


def banded_distance(a: Column, b: Column, threshold: int | Column) -> Column:
    """Edit distance of strings whose lengths differ by ``threshold`` (14 at most) at most; exact up to ``threshold``, else some larger number."""
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)
    m, n = F.length(a), F.length(b)
    mask, top = power(2 * t + 1) - 1, power(2 * t)
    padded = F.concat(F.repeat(F.lit(" "), t), a, F.repeat(F.lit(" "), t))

    def matches(j: Column) -> Column:
        """Bit k: row j - t + k of the pattern is a real row and equals character j of the text."""
        def bits(window: Column, char: Column) -> Column:
            real = F.sequence(F.greatest(F.lit(0), t + 1 - j), F.least(2 * t, m + t - j))
            return F.aggregate(real, F.lit(0), lambda found, k: F.when(F.substring(window, k + 1, F.lit(1)) == char, found.bitwiseOR(power(k))).otherwise(found))
        return let(F.substring(padded, j, 2 * t + 1), lambda window: let(F.substring(b, j, F.lit(1)), lambda char: bits(window, char)))

    def step(s: Column, j: Column) -> Column:
        vp, vn, dist = s["vp"], s["vn"], s["dist"]

        def with_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
            hn = d0.bitwiseAND(vp)
            bit = power(F.greatest(m - j + t, F.lit(0)))
            along = dist + F.when(d0.bitwiseAND(top) != 0, 0).otherwise(1)
            down = dist + F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            half = F.shiftright(d0, 1)
            return F.struct(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"), half.bitwiseAND(hp).alias("vn"),
                            F.when(j <= m - t, along).otherwise(down).cast("int").alias("dist"))

        # the diagonal never falls, and the 2 * t columns at most along the last row lower it by one each
        onward = let(matches(j), lambda x: let((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask), with_d0))
        return F.when(dist > 3 * t, s).otherwise(onward)

    start = F.struct((mask - power(t) + 1).alias("vp"), F.lit(0).alias("vn"), F.least(m, t).cast("int").alias("dist"))
    return F.when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["dist"]))


def within(a: Column, b: Column, threshold: int | Column) -> Column:
    """Whether the edit distance of two strings is at most ``threshold``."""
    short = F.least(F.length(a), F.length(b))

    def after_prefix(p: Column) -> Column:
        x, y = F.substring(a, p + 1, F.length(a)), F.substring(b, p + 1, F.length(b))

        def after_suffix(q: Column) -> Column:
            rest_x, rest_y = F.substring(x, F.lit(1), F.length(x) - q), F.substring(y, F.lit(1), F.length(y) - q)
            near = banded_distance(rest_x, rest_y, threshold) <= threshold
            if isinstance(threshold, int) and threshold == 1:  # what is left differs at both ends, which one edit can do for single characters only
                near = F.when(F.greatest(F.length(rest_x), F.length(rest_y)) > 1, False).otherwise(near)
            return near
        return let(common_prefix(F.reverse(x), F.reverse(y), short - p), after_suffix)

    return (F.abs(F.length(a) - F.length(b)) <= threshold) & let(common_prefix(a, b, short), after_prefix)


def segment(length: Column, k: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment k (from 0) of a line of ``length`` characters; the longer segments come last."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(F.lit(k) - (parts - longer), F.lit(0))
    return base * k + extra + 1, base + F.when(F.lit(k) >= parts - longer, 1).otherwise(0)


def key_columns(line: Column, length: Column, threshold: int) -> tuple[list[Column], list[Column]]:
    """Index keys of a line, and the further keys it probes."""
    parts = threshold + 1

    def key(of_length: Column, k: int, offset: int) -> Column:
        start, size = segment(of_length, k, parts)
        start = start + offset
        return F.when((start >= 1) & (start + size - 1 <= length), F.xxhash64(of_length, F.lit(k), F.substring(line, start, size)))

    index = [key(length, k, 0) for k in range(parts)]
    probes = []
    for less in range(threshold + 1):
        for k in range(parts):
            # the edits left of the segment, and those right of it, both bound the shift
            low, high = max(-k, less - (threshold - k)), min(k, less + (threshold - k))
            probes += [key(length - less, k, shift) for shift in range(low, high + 1) if less or shift]
    return index, probes


def edit_bands(least: int = MIN_CHARS, most: int = 1 << 31) -> list[tuple[int, int, int, int]]:
    """(lo, edits, k, w) of the bands of lengths: edits allowed to a line of lo characters up to the next band, gram length and grams a window."""
    out, lo = [], max(least, 1)
    while lo < most:
        width = max(1, lo // 5)
        edits = min(max(2, (lo + width) // 20), width, lo - 1)
        run = lo // (edits + 1)
        w = max(1, (run + 1) * 3 // 8)
        out.append((lo, edits, run + 1 - w, w))
        lo += width
    return out


def key_groups(bands: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(first band, edits of its last one, edits at most, gram length, grams a window) of runs of up to two bands whose shared runs are about as long."""
    out, at = [], 0
    run = lambda i: bands[i][2] + bands[i][3] - 1
    while at < len(bands):
        size = 2 if at + 1 < len(bands) and abs(run(at) - run(at + 1)) <= 2 else 1
        _, _, k, w = min(bands[at:at + size], key=lambda b: b[2] + b[3])
        out.append((at + 1, bands[at + size - 1][1], max(b[1] for b in bands[at:at + size]), k, w))
        at += size
    return out


def chosen_grams(chunk: Column, k: Column, w: Column) -> Column:
    """Distinct hash << 10 | place (from 1) of the grams of k characters that the windows of w grams of a chunk choose."""
    n = F.length(chunk) - k + 1

    def of_piece(start: Column) -> Column:
        """The grams that start in one piece: a substring costs its place, so it is taken from a short string."""
        def grams(piece: Column) -> Column:
            hashed = lambda i: F.shiftleft(F.xxhash64(F.substring(piece, i, k)), 10).bitwiseOR((start + i - 1).cast("long"))
            return F.transform(F.sequence(F.lit(1), F.least(F.lit(PIECE), n - start + 1)), hashed)
        return let(F.substring(chunk, start, k + (PIECE - 1)), grams)

    grams = F.flatten(F.transform(F.sequence(F.lit(1), n, F.lit(PIECE)), of_piece))
    return let(grams, lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - w + 1), lambda j: F.array_min(F.slice(g, j, w)))))


def line_keys(texts: DataFrame, least: int) -> DataFrame:
    """group, chars and the columns that give a line's keys in each group it stands in: its own one, and the one before as a guest."""
    bands = edit_bands(least)
    groups = key_groups(bands)
    numbers = lambda values, kind="int": F.array(*[F.lit(v).cast(kind) for v in values])
    borders = numbers([b[0] for b in bands], "long")
    of_band = lambda values: F.element_at(numbers(values), F.col("band"))
    group_of = [sum(g[0] <= i for g in groups) for i in range(1, len(bands) + 1)]
    sized = texts.select("h", "g", "line", F.length("line").alias("n")).withColumn("band", F.size(F.filter(borders, lambda b: b <= F.col("n"))))
    sized = sized.select("h", "g", "line", "n", of_band([b[1] for b in bands]).alias("edits"), of_band(group_of).alias("own"))
    # a line is a guest of the group before its own if a line of that one's last band may be within its edits
    start = F.element_at(numbers([bands[g[0] - 1][0] for g in groups], "long"), F.col("own"))
    earlier = F.greatest(F.col("own") - 1, F.lit(1))
    guest = (F.col("own") > 1) & (F.col("n") - start < F.element_at(numbers([g[1] for g in groups]), earlier))
    placed = sized.withColumn("group", F.explode(F.when(guest, F.array("own", earlier)).otherwise(F.array("own"))))
    of_group = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(g[2:], ("most", "k", "w"))]) for g in groups])
    return placed.withColumn("b", F.element_at(of_group, F.col("group"))).select("h", "g", "line", "n", "edits", "group", (F.col("own") == F.col("group")).alias("own"), "b.*")


def passes(placed: DataFrame) -> list[tuple[int, int]]:
    """(first, last) group of the passes, of about an eighth of all characters each or one large group; a single one for few characters."""
    chars = sorted((r["group"], r["chars"]) for r in placed.groupBy("group").agg(F.sum("n").alias("chars")).collect())  # one row a group
    limit = max(PASS_CHARS, sum(c for _, c in chars) / PASSES)
    out, held = [], 0
    for group, n in chars:
        if not out or held + n > limit:
            out.append((group, group))
            held = 0
        out[-1] = (out[-1][0], group)
        held += n
    return out


def near_by_length(texts: DataFrame, least: int) -> DataFrame:
    """Pairs (h1, g1, h2, g2) of different lines within the edits of the shorter one's band; ``texts`` has h, g and line of each line once."""
    placed = line_keys(texts, least)
    parts = [near_of_groups(placed, a, b) for a, b in passes(placed)]
    pairs = parts[0] if parts else texts.sparkSession.createDataFrame([], "h1 long, g1 int, h2 long, g2 int")
    for part in parts[1:]:
        pairs = pairs.union(part)
    return pairs


def near_of_groups(placed: DataFrame, first: int, last: int) -> DataFrame:
    """Near pairs of one pass. Their texts meet here, so they travel for one pass at a time too."""
    inside = placed.filter(F.col("group").between(first, last))
    pairs = met_lines(inside)
    lines = inside.filter(F.col("own") | (F.col("group") == last)).select("h", "g", "line")  # a guest of an earlier group stands in its own one too
    # a broadcast would leave the rating to as many tasks as the pairs have files
    both = pairs.join(lines.toDF("h1", "g1", "a").hint("merge"), "h1").join(lines.toDF("h2", "g2", "b").hint("merge"), "h2")
    by_word = within(F.col("a"), F.col("b"), F.least("edits", F.lit(WORD)))
    # native, so it turns away the many that are not near before the recurrence rates the rest of the short bands
    rated = F.when(F.call_function("levenshtein", F.col("a"), F.col("b"), F.col("edits")) < 0, False).when(F.col("edits") > WORD, True).otherwise(by_word)
    return stored(both.filter(rated).select("h1", "g1", "h2", "g2"), "line-near")


def met_lines(placed: DataFrame) -> DataFrame:
    """Pairs (h1, h2, edits) of lines that share a key and whose lengths are within the edits of the shorter one."""
    # long lines go in chunks of window starts
    starts = F.sequence(F.lit(1), F.col("n") - F.col("k") - F.col("w") + 2, F.lit(CHUNK))
    cut = placed.withColumn("start", F.explode(starts)).withColumn("chunk", F.substring("line", F.col("start"), F.col("k") + F.col("w") + (CHUNK - 2)))

    def keys_of(gram: Column) -> Column:
        """Of two places at most ``most`` edits apart the first one's later stretch or its own is the second one's own."""
        place, stretch = F.col("start") + gram.bitwiseAND(F.lit(1023)).cast("int"), F.lit(4) * (F.col("most") + 1)
        return F.transform(F.array(place, place + F.col("most")), lambda p: F.xxhash64("group", F.shiftright(gram, 10), F.floor(p / stretch)))

    keys = F.array_distinct(F.flatten(F.transform(chosen_grams(F.col("chunk"), F.col("k"), F.col("w")), keys_of)))
    # length, edits and whether it is the line's own group in one word: only three words a key travel
    about = (F.shiftleft(F.col("n").cast("long"), 29) + F.col("edits") * 2 + F.col("own").cast("int")).alias("about")
    keys = cut.select(F.explode(keys).alias("key"), "h", about)
    one, two = keys.toDF("key", "h1", "about1"), keys.toDF("key", "h2", "about2")
    shorter = F.least("about1", "about2")  # the length comes first in the word
    edits = F.shiftright(shorter, 1).bitwiseAND(F.lit((1 << 28) - 1)).cast("int")
    close = F.abs(F.shiftright("about1", 29) - F.shiftright("about2", 29)) <= edits
    met = one.join(two, "key").filter((F.col("h1") < F.col("h2")) & (F.col("about1").bitwiseOR(F.col("about2")).bitwiseAND(F.lit(1)) == 1) & close)
    return stored(met.select("h1", "h2", edits.alias("edits")).distinct(), "line-pairs")


def lines_of(docs: DataFrame) -> DataFrame:
    """null_id, doc_id, text_key, line_no, line of every line."""
    rows = docs.select(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))
    return rows.select("null_id", "doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def possible_member(keys: DataFrame, bits: int = 18) -> Callable[[Column], Column]:
    """A test that all values of the only column (long) of ``keys`` pass and few others do. It is a bitmap of 2 ** bits bits whatever the number
    of keys: 32 KB in the plan, collected as at most 2 ** bits / 64 rows. It only spares rows a shuffle; the join behind it decides."""
    key = F.col(keys.columns[0])
    place = F.pmod(key, F.lit(1 << bits))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
    held = bytearray((1 << bits) // 8)
    for r in words.collect():
        held[8 * r.word:8 * r.word + 8] = r.set.to_bytes(8, "little", signed=True)

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(1 << bits))
        byte = F.conv(F.hex(F.substring(F.lit(held), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int"))) != 0
    return test


def near_lines(long_lines: DataFrame, threshold: int) -> DataFrame:
    """Pairs (h1, g1, h2, g2) of different lines (two hashes each) within the threshold."""
    hashed = long_lines.select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line", F.length("line").alias("n"))
    index, probes = key_columns(F.col("line"), F.col("n"), threshold)
    entries = F.concat(F.transform(F.array(*index), lambda k: F.struct(F.lit(True).alias("own"), k.alias("key"))),
                       F.transform(F.array(*probes), lambda k: F.struct(F.lit(False).alias("own"), k.alias("key"))))
    keys = hashed.select("h", F.explode(entries).alias("e")).select("h", "e.own", "e.key").filter("key is not null")
    keys = stored(keys.groupBy("key", "h").agg(F.max("own").alias("own"), F.min("own").alias("only_own")), "line-keys")  # equal lines count once before they meet
    own = keys.filter("own").select("key", F.col("h").alias("h1"))
    met = keys.select("key", F.col("h").alias("h2"), "only_own").join(own, "key")
    # two index entries meet twice, in either role; one is enough
    pairs = met.filter("h1 <> h2 and (not only_own or h1 < h2)").select(F.least("h1", "h2").alias("h1"), F.greatest("h1", "h2").alias("h2")).distinct()
    pairs = stored(pairs, "line-pairs")
    needed = pairs.select(F.col("h1").alias("h")).union(pairs.select("h2")).distinct()
    # only lines that may be needed travel with their text
    texts = stored(hashed.filter(possible_member(needed)(F.col("h"))).select("h", "g", "line").join(needed, "h").groupBy("h", "g").agg(F.first("line").alias("line")), "line-texts")
    both = pairs.join(texts.toDF("h1", "g1", "a"), "h1").join(texts.toDF("h2", "g2", "b"), "h2")
    return both.filter(within(F.col("a"), F.col("b"), threshold)).select("h1", "g1", "h2", "g2")


def removed_lines(docs: DataFrame, threshold: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), removed (sorted numbers, from 0, of the lines that go) for documents that lose a line.
    Without a ``threshold`` the edits allowed follow the length."""
    place = F.struct("null_id", "doc_id", "text_key", "line_no")
    long_lines = lines_of(docs).filter(F.length("line") >= min_chars)
    hashed = long_lines.select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), place.alias("place"), "line")
    if threshold is None:
        texts = stored(hashed.groupBy("h", "g").agg(F.min("place").alias("place"), F.first("line").alias("line")), "line-classes")
        first, pairs = texts.drop("line"), near_by_length(texts, min_chars)
    else:
        first = stored(hashed.groupBy("h", "g").agg(F.min("place").alias("place")), "line-classes")
        pairs = near_lines(long_lines, threshold)
    x, y = first.toDF("h1", "g1", "p1"), first.toDF("h2", "g2", "p2")
    later = F.when(F.col("p1") < F.col("p2"), F.struct(F.col("h2").alias("h"), F.col("g2").alias("g"))).otherwise(F.struct(F.col("h1").alias("h"), F.col("g1").alias("g")))
    losers = stored(pairs.join(x, ["h1", "g1"]).join(y, ["h2", "g2"]).select(later.alias("c")).select("c.*").distinct(), "later-lines")
    classes = first.join(losers.withColumn("later", F.lit(True)), ["h", "g"], "left")
    rows = long_lines.select("null_id", "doc_id", "text_key", "line_no", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    gone = rows.join(classes, ["h", "g"]).filter(F.col("later").isNotNull() | (place > F.col("place")))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of text (and n_chars, where there is such a column, counted again); a document that loses all its lines goes."""
    gone = removed.select(F.col("doc_id").alias("gone_id"), "text_key", "removed")
    row = docs.select(F.struct("*").alias("row"))  # the caller's columns under one name, so none can clash
    rows = row.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("text_key")), "left")
    lines = F.split("row.text", "\n")
    rows = rows.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))).filter("removed is null or size(kept) > 0")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(let(lines, lambda all_: F.array_join(F.transform("kept", lambda i: all_[i]), "\n")))
    renewed = {"text": text, "n_chars": F.when(F.col("removed").isNull(), F.col("row")["n_chars"]).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*[(renewed[c] if c in renewed else F.col("row")[c]).alias(c) for c in docs.columns])


@query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines, comma-joined, for each document."""
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))
