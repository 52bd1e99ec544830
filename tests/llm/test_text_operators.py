import random
import re
import zlib

import numpy as np
import pytest

from formline.llm import bilstm_crf, byte_tokens, decontaminate, language_id, packing, personal_data, token_counts, training_order
from formline.session import scratch


@pytest.fixture(scope="module")
def pieces_model():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("chunk,overlap", [(32768, 256), (2000, 4)])
def test_token_counts_equal_the_library(spark, odd_docs, pieces_model, chunk, overlap):
    texts = [t for (t,) in odd_docs.select("text").collect()] + ["ab " * 20000, " " * 9000 + "x", "é" * 9000]
    docs = odd_docs.select("doc_id", "text", "rid").unionByName(spark.createDataFrame([(50 + i, t, "") for i, t in enumerate(texts[-3:])], "doc_id long, text string, rid string"))
    library = token_counts.processor(pieces_model)
    got = token_counts.token_counts(docs, pieces_model, chunk, overlap)
    want = sorted([(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in docs.select("doc_id", "text").collect()], key=str)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_token_counts_of_nothing(no_docs, pieces_model):
    assert token_counts.token_counts(no_docs, pieces_model).count() == 0


def plain_viterbi(e, switch):
    v = e[0].astype(float)
    for row in e[1:]:
        v = np.maximum(v, v.max() - switch) + row
    return v.max()


def test_best_paths_are_viterbi(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 7)
    rng = np.random.default_rng(0)
    for _ in range(30):
        k, sizes = rng.integers(1, 5), rng.integers(1, 40, size=5)
        owner = np.repeat(np.arange(5), sizes)
        e = rng.normal(size=(len(owner), k)).astype(np.float32) * 3
        labels = language_id.best_paths(e, owner, 2.5)
        for o in range(5):
            at = np.flatnonzero(owner == o)
            value = sum(e[i, labels[i]] for i in at) - 2.5 * sum(labels[i] != labels[i - 1] for i in at[1:])
            assert value == pytest.approx(plain_viterbi(e[at], 2.5), abs=1e-3)


def test_language_id_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language_id.op3_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_spans_of_odd_texts(spark, folder, odd_docs, no_docs):
    model = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = language_id.language_spans(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (4, 5, 6, 7):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        else:
            assert r.lang_pred in model.langs and r.spans[0].start >= 0
    mixed = "Le chat est dans la maison avec les enfants. " * 5 + "Der Hund ist auf der Straße und schläft nicht. " * 5
    train = spark.createDataFrame([(mixed[:225], "fr"), (mixed[225:], "de")] * 20, "text string, lang string")
    langs, scores, spans = language_id.label(language_id.fit(train), [mixed])
    assert [s["lang"] for s in spans[0]] == ["fr", "de"] and abs(spans[0][1]["start"] - 225) < 3
    assert language_id.language_spans(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.language_spans(odd_docs, nothing).collect()} == {"und"}
    kept = language_id.in_known_language(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id in (4, 5, 6, 7)").count() == 0
    assert language_id.in_known_language(no_docs, model).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    model = bilstm_crf.Tagger.fresh(hidden=3, width=2)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids = rng.integers(1, 99, size=(4, 7))
    tags = np.zeros((4, 7), dtype=int)
    tags[0, 2:5], tags[2, 1:3] = [1, 2, 2], [5, 6]
    _, grads = model.loss_and_grads(ids, tags)
    for name, w in model.weights.items():
        at = (ids[1, 3], 1) if name == "emb" else tuple(0 for _ in w.shape)
        kept = w[at]
        w[at] = kept + 1e-3
        up, _ = model.loss_and_grads(ids, tags)
        w[at] = kept - 1e-3
        down, _ = model.loss_and_grads(ids, tags)
        w[at] = kept
        assert (up - down) / 2e-3 == pytest.approx(float(grads[name][at]), abs=2e-3)


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 0 or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 14 <= len(digits) <= 19 and personal_data.luhn(digits)) \
                    or (kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("aé1234567890..@@-+ ()%") for _ in range(rng.randint(0, 40)))
        assert personal_data.base_spans(text) == plain_spans(text)
    parts = ["a", "4111111111111111", "1.2.3.4", "255", ".", " ", "@b.c", "+1 (555) 555-5555", "-", "x.y@z.w", "0"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert personal_data.base_spans(text) == plain_spans(text)
    for text in ("a" * 200000, "1" * 200000, "1." * 100000, "+" * 100000, "a@" * 50000):  # in linear time
        personal_data.base_spans(text)


def test_tagger_finds_held_out_spans(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = personal_data.fit(docs.filter("doc_id % 2 = 0"))
    texts = [t for (t,) in docs.filter("doc_id % 2 = 1").select("text").collect()]
    base = [personal_data.base_spans(t) for t in texts]
    own = personal_data.added_spans(model, texts, [[] for _ in texts], 0.5)
    hits = sum(len(set(a) & set(b)) for a, b in zip(own, base))
    assert hits >= 0.6 * sum(map(len, base)) and sum(map(len, own)) <= 1.3 * sum(map(len, base))  # learned from 48 spans
    rows = personal_data.personal_data(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert [(s.kind, s.start) for r in rows if r.doc_id == 11 for s in r.spans if not s.added] == [("email", 5), ("ip", 17), ("email", 31), ("ip", 43)]
    assert all(not r.spans for r in rows if r.doc_id in (4, 5, 6))
    assert personal_data.personal_data(no_docs, personal_data.fit(no_docs)).count() == 0


def test_disguised_spans_are_missed_by_the_patterns_and_sound():
    rng = np.random.default_rng(3)
    for span, kind in (("ann.b@mail7.example.com", 0), ("10.20.30.40", 1), ("4111111111111111", 2), ("+1 (555) 555-1234", 3)):
        seen = {personal_data.disguised(span, kind, rng) for _ in range(200)}
        assert len(seen) > 3 and span not in seen
        for new in seen:
            whole = [s for s in personal_data.base_spans(new) if s == (0, kind, len(new))]
            assert not whole and (kind == 2 or personal_data.sound(new, kind))
    assert personal_data.sound("4111.1111.1111.1111", 2) and not personal_data.sound("4111.1111.1111.1112", 2)
    assert not personal_data.sound("10 . 20 . 30 . 400", 1) and not personal_data.sound("ann at home", 0) and not personal_data.sound("5555551234", 3)


def test_tagger_adds_what_the_patterns_miss(spark, no_docs):
    """Held-out spans, disguised: recall 0.8 and precision 0.9 at least; base spans stay; texts without such spans get none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = personal_data.fit(docs.filter("doc_id % 2 = 0"))
    rng = np.random.default_rng(5)
    held, planted, want = [t for (t,) in docs.filter("doc_id % 2 = 1").select("text").collect()], [], []
    for t in held:
        for a, kind, b in personal_data.base_spans(t):
            for _ in range(4):
                new = personal_data.disguised(t[a:b], kind, rng)
                while kind == 2 and not personal_data.luhn(re.sub("[^0-9]", "", new)):
                    new = personal_data.disguised(t[a:b], kind, rng)
                whole = t[:a] + new + t[b:]
                if all(y <= a or a + len(new) <= x for x, _, y in personal_data.base_spans(whole)):
                    planted.append(whole)
                    want.append((personal_data.KINDS[kind], a, a + len(new)))
    rows = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(rows, model).collect()}
    added = [(d, s.kind, s.start, s.end) for d, spans in got.items() for s in spans if s.added]
    hits = len(set(added) & {(d, *w) for d, w in enumerate(want)})
    assert len(want) > 100 and hits >= 0.8 * len(want) and hits >= 0.9 * len(added)
    assert all([(personal_data.KINDS.index(s.kind), s.start, s.end) for s in got[d] if not s.added] == [(k, a, b) for a, k, b in personal_data.base_spans(t)] for d, t in enumerate(planted))
    assert not any(personal_data.added_spans(model, held, [personal_data.base_spans(t) for t in held], personal_data.SURE))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokens.vocabulary_files()[0])


def test_byte_tokens_equal_the_library(library):
    files, rng = byte_tokens.vocabulary_files(), random.Random(2)
    signs = [chr(c) for c in range(256)] + [" ", "\n", "'s", "the", " ing", "\x85", "\xa0", "中", "<|endoftext|>"] * 4
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        assert byte_tokens.encode(text, *files).tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, library):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    for d, t in docs:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        mine = [(r.start, r.length, r.ids_crc32) for r in pieces[d]]
        start = 0
        for size in packing.piece_lengths(len(ids), packing.CAPACITY):
            assert (start, size, zlib.crc32(ids[start:start + size].tobytes())) in mine
            start += size
    return len(sequences)


def test_packing(spark, folder, odd_docs, no_docs, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op9_best_fit_packing(spark, folder).collect()
    used = check_packing(rows, docs, library)
    assert used <= 1.03 * sum(r.length for r in rows) / packing.CAPACITY + 1
    check_packing(packing.packed(odd_docs).collect(), [tuple(r) for r in odd_docs.select("doc_id", "text").collect()], library)
    assert packing.packed(no_docs).count() == 0
    with_ids = packing.packed(odd_docs, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)


def test_sum_of_squares_takes_the_best_gap():
    rng = np.random.default_rng(1)
    capacity = 20
    lengths = rng.integers(1, capacity + 1, size=200)
    where = packing.sum_of_squares(lengths, capacity)
    fill: dict[int, int] = {}
    for size, b in zip(lengths.tolist(), where.tolist()):
        def cost(chosen):
            after = dict(fill)
            after[chosen] = after.get(chosen, 0) + size
            gaps = [capacity - x for x in after.values() if x < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        options = [x for x, held in fill.items() if held + size <= capacity] + [len(fill)]
        assert cost(b) == min(cost(o) for o in options)
        fill[b] = fill.get(b, 0) + size


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(training_order.slots(np.arange(n), n, 99).tolist()) == list(range(n))
    assert training_order.slots(np.arange(1000), 1000, 1).tolist() != training_order.slots(np.arange(1000), 1000, 2).tolist()


def test_training_order_round_trip(spark, odd_docs, no_docs, library):
    path = scratch(spark, "shards")
    training_order.materialise(odd_docs, path, key=5, length=64, per_shard=32, per_file=3)
    shards = sorted(training_order.read_from(spark, path, 0, per_shard=32, per_file=3).collect(), key=lambda s: s.shard)
    assert [s.first_slot for s in shards] == [32 * i for i in range(len(shards))]
    assert all(len(s.ids) == 128 * len(s.n) for s in shards) and all(len(s.n) == 32 for s in shards[:-1])
    found = sorted((s.doc_id[i], s.piece[i], bytes(s.ids[i * 128:i * 128 + 2 * n])) for s in shards for i, n in enumerate(s.n) if s.doc_id[i] is not None)
    want = []
    for d, t in odd_docs.select("doc_id", "text").collect():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [byte_tokens.END], dtype="<u2").tobytes()
        if d is not None:
            want += [(d, i, ids[128 * i:128 * i + 128]) for i in range(-(-len(ids) // 128))]
    assert found == sorted(want)
    assert sorted(s.shard for s in training_order.read_from(spark, path, 70, per_shard=32, per_file=3).collect()) == list(range(2, len(shards)))
    files = spark.read.parquet(path).inputFiles()
    assert len(files) == -(-len(shards) // 3) > 2
    later = training_order.read_from(spark, path, 32 * 6 + 5, per_shard=32, per_file=3)
    assert len(later.inputFiles()) == len(files) - 2 and min(s.shard for s in later.collect()) == 6  # no file before the slot is opened
    assert "Exchange" not in later._jdf.queryExecution().toString()
    for f in files:
        assert len({r.shard // 3 for r in spark.read.parquet(f).collect()}) == 1
    whole = [(s.first_slot + i, bytes(s.ids[128 * i:128 * i + 128])) for s in shards for i in range(len(s.n))]
    assert list(training_order.sequences_from(spark, path, 199, 64, 32, 3)) == whole[199:]
    assert list(training_order.sequences_from(spark, path, len(whole), 64, 32, 3)) == []
    empty = scratch(spark, "shards")
    training_order.materialise(no_docs, empty, key=5)
    assert spark.read.parquet(empty).count() == 0


def test_training_order_covers_all_documents(spark, folder):
    rows = training_order.op1_training_order(spark, folder).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_decontamination(spark, folder, odd_docs, no_docs):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontamination(spark, folder).collect()}
    items = bench.collect()
    verbatim = {(d, b.item_id) for d, t in docs.select("doc_id", "text").collect() for b in items if b.text in t}
    assert verbatim and got == verbatim
    question = "In May Tom bought 12 apples at the old market and Tom ate 12 of them before the evening came around."
    changed = "In June Anna bought 37 apples at the old market and Anna ate 37 of them before the evening came around."
    own = spark.createDataFrame([(1, question), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    rows = odd_docs.select("doc_id", "text", "place").unionByName(spark.createDataFrame(
        [(70, f"Bla bla. {changed} x", ""), (71, changed.replace("ate 37", "ate 36"), ""), (72, "so two words here", ""), (None, question, ""), (73, question.upper(), "")],
        "doc_id long, text string, place string"))
    found = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contamination(rows, own).collect()}
    assert found == {(70, 1): True, (72, 2): False, (None, 1): False, (73, 1): False} or found == {(70, 1): True, (72, 2): False, (None, 1): False}
    kept = decontaminate.clean(odd_docs, own)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert decontaminate.clean(rows.select("doc_id", "text"), own).filter("doc_id = 70").count() == 0
    assert decontaminate.contamination(no_docs, own).count() == 0 and decontaminate.contamination(odd_docs, own.limit(0)).count() == 0
    assert decontaminate.clean(odd_docs, own.limit(0)).count() == odd_docs.count()


def contaminated(spark, items, rows):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}


def test_decontamination_of_items_mostly_of_placeholders(spark):
    sums = "What is 12 + 7 and 15 * 4 and 81 / 9 and 66 - 13 and 5 * 8"
    names = "the list: Anna Berta Carla Dora Emma Frida Gerda Hanna Ida Jana"
    rows = [(1, f"so {sums} x"), (2, f"so {names} x"), (3, "so 3 7 11 x"), (4, sums.replace("1", "2").replace("8", "3").replace("6", "9")), (5, "so 3 7 12 x")]
    assert contaminated(spark, [(1, sums), (2, names), (3, "3 7 11")], rows) == {(1, 1): False, (2, 2): False, (3, 3): False, (4, 1): True}


def test_decontamination_counts_unchanged_windows(spark):
    words = " ".join(f"word{c} stands near" for c in "abcdefghijklm").split()
    item = " ".join([*words[:12], "12", *words[12:24], "12", *words[24:36], "34", *words[36:]])
    first, last = item.replace(" 12 ", " 13 ", 1), item.replace(" 34 ", " 12 ")
    question = "In May Tom bought 12 apples at the old market and Tom ate 12 of them before the evening came around."
    rows = [(1, first), (2, last), (3, question.upper()), (4, question.lower())]
    found = contaminated(spark, [(1, item), (2, question)], rows)
    assert set(found) == {(1, 1), (2, 1), (3, 2), (4, 2)} and not found[3, 2] and not found[4, 2]


class AtSigns:
    """Stands in for a tagger: finds ``ann at home.org`` wherever it is shown, and notes how many characters it saw."""

    WORD = "ann at home.org"

    def __init__(self):
        self.seen = 0

    def decode(self, ids):
        self.seen += int((ids > 0).sum())
        word = personal_data.characters(self.WORD)
        tags, sure = np.zeros(ids.shape, dtype=np.int64), np.ones(ids.shape)
        for row, tag in zip(ids, tags):
            for i in range(len(row) - len(word) + 1):
                if (row[i:i + len(word)] == word).all():
                    tag[i:i + len(word)] = [1] + [2] * (len(word) - 1)
        return tags, sure


def test_tagger_reads_every_character():
    """No digit, sign or dot word marks these texts, and a span may stand anywhere, also where windows meet."""
    for length in (0, 1, 15, 47, 96, 240, 241, 432, 433, 2000, 5001):
        model, text = AtSigns(), "x" * length
        assert personal_data.added_spans(model, [text], [[]], 0.5) == [[]] and model.seen >= length
    for at in range(0, 900):
        text = "x " * (at // 2) + " " * (at % 2) + AtSigns.WORD + " y" * 300
        assert personal_data.added_spans(AtSigns(), ["plain words", text], [[], []], 0.5) == [[], [(at, 0, at + len(AtSigns.WORD))]]


def test_rows_plainly_outside_are_outside():
    rng = np.random.default_rng(1)
    model = bilstm_crf.Tagger.fresh()
    model.weights["out_b"][0] = 1.5
    ids = rng.integers(0, 100, size=(300, 40))
    assert np.allclose(model.read(ids), model.emissions(ids), atol=1e-5)
    e = model.read(ids)
    clear = model.plainly_outside(e)
    assert 0 < clear.sum() and not model.best(e[:, clear])[0].any()
    tags, sure = model.decode(ids)
    want = model.best(e)
    assert (tags == want[0]).all() and np.allclose(sure[~clear], want[1][~clear])


def test_only_rows_with_a_run_that_may_pay_are_searched():
    """Single characters that lean to a tag are outside when a run costs more than it gains; no row with a tag is called outside."""
    rng = np.random.default_rng(2)
    model = bilstm_crf.Tagger.fresh()
    model.weights["move"][0, 1:] = model.weights["move"][1:, 0] = -0.8
    e = rng.normal(0, 0.15, (60, 400, bilstm_crf.TAGS)).astype(np.float32)
    e[:, :, 0] += 1.0
    e[rng.integers(1, 59, size=400), np.arange(400), 1] += 1.2
    e[0, :9, 1] += 4.0  # a row may open with a tag, without a move
    e[-1, 9:18, 1] += 4.0  # or end with one
    clear, tags = model.plainly_outside(e), model.best(e)[0]
    assert not tags[clear].any() and clear.mean() > 0.9 and tags[:9, 0].all() and tags[9:18, -1].all()
    assert model.plainly_outside(e[:, :0]).shape == (0,)


def test_decoding_in_blocks_equals_decoding_whole(monkeypatch):
    rng = np.random.default_rng(3)
    model = bilstm_crf.Tagger.fresh()
    ids = rng.integers(0, 100, size=(70, 33)).astype(np.uint8)
    want = model.best(model.emissions(ids))
    monkeypatch.setattr(bilstm_crf, "BLOCK", 16)
    tags, sure = model.decode(ids)
    rows = tags.any(axis=1)
    assert rows.any() and (tags == want[0]).all() and np.allclose(sure[rows], want[1][rows], atol=1e-4)
    assert model.decode(ids[:0])[0].shape == (0, 33)
